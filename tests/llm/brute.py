"""Plain Python versions of the operators' contracts, for tables of a few hundred rows."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_groups(rows, k):
    """{(id, text): (set size, least id of the component)}; rows are (id, text)."""
    sets = {r: shingles(r[1], k) for r in set(rows)}
    parent = {r: r for r in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for r in sorted((r for r in sets if r[0] is not None), key=lambda r: r[0]):
        both = Counter(o for s in sets[r] for o in holders[s])
        for s in sets[r]:
            holders[s].append(r)
        for o, n in both.items():
            if 100 * n >= 80 * (len(sets[r]) + len(sets[o]) - n):
                x, y = root(r), root(o)
                if x != y:
                    parent[max(x, y, key=lambda z: z[0])] = min(x, y, key=lambda z: z[0])
    return {r: (len(sets[r]), root(r)[0]) for r in sets}


def spans(text, patterns, fails):
    """Contract spans of each kind: leftmost, non-overlapping, failing matches dropped."""
    out = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "", re.ASCII) if not fails(kind, m)]
    return sorted(out)


def joined(found):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def digest(found):
    return hashlib.sha256(joined(found).encode()).hexdigest()


def luhn(digits):
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


PRIVATE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def private_fails(kind, m):
    digits = re.sub("[^0-9]", "", m.group())
    if kind == "ip":
        return any(int(p) > 255 for p in m.group().split("."))
    if kind == "card":
        return not (14 <= len(digits) <= 19 and luhn(digits))
    return kind == "phone" and not 10 <= len(digits) <= 15


SECRET = {
    "assign": r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def secret_fails(kind, m):
    return len(m.group(2)) < 12 if kind == "assign" else len(m.group()) < {"access": 18, "hex": 16}[kind]


def winnowed(text, gram=4, window=8, piece=16, base=1_103_515_245, prime=(1 << 31) - 1):
    """[(hash, position)] kept by winnowing, by the definition."""
    import xxhash

    tokens = re.findall(r"[^\x20\x09-\x0D]{1,%d}" % piece, text or "")
    signed = lambda w: (xxhash.xxh64_intdigest(w.encode(), seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)
    h = [signed(w) % prime for w in tokens]

    def roll(part):
        out = 0
        for x in part:
            out = (out * base + x) % prime
        return out

    grams = [roll(h[i : i + gram]) for i in range(len(h) - gram + 1)] or ([roll(h)] if h else [])
    kept = []
    for i in range(max(1, len(grams) - window + 1)) if grams else ():
        part = grams[i : i + window]
        at = max(j for j, g in enumerate(part) if g == min(part))
        if not kept or kept[-1][1] != i + at:
            kept.append((grams[i + at], i + at))
    return kept


TOKEN = re.compile(r"(?=[A-Za-z0-9+/_=-]{20})[A-Za-z0-9+/_-]{16,}+=*+(?![A-Za-z0-9+/_-])|[A-Za-z0-9+/_-]{20,}+")


def random_evidence(token):
    """-ln of the combined p-value of one token, by the definitions of the three tests."""
    lower, upper, digit = any(map(str.islower, token)), any(map(str.isupper, token)), any(map(str.isdigit, token))
    body = token.rstrip("=")
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        alphabet, rate, codes = "0123456789abcdef", 0.1, body.lower()
    elif re.fullmatch("[A-Z2-7]+=*", token) and upper and digit:
        alphabet, rate, codes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.06, body
    elif lower and upper and digit:
        alphabet, rate, codes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.05, body.replace("-", "+").replace("_", "/")
    else:
        return 0.0
    x = [alphabet.index(c) for c in codes]
    n, k = len(x), len(alphabet)
    counts = Counter(x).values()
    chi = (sum((c - n / k) ** 2 / (n / k) for c in counts) + (k - len(counts)) * n / k - (k - 1)) / math.sqrt(2 * (k - 1))
    high = [v > (k - 1) / 2 for v in x]
    expected = 2 * sum(high) * (n - sum(high)) / n
    runs = (sum(a != b for a, b in zip(high, high[1:])) - expected) / math.sqrt(max(0.25, expected * (expected - 1) / (n - 1)))
    mean = sum(x) / n
    var = sum((v - mean) ** 2 for v in x)
    serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / var if var else 1.0
    if chi >= 3.5 or abs(runs) >= 3.5 or abs(serial) * math.sqrt(n) >= 3.5:
        return 0.0
    pairs, lam = sum(c * (c - 1) // 2 for c in counts), n * (n - 1) / 2 * rate
    few = (lam - pairs + (pairs * math.log(pairs / lam) if pairs else 0)) / 2.5 if pairs < lam else 0.0
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" for c in body if c.isalnum()]
    q = min(1 - 1e-9, max(1e-9, sum(a != b and (a, b) != ("A", "a") for a, b in zip(kinds, kinds[1:])) / (n - 1)))
    many = (n - 1) * (q * math.log(q / 0.2) + (1 - q) * math.log((1 - q) / 0.8)) if q > 0.2 else 0.0
    unlike = max(0.0, (math.atanh(0.3) - math.atanh(min(0.999, max(-0.999, serial)))) * math.sqrt(n - 3))
    z = (math.sqrt(2 * few) + math.sqrt(2 * many) + unlike) / math.sqrt(6)
    return z * z / 2


def random_spans(texts):
    """For each text its (start, end) of tokens that the step-up rule keeps, by length class, over all candidates."""
    found = []
    for at, text in enumerate(texts):
        taken = spans(text, SECRET, secret_fails)
        for m in TOKEN.finditer(text or ""):
            if not any(a < m.end() and m.start() < b for a, _, b, _ in taken):
                size = m.end() - m.start()
                bin_ = min(int(random_evidence(m.group()) // 0.25), 399)
                found.append((sum(size >= e for e in (24, 32, 48, 64)), bin_, at, m.span()))
    out = [[] for _ in texts]
    for stratum in {f[0] for f in found}:
        part = sorted((f for f in found if f[0] == stratum), key=lambda f: -f[1])
        good = [r for r, f in enumerate(part, 1) if math.exp(-0.25 * f[1]) * len(part) <= 0.05 * sum(g[1] >= f[1] for g in part)]
        for f in part:
            if good and f[1] >= part[max(good) - 1][1]:
                out[f[2]].append(f[3])
    return [sorted(s) for s in out]


def letters_and_marks(text):
    """Words: runs of letters, each with the combining marks that follow."""
    out, word = [], ""
    for c in text.lower():
        letter = c.isalnum() and unicodedata.category(c) != "Nd"
        mark = 0x300 <= ord(c) < 0x20000 and unicodedata.category(c) in ("Mn", "Mc")
        if letter or (mark and word):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


class Languages:
    """Per-word gram scores and a Viterbi pass over dictionaries, one word after another."""

    def __init__(self, rows, script_of, penalty=12.0):
        self.script_of, self.penalty = script_of, penalty
        self.counts, self.script = defaultdict(Counter), defaultdict(Counter)
        for text, lang in rows:
            for w in letters_and_marks(text):
                self.counts[lang].update(self.grams(w))
                self.script[script_of(w[0])][lang] += len(w)
        self.langs = sorted(self.counts)
        self.every = set().union(*self.counts.values())
        self.size = {x: sum(self.counts[x].values()) + 0.5 * (len(self.every) + 1) for x in self.langs}
        self.letters = {x: sum(s[x] for s in self.script.values()) for x in self.langs}
        self.known = {}

    @staticmethod
    def grams(word):
        marked = f"^{word}$"
        return [marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1) if n > 1 or marked[i] not in "^$"]

    def scores(self, word):
        kept = "".join(c for c in word if c.isalpha() or unicodedata.category(c) in ("Mn", "Mc"))
        while kept and not kept[0].isalpha():
            kept = kept[1:]
        if not kept:
            return None
        tally = Counter(self.grams(kept))
        out = {x: sum(n * math.log((self.counts[x][g] + 0.5) / self.size[x]) for g, n in tally.items()) for x in self.langs}
        seen = self.script.get(self.script_of(kept[0]))
        if seen:
            allowed = {x for x in self.langs if seen[x] >= 0.01 * max(self.letters[x], 1)}
            least = min(out.values())
            if allowed:
                out = {x: v if x in allowed else least - 100 for x, v in out.items()}
        return out

    def predict(self, text):
        best, back = None, []
        for w in letters_and_marks(text or ""):
            if w not in self.known:
                self.known[w] = self.scores(w)
            if (s := self.known[w]) is None:
                continue
            if best is None:
                best = dict(s)
                continue
            top = max(self.langs, key=lambda x: best[x])
            step = {x: x if best[x] >= best[top] - self.penalty else top for x in self.langs}
            best = {x: max(best[x], best[top] - self.penalty) + s[x] for x in self.langs}
            back.append(step)
        if best is None:
            return "und", 0.0
        path = [max(self.langs, key=lambda x: best[x])]
        for step in reversed(back):
            path.append(step[path[-1]])
        votes = Counter(path)
        first = min(votes, key=lambda x: (-votes[x], x))
        return first, votes[first] / len(path)


def text_statistics(text):
    """The quality model's features, each by its definition."""
    raw, words_, lines = text.encode(), text.split(), [x for x in text.split("\n") if x]
    n, m, k = max(1, len(raw)), max(1, len(words_)), max(1, len(lines))
    share = lambda test: sum(map(test, raw)) / n
    plain = ".,;:!?'\"-"
    ascii_ = lambda b, test: b < 128 and test(chr(b))
    counts, sizes = Counter(raw), [len(w) for w in words_] or [0]
    mean = sum(sizes) / len(sizes)
    return [
        math.log1p(len(raw)), share(lambda b: ascii_(b, str.isalpha)), share(lambda b: ascii_(b, str.isupper)), share(lambda b: ascii_(b, str.isdigit)), share(lambda b: b in b" \t"), share(lambda b: b in b"\n\r"),
        share(lambda b: chr(b) in plain), share(lambda b: 32 < b < 127 and not chr(b).isalnum() and chr(b) not in plain), share(lambda b: b >= 128), share(lambda b: b < 32 and b not in b"\t\n\r"),
        -sum(c / n * math.log2(c / n) for c in counts.values()), math.log1p(len(words_)), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)), math.log1p(max(sizes)), len(set(words_)) / m,
        max(Counter(words_).values(), default=0) / m, sum(s == 1 for s in sizes) / m, sum(w[0].isupper() for w in words_) / m, sum(not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'" for w in words_) / m,
        math.log1p(len(lines)), math.log1p(len(text) / k), len(set(lines)) / k, sum(len(x) < 30 for x in lines) / k, m / max(1, len(re.findall("[.!?]+", text))), sum(x[-1] not in ".!?" for x in lines) / k,
        len(zlib.compress(raw, 1)) / (n + 16), len(set(zip(words_, words_[1:]))) / m, sum(s > 12 for s in sizes) / m,
    ]
