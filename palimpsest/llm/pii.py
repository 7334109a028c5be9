"""Personal data in text: exact base patterns, and a semi-Markov CRF for what they miss.

Base spans come from the four contract patterns and always stay. Between them, windows of
tokens around digits and ``@`` are segmented by a semi-Markov conditional random field: whole
candidate segments (up to :data:`MAX_TOKENS` tokens) are scored by features of their shape,
digits, checksum and context, and a dynamic programme picks boundaries and types together. It
finds what the patterns can't, such as phone numbers without a plus sign or in pairs of digits,
addresses with spaced or bracketed dots, and written-out mail addresses. The weights are fitted on the driver by gradient ascent on the exact segment
likelihood, over windows that a seeded generator builds; no corpus row is used.

Null text is read as empty. Texts are read whole, in time proportional to their length: windows
reach at most :data:`EDGE` characters for white space and are joined where they meet, a token cut
by a window's end is left out, and a segment has at most :data:`LONGEST` characters. Every row is
returned, repeated rows too; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_texts, text_of

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 14
#: Tokens on either side of a trigger that a window holds.
REACH = 10
#: Characters that a window may reach beyond that for white space, and that a segment may have.
EDGE = LONGEST = 120
#: Features that fewer training segments have are left out of the model.
MIN_SEEN = 8
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)+")
_GROUPS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base matches, by start and then by kind as listed."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        # The pattern holds one @, so the leftmost match there starts where its run of characters does.
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            end = m.end()
            at = text.find("@", end)
        else:
            # a run before a failing @ can't be part of a later match
            end = at + 1
            at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        # A chain of dotted numbers holds its leftmost matches in fours.
        parts = m.group().split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            stop = start + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p) <= 255 if len(p) < 4 else int(p.lstrip("0")[:4] or 0) <= 255 for p in four):
                out.append((start, stop, "ip"))
            start = stop + 1
    for m in _GROUPS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    for m in _PLUS.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((*m.span(), "phone"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


# ---- the semi-Markov CRF ----

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_TRIGGER = re.compile(r"[0-9]{3}|[0-9]{1,2}[ ./()_-]{1,3}[0-9]{1,2}[ ./()_-]{1,3}[0-9]|[\[({]\s*(?:at|dot|\.)\s*[\])}]|\s@\s|\sat\s(?=\s*[A-Za-z0-9-]+\s+dot\s)", re.I)
#: A plain "at" counts only before a name and a plain "dot".
_AT = re.compile(r"@|[\[({]\s*at\s*[\])}]|\sat\s(?=\s*[A-Za-z0-9-]+\s+dot\s)", re.I)
_DOT = re.compile(r"\.|[\[({]\s*(?:dot|\.)\s*[\])}]|\sdot\s", re.I)
_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]+(?:\s*(?:@|[\[({]\s*at\s*[\])}])\s*|\s+at\s+)[A-Za-z0-9-]+(?:(?:\s?(?:\.|[\[({]\s*(?:dot|\.)\s*[\])}])\s?|\s+dot\s+)[A-Za-z0-9-]+)+", re.I)
_PAIRED = re.compile(r"0[0-9]([ .-])[0-9]{2}(?:\1[0-9]{2}){3}")
_OCTETS = re.compile(r"([0-9]{1,3})(?:(?:\s?\.\s?|\s?[\[({]\.[\])}]\s?)([0-9]{1,3})){3}")
_NANP = re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}")
_PHONE_LIKE = re.compile(r"(?:\+|00)?[0-9(][0-9 ().-]+[0-9]")
_CARD_LIKE = re.compile(r"[0-9]{4}([ ./_-]{1,2})[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([ ./_-]{1,2})[0-9]{6}\2[0-9]{5}")


def plausible(segment: str) -> bool:
    """Whether a segment may be an entity at all: it holds seven digits, four numbers, or an at sign."""
    if len(segment) > LONGEST:
        return False
    digits = sum(c.isdigit() for c in segment)
    return digits >= 7 or (digits >= 4 and len(_DOT.findall(segment)) >= 3) or bool(_AT.search(segment))


def segment_features(segment: str, before: str, after: str) -> list[str]:
    """Whole-span features: form, digits, checksum, and the characters around it."""
    digits = "".join(c for c in segment if c.isdigit())
    n = len(digits)
    out = ["bias", f"digits{min(n, 20)}", f"first{_kind(segment[0])}", f"last{_kind(segment[-1])}", f"before{_kind(before)}", f"after{_kind(after)}"]
    letters = any(c.isalpha() for c in segment)
    out.append(f"letters{letters}")
    shape = re.sub(r"[0-9]+", lambda m: f"<{len(m.group())}>", re.sub(r"[A-Za-z]+", "a", segment))
    out.append(f"shape{shape[:40]}")
    for name, rule in (("written", _WRITTEN), ("octets", _OCTETS), ("nanp", _NANP), ("paired", _PAIRED), ("phone", _PHONE_LIKE), ("card", _CARD_LIKE)):
        if rule.fullmatch(segment):
            out.append(name)
    if "octets" in out and all(int(x) <= 255 for x in re.findall(r"[0-9]+", segment)):
        out.append("octets_fit")
    if 14 <= n <= 19 and luhn(digits):
        out += ["luhn"] + ["luhn_card"] * ("card" in out)
    if _AT.search(segment):
        out.append("at")
    return out


def _kind(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


class SegmentModel:
    """Weights per feature and type; a segment outside every entity is one token and scores 0."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.score = lru_cache(maxsize=50_000)(self._score)

    def _score(self, segment: str, before: str, after: str) -> np.ndarray | None:
        if not plausible(segment):
            return None
        out = np.zeros(len(KINDS))
        for f in segment_features(segment, before, after):
            if (w := self.weights.get(f)) is not None:
                out += w
        return out

    def candidates(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, np.ndarray]]:
        """Segments (first token, token after the last, scores) that may be entities."""
        out = []
        if not tokens:
            return out
        # only segments with four digits or an at sign can be plausible; digits are added up token by token
        digits = [b - a if text[a].isdigit() else 0 for a, b in tokens]
        signs = [m.span() for m in _AT.finditer(text, max(0, tokens[0][0] - 1), tokens[-1][1])]
        sign = 0
        for i, (a, _) in enumerate(tokens):
            while sign < len(signs) and signs[sign][0] < a:
                sign += 1
            first_at = signs[sign][1] if sign < len(signs) else math.inf
            found = 0
            for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
                b = tokens[j - 1][1]
                if b - a > LONGEST:
                    break
                found += digits[j - 1]
                if (found >= 4 or first_at <= b) and (s := self.score(text[a:b], text[a - 1 : a] if a else "", text[b : b + 1])) is not None:
                    out.append((i, j, s))
        return out

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[Span]:
        """The best segmentation of the tokens; ties leave tokens outside."""
        n = len(tokens)
        ending: dict[int, list] = {}
        for i, j, s in self.candidates(text, tokens):
            if s.max() > 0:
                ending.setdefault(j, []).append((i, s))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, s in ending.get(j, ()):
                k = int(s.argmax())
                if best[i] + s[k] > best[j]:
                    best[j], back[j] = best[i] + s[k], (i, k)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((tokens[i][0], tokens[j - 1][1], KINDS[k]))
                j = i
        return out[::-1]

    def learn(self, windows: list[tuple[str, list[Span]]], epochs: int = 4, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Ascend the log likelihood of the gold segmentations by forward-backward."""
        self.score.cache_clear()
        prepared = []
        for text, gold in windows:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            cands = []
            for i, (a, _) in enumerate(tokens):
                for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
                    b = tokens[j - 1][1]
                    if plausible(text[a:b]):
                        cands.append((i, j, segment_features(text[a:b], text[a - 1 : a] if a else "", text[b : b + 1]), [float((a, b, k) in gold) for k in KINDS]))
            prepared.append((len(tokens), cands))
        seen = Counter(f for _, cands in prepared for _, _, feats, _ in cands for f in feats)
        prepared = [(n, [(i, j, [f for f in feats if seen[f] >= MIN_SEEN], gold) for i, j, feats, gold in cands]) for n, cands in prepared]
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for n, cands in prepared:
                if not cands:
                    continue
                for _, _, feats, _ in cands:
                    for f in feats:
                        if f not in self.weights:
                            self.weights[f] = np.full(len(KINDS), -2.0) if f == "bias" else np.zeros(len(KINDS))
                scores = [sum(self.weights[f] for f in feats) for _, _, feats, _ in cands]
                ahead = [-math.inf] * n + [0.0]
                behind = [0.0] + [-math.inf] * n
                by_end: dict[int, list[int]] = {}
                by_start: dict[int, list[int]] = {}
                for c, (i, j, _, _) in enumerate(cands):
                    by_end.setdefault(j, []).append(c)
                    by_start.setdefault(i, []).append(c)
                total = [float(np.logaddexp.reduce(s)) for s in scores]
                for j in range(1, n + 1):
                    behind[j] = _lse([behind[j - 1], *(behind[cands[c][0]] + total[c] for c in by_end.get(j, ()))])
                for i in range(n - 1, -1, -1):
                    ahead[i] = _lse([ahead[i + 1], *(ahead[cands[c][1]] + total[c] for c in by_start.get(i, ()))])
                for (i, j, feats, gold), s in zip(cands, scores, strict=True):
                    slope = np.array(gold) - np.exp(np.minimum(0, behind[i] + s + ahead[j] - behind[n]))
                    if np.abs(slope).max() > 1e-3:
                        for f in feats:
                            self.weights[f] += step * (slope - decay * self.weights[f]) / math.sqrt(len(feats))
        self.score.cache_clear()


def _lse(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def training_windows(count: int = 700, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Labelled windows: entities in written forms that the base patterns miss, and look-alikes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(1, 9)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = num(15)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def email() -> str:
        at = rng.choice([" [at] ", " (at) ", "[at]", "(at)", " @ ", "{at}"])
        dot = rng.choice([".", " [dot] ", " (dot) ", "[.]", "(dot)"])
        if rng.random() < 0.2:
            at, dot = " at ", " dot "
        return word() + rng.choice(["", ".", "_"]).join(["", word()]) + at + word() + dot + rng.choice(["com", "org", "net", "example"])

    def ip() -> str:
        return rng.choice([" . ", "[.]", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4))

    def dotted_card() -> str:
        c, sep = card(), rng.choice([".", "/", "_", "  "])
        return sep.join(c[i : i + 4] for i in range(0, 16, 4))

    def paired() -> str:
        return rng.choice([" ", " ", ".", "-"]).join(["0" + rng.choice("123456789")] + [num(2) for _ in range(4)])

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}", f"+1 ({a}) {b}-{c}", f"+44 {a} {b} {c}", paired(), paired()])

    def other() -> str:
        r = rng.randint
        return rng.choice([
            f"{r(1900, 2099)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"{r(1, 9)}.{num(7)}", f"{r(1, 9)}.{r(0, 9)}.{r(0, 9)}", num(r(5, 12)),
            f"{num(4)}.{num(4)}.{num(4)}.{num(4)}", f"{r(300, 999)}[.]{r(300, 999)}[.]{num(3)}[.]{num(3)}", f"{num(3)}-{num(4)}", f"{num(3)},{num(3)},{num(3)}",
            f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{word()} (at {word()})", f"{num(6)} {num(6)}", f"{num(2)}/{num(2)}/{num(4)} {num(2)}:{num(2)}", f"@{word()} {word()}", f"{word()} at {word()} and {num(3)}", f"at {num(2)} dot {num(2)}", " ".join(num(2) for _ in range(rng.choice([3, 4, 6, 7]))), f"{r(1, 9)}{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"{num(2)}-{num(2)}-{num(2)}", f"{num(1)}. {num(1)}. {num(1)}", f"{num(3)} {num(3)} {num(3)} {num(3)}", num(16), num(40), f"${num(3)},{num(3)}.{num(2)}",
        ])

    makers = {"email": email, "ip": ip, "card": dotted_card, "phone": phone}
    out = []
    for _ in range(count):
        text, gold = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", " ", ", ", ": "])
            kind = rng.choice([*KINDS, "other", "other", "other"])
            made = makers.get(kind, other)()
            if kind in makers:
                gold.append((len(text), len(text) + len(made), kind))
            text += made + rng.choice([" ", " ", ", ", ". ", "\n"])
        out.append((text + word(), gold))
    return out


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    """Weights of the model; the same on every machine."""
    model = SegmentModel()
    model.learn(training_windows())
    return model.weights


def _same_run(text: str, at: int) -> bool:
    """Whether the characters around ``at`` belong to one token."""
    if not 0 < at < len(text):
        return False
    x, y = text[at - 1], text[at]
    return x.isascii() and y.isascii() and ((x.isalpha() and y.isalpha()) or (x.isdigit() and y.isdigit()))


class Finder:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.model = SegmentModel()
        self.model.weights = weights

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans of the model that touch no base span."""
        triggers = [m.span() for m in _TRIGGER.finditer(text)]
        if not triggers:
            return []
        windows: list[list[int]] = []
        for a, b in triggers:
            # to white space on both sides if it is near, so that no token is cut
            lo, hi = max(0, a - 8 * REACH), min(len(text), b + 8 * REACH)
            least, most = max(0, lo - EDGE), min(len(text), hi + EDGE)
            if windows and lo <= windows[-1][1]:
                lo = windows[-1][1]
            else:
                while lo > least and not text[lo - 1].isspace():
                    lo -= 1
            if not windows or hi > windows[-1][1]:
                while hi < most and not text[hi].isspace():
                    hi += 1
            if windows and lo <= windows[-1][1]:
                windows[-1][1] = max(hi, windows[-1][1])
            else:
                windows.append([lo, hi])
        # Windows are cut at base spans.
        taken = sorted((a, b) for a, b, _ in base)
        out: list[Span] = []
        k = 0
        for lo, hi in windows:
            at = lo
            while k < len(taken) and taken[k][1] <= lo:
                k += 1
            q = k
            pieces = []
            while q < len(taken) and taken[q][0] < hi:
                pieces.append((at, max(at, taken[q][0])))
                at = max(at, taken[q][1])
                q += 1
            pieces.append((at, max(at, hi)))
            for a, b in pieces:
                if b - a >= 7 and _TRIGGER.search(text, max(0, a - 1), min(len(text), b + 1)):
                    tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
                    # the ends of a piece may lie inside a run of letters or digits
                    if tokens and tokens[0][0] and _same_run(text, tokens[0][0]):
                        tokens = tokens[1:]
                    if tokens and _same_run(text, tokens[-1][1]):
                        tokens = tokens[:-1]
                    out += self.model.decode(text, tokens)
        return out

    def find(self, text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        return base, self.added(text, base)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(df: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` plus ``spans``: array of ``(start, end, kind, base)`` in code points, end exclusive."""
    weights = trained()

    def make():
        finder = Finder(weights)

        def work(texts: list[str]) -> dict:
            rows = []
            for t in texts:
                base, more = finder.find(t)
                both = sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append([{"start": a, "end": b, "kind": k, "base": f} for a, b, k, f in both])
            return {"spans": rows}

        return work

    return map_texts(df, keep, text_of(text), make, "spans array<struct<start:int,end:int,kind:string,base:boolean>>")


def masked(df: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` plus ``text`` with each found span replaced by its kind in angle brackets."""
    weights = trained()

    def make():
        finder = Finder(weights)

        def clean(t: str) -> str:
            base, more = finder.find(t)
            out, at = [], 0
            for a, b, k in sorted(base + more):
                if a >= at:
                    out += [t[at:a], f"<{k}>"]
                at = max(at, b)
            return "".join(out) + t[at:]

        return lambda texts: {"text": [clean(t) for t in texts]}

    return map_texts(df, keep, text_of(text), make, "text string")


def digests(docs: DataFrame) -> DataFrame:
    """Contract columns: counts and digest of the base spans, all spans joined."""
    weights = trained()

    def make():
        finder = Finder(weights)

        def work(texts: list[str]) -> dict:
            out: dict[str, list] = {**{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
            for t in texts:
                base, more = finder.find(t)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))) if more else joined(base))
            return out

        return work

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_texts(docs, {"doc_id": F.col("doc_id")}, text_of(), make, f"{counts}, base_sha256 string, spans string")
