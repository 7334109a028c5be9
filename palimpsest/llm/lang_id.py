"""Language identification of mixed-language text.

A word's script (from code point ranges) narrows the languages that may have written it. Each
word then gets a log score per language from character n-grams, and a Viterbi pass over the
words of a text, with a penalty for each switch, labels its spans. The text's language is the
one that most of its words carry.

Words are scored and labelled a block of texts at a time, in numpy. Where no stretch of words lets
other languages beat the text's best single one by the penalty, a switch can't pay and the best
path stays with it; only the stretches between such places take a Viterbi pass, which changes no label.

The model is fitted on at most :data:`SAMPLE_ROWS` labelled rows (chosen by a hash of their
id) and keeps at most :data:`MODEL_GRAMS` n-grams: those with the largest share of any one
language's grams, so that a language with few rows keeps its own. Counting is distributed.

A word is a run of letters; combining marks belong to the word that they follow. Null text,
empty text and text without a letter: ``und`` with score 0. With no labelled row at
all every text is ``und``. Ties between languages go to the first in code point order. Every row
is returned, repeated rows too; texts are read whole whatever their length. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches, map_texts, text_of

SAMPLE_ROWS = 20_000
MODEL_GRAMS = 60_000
ORDERS = (1, 2, 3, 4)
SWITCH_PENALTY = 12.0
UNKNOWN = "und"
#: A language is a candidate for a script that holds this share of its training letters.
SCRIPT_SHARE = 0.01
#: Words that a task remembers, characters scored at once, and the length from which a word is scored by itself.
_CACHE_WORDS, _SCORE_CHARS, _LONG_WORD = 100_000, 100_000, 20_000


def _mark_ranges() -> str:
    """Combining marks as the inside of a character class."""
    marks = [c for c in range(0x300, 0x20000) if unicodedata.category(chr(c)) in ("Mn", "Mc")]
    runs = [[c for _, c in run] for _, run in groupby(enumerate(marks), lambda x: x[1] - x[0])]
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)


_MARKS = _mark_ranges()
_LETTERS = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*")
_LEADING = re.compile(f"^[{_MARKS}]+")


def _plain(word: str) -> str:
    """Letters and the marks that follow them; empty without a letter."""
    if word.isalpha():
        return word
    kept = "".join([c for c in word if c.isalpha() or unicodedata.category(c) in ("Mn", "Mc")])
    kept = _LEADING.sub("", kept)
    return kept if any(map(str.isalpha, kept)) else ""
#: First code point of each script range; 0 is "other".
_RANGES = [
    (0x0, "other"), (0x41, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"),
    (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "other"),
    (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"),
    (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
_STARTS = [r[0] for r in _RANGES]


def script_of(char: str) -> str:
    return _RANGES[bisect_right(_STARTS, ord(char)) - 1][1]


def grams(word: str) -> list[str]:
    """Character n-grams of a lower-case word between boundary marks."""
    marked = f"^{word}$"
    return [marked[i : i + n] for n in ORDERS for i in range(len(marked) - n + 1) if n > 1 or marked[i] not in "^$"]


@dataclass
class Model:
    """Languages, alphabet, gram keys by order and their rows in ``table[row, language]`` (log probabilities, the last row for unknown grams), and each script's candidates."""

    langs: list[str]
    alphabet: np.ndarray
    keys: list[np.ndarray]
    rows: list[np.ndarray]
    table: np.ndarray
    scripts: dict[str, list[bool]]
    penalty: float = SWITCH_PENALTY


def pack(langs: list[str], names: list[str], counts: np.ndarray, scripts: dict[str, list[bool]], penalty: float) -> Model:
    """A model of the grams ``names`` from their ``counts`` (gram, language).

    A gram's key is its characters' places in the alphabet (from 1), 16 bits each, so keys are
    exact; characters beyond the alphabet have place 0, which no gram of the model holds.
    """
    size = counts.sum(axis=0) + 0.5 * (len(names) + 1)
    table = np.log(np.vstack([counts, np.zeros((1, len(langs)))]) + 0.5) - np.log(size)
    alphabet = np.array(sorted(set(map(ord, "^$" + "".join(names))))[:65_535], dtype=np.uint32)
    place = {chr(c): i + 1 for i, c in enumerate(alphabet.tolist())}
    keys, rows = [], []
    for order in ORDERS:
        found = sorted((sum(place.get(c, 0) << 16 * k for k, c in enumerate(g)), i) for i, g in enumerate(names) if len(g) == order)
        keys.append(np.array([k for k, _ in found], dtype=np.uint64))
        rows.append(np.array([i for _, i in found], dtype=np.int64))
    return Model(langs, alphabet, keys, rows, table, scripts, penalty)


def fit(df: DataFrame, text: str, label: str, key: Column, sample_rows: int = SAMPLE_ROWS, model_grams: int = MODEL_GRAMS, penalty: float = SWITCH_PENALTY) -> Model:
    """Fit on the rows of ``df`` that have a label; ``key`` decides which rows a bounded sample takes."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(text).alias("_t"), F.col(label).alias("_l"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("_h")).filter("_l is not null and _t is not null")
    total = rows.count()
    if total > sample_rows:
        rows = rows.filter(F.col("_h") < int(sample_rows / total * (1 << 30)))

    def count(batches):
        import pyarrow as pa

        found: dict[str, Counter] = {}
        for batch in batches:
            for label_, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(label_, Counter()).update(_LETTERS.findall(text_.lower()))
        for lang, words in found.items():
            tally: Counter = Counter()
            for word, n in words.items():
                for g in grams(word):
                    tally[g] += n
                tally["#" + script_of(word[0])] += n * len(word)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(tally)), "gram": pa.array(list(tally)), "n": pa.array(list(tally.values()), pa.int64())})

    counted = rows.select("_l", "_t").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    script = F.col("gram").startswith("#")
    # one row for each language
    sizes = counted.filter(~script).groupBy("lang").agg(F.sum("n").alias("_all"))
    shared = counted.join(F.broadcast(sizes), "lang", "left")
    by_gram = shared.groupBy("gram").agg(F.max(F.col("n") / F.col("_all")).alias("share"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    top = by_gram.orderBy(script.desc(), F.desc("share"), "gram").limit(model_grams).collect()
    langs = sorted({lang for r in top for lang in r["by_lang"]})
    names = [r["gram"] for r in top if not r["gram"].startswith("#")]
    counts = lambda r: np.array([r["by_lang"].get(x, 0) for x in langs], dtype=float)
    script_rows = {r["gram"][1:]: counts(r) for r in top if r["gram"].startswith("#")}
    letters = sum(script_rows.values(), np.zeros(len(langs)))
    scripts = {k: list(v >= SCRIPT_SHARE * np.maximum(letters, 1)) for k, v in script_rows.items()}
    table = np.array([counts(r) for r in top if not r["gram"].startswith("#")]).reshape(len(names), len(langs))
    return pack(langs, names, table, {k: v for k, v in scripts.items() if any(v)}, penalty)


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.uint64, np.ndarray]:
    """For each slot of a table of about 32 times the keys: one key's place, and whether several keys fall there; with the hash's shift."""
    bits = max(10, int(32 * max(1, keys.size)).bit_length())
    shift = np.uint64(64 - bits)
    spot = ((keys * _SPREAD) >> shift).astype(np.int64)
    slot = np.zeros(1 << bits, dtype=np.int32)
    slot[spot] = np.arange(keys.size)
    return slot, shift, np.bincount(spot, minlength=1 << bits) > 1


class Labeller:
    """Labels words with a fitted model; the scores of a bounded number of words are kept between blocks."""

    def __init__(self, model: Model):
        self.model = model
        # the last row of all is a sum of nothing
        self.table = np.vstack([model.table, np.zeros((1, model.table.shape[1]))])
        self.place = np.zeros(0x110000, dtype=np.uint16)
        self.place[model.alphabet] = np.arange(1, model.alphabet.size + 1)
        self.slots = [_slots(k) for k in model.keys]
        self.known: dict[str, int] = {}
        self.used = 0
        self.scores = np.zeros((1024, max(1, len(model.langs))))
        self.blocks = np.zeros(1024, dtype=np.int32)  # blocks that held the word

    def words(self, text: str) -> list[str]:
        return _LETTERS.findall(text.lower())

    def _codes(self, chars: str) -> np.ndarray:
        """Places of characters in the model's alphabet."""
        return self.place[np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.uint64)

    def _gram_rows(self, codes: np.ndarray, order: int) -> np.ndarray:
        """The table's row of each gram of ``order`` characters that begins in ``codes``."""
        n = max(0, codes.size - order + 1)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(order):
            key |= codes[k : k + n] << np.uint64(16 * k)
        known, rows = self.model.keys[order - 1], self.model.rows[order - 1]
        last = len(self.model.table) - 1
        if not known.size:
            return np.full(n, last)
        slot, shift, crowded = self.slots[order - 1]
        spot = ((key * _SPREAD) >> shift).astype(np.int64)
        at = slot[spot]
        out = np.where(known[at] == key, rows[at], last)
        # slots that several keys share are looked up by search
        if (shared := np.flatnonzero(crowded[spot])).size:
            at = np.minimum(np.searchsorted(known, key[shared]), known.size - 1)
            out[shared] = np.where(known[at] == key[shared], rows[at], last)
        return out

    def raw_scores(self, words: list[str]) -> np.ndarray:
        """Log score of each word in each language, grams only."""
        table = self.table
        out = np.zeros((len(words), table.shape[1]))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if len(words) == 1 and sizes[0] >= _LONG_WORD:
            codes = self._codes(f"^{words[0]}$")
            for order in ORDERS:
                part = codes if order > 1 else codes[1:-1]
                out[0] += np.bincount(self._gram_rows(part, order), minlength=len(table)) @ table
            return out
        codes = self._codes("".join([f"^{w}$" for w in words]))
        starts = np.cumsum(sizes + 2) - sizes - 2
        where = np.arange(codes.size) - np.repeat(starts, sizes + 2)
        room = np.repeat(sizes + 2, sizes + 2) - where
        sums = np.zeros((codes.size, table.shape[1]))
        for order in ORDERS:
            rows = self._gram_rows(codes, order)
            inside = room[: rows.size] >= order
            if order == 1:
                inside &= (where > 0) & (room > 1)
            rows[~inside] = len(table) - 1
            sums[: rows.size] += table[rows]
        return np.add.reduceat(sums, starts, axis=0)

    def _score(self, words: list[str]) -> np.ndarray:
        """Log scores of words of letters, languages of other scripts far below."""
        out = np.zeros((len(words), self.scores.shape[1]))
        at, chars, begin = 0, 0, 0
        for at, word in enumerate(words):
            if chars and chars + len(word) > _SCORE_CHARS:
                out[begin:at] = self.raw_scores(words[begin:at])
                begin, chars = at, 0
            chars += len(word)
        out[begin:] = self.raw_scores(words[begin:])
        firsts = np.frombuffer("".join([w[0] for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = np.searchsorted(_STARTS, firsts, side="right") - 1
        for kind in np.unique(kinds).tolist():
            if (allowed := self.model.scripts.get(_RANGES[kind][1])) is not None:
                rows = np.flatnonzero(kinds == kind)
                part = out[rows]
                out[rows] = np.where(allowed, part, part.min(axis=1, keepdims=True) - 100.0)
        return out

    def _learn(self, words: set[str]) -> None:
        names = [w for w in words if w.isalpha()]
        real = list(names)
        for w in words.difference(names):
            if plain := _plain(w):
                names.append(w)
                real.append(plain)
            else:
                self.known[w] = -1
        self.known.update(zip(names, range(self.used, self.used + len(real)), strict=True))
        while self.used + len(real) > len(self.scores):
            self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
            self.blocks = np.r_[self.blocks, np.zeros_like(self.blocks)]
        if real:
            self.scores[self.used : self.used + len(real)] = self._score(real)
        self.used += len(real)

    def _forget(self) -> None:
        """Keep the words that several blocks held, if they leave room; most words occur once."""
        stay = [(w, i) for w, i in self.known.items() if i >= 0 and self.blocks[i] > 1]
        stay = stay if len(stay) <= _CACHE_WORDS // 2 else []
        rows = [i for _, i in stay]
        self.known.clear()
        self.known.update((w, k) for k, (w, _) in enumerate(stay))
        self.used = len(rows)
        self.scores = np.vstack([self.scores[rows], np.zeros((1024, self.scores.shape[1]))])
        self.blocks = np.r_[self.blocks[rows], np.zeros(1024, dtype=np.int32)]

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language index of each word of each text; -1 for what holds no letter."""
        known = self.known
        fresh = set().union(*texts).difference(known)
        if len(known) + len(fresh) > _CACHE_WORDS:
            self._forget()
            fresh = set().union(*texts).difference(known)
        self._learn(fresh)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ids = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        real = ids >= 0
        self.blocks[: self.used] += np.bincount(ids[real], minlength=self.used) > 0
        out = np.full(ids.size, -1, dtype=np.int16)
        out[real] = self._paths(ids[real], owner[real])
        return np.split(out, np.cumsum(sizes)[:-1]) if len(texts) else []

    def _paths(self, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Best labels of the words ``ids`` of several texts, ``owner`` ascending."""
        if not ids.size:
            return np.zeros(0, dtype=np.int16)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, ids.size])
        scores, penalty = self.scores[ids], self.model.penalty
        best = np.add.reduceat(scores, starts, axis=0).argmax(axis=1)
        mine = np.repeat(best, sizes)
        place = np.arange(ids.size)
        own = scores[place, mine].copy()
        scores[place, mine] = -np.inf
        # What the best other language gains on the text's own, word by word. A stretch of others that
        # ends at a word gains at most the prefix sum there less the least one before; where that isn't
        # above 0 the word is the own language's. A stretch from the text's start saves one switch.
        gain = np.maximum(scores.max(axis=1) - own, -4 * penalty)
        total = np.cumsum(gain)
        shift = np.repeat(np.arange(len(starts)), sizes) * (2.0 * np.abs(total).max() + 2 * penalty + 1.0)
        total -= shift
        before = total - gain
        hot = total - np.minimum.accumulate(before) > penalty - 1e-3
        out = mine.astype(np.int16)
        if not hot.any():
            return out
        before[starts] -= penalty
        cut = total <= np.minimum.accumulate(before)
        first = np.zeros(ids.size, dtype=bool)
        first[starts] = True
        begins = np.flatnonzero(first | np.r_[False, cut[:-1]])
        ends = np.r_[begins[1:], ids.size]
        mixed = np.flatnonzero(np.maximum.reduceat(hot, begins))
        # a word that only the own language can have written stands for what is cut off on either side
        used, langs = self.used, scores.shape[1]
        padded = np.vstack([self.scores[:used], np.where(np.eye(langs, dtype=bool), 0.0, -1e9)])
        items = []
        for k in mixed.tolist():
            a, b = int(begins[k]), int(ends[k])
            pad = [used + int(mine[a])]
            items.append((k, np.r_[[] if first[a] else pad, ids[a:b], pad if cut[b - 1] else []].astype(np.int64)))
        for k, path in viterbi(items, padded, penalty):
            a, b = int(begins[k]), int(ends[k])
            at = 0 if first[a] else 1
            out[a:b] = path[at : at + b - a]
        return out


def viterbi(items: list[tuple[int, np.ndarray]], scores: np.ndarray, penalty: float) -> list[tuple[int, np.ndarray]]:
    """Best label paths of many sequences at once: step t advances every sequence longer than t."""
    if not items:
        return []
    items = sorted(items, key=lambda x: -x[1].size)
    sizes = np.array([x[1].size for x in items])
    steps, langs = int(sizes[0]), scores.shape[1]
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences with more than t words
    flat = np.concatenate([x[1] for x in items])
    begin = np.cumsum(sizes) - sizes
    offset = np.cumsum(active) - active
    stay = np.empty((int(active.sum()), langs), dtype=bool)
    best = np.empty(int(active.sum()), dtype=np.int16)
    value = scores[flat[begin]]
    final = np.empty(len(items), dtype=np.int16)
    for t in range(1, steps):
        n = int(active[t])
        prev = value[:n]
        top = prev.argmax(axis=1)
        jump = prev[np.arange(n), top] - penalty
        keep = prev >= jump[:, None]
        stay[offset[t] : offset[t] + n] = keep
        best[offset[t] : offset[t] + n] = top
        new = np.where(keep, prev, jump[:, None]) + scores[flat[begin[:n] + t]]
        if n < len(value):
            final[n : len(value)] = value[n:].argmax(axis=1)
        value = new
    final[: len(value)] = value.argmax(axis=1)
    paths = np.empty(flat.size, dtype=np.int16)
    state = final.copy()
    for t in range(steps - 1, -1, -1):
        n = int(active[t])
        paths[begin[:n] + t] = state[:n]
        if t:
            rows = offset[t] + np.arange(n)
            state[:n] = np.where(stay[rows, state[:n]], state[:n], best[rows])
    return [(k, paths[b : b + s]) for (k, _), b, s in zip(items, begin, sizes, strict=True)]


def identify(df: DataFrame, model: Model, keep: dict[str, Column], text: str = "text", spans: bool = False) -> DataFrame:
    """``keep`` plus ``lang_pred, score`` (share of the words that carry it) and, if asked, ``spans``.

    ``spans`` is an array of ``(start, end, lang)`` in code points, end exclusive, one for each
    maximal run of words with one language.
    """

    def make():
        labeller, langs = Labeller(model), model.langs

        def work(texts: list[str]) -> dict:
            words = [labeller.words(t) for t in texts]
            labels = labeller.label(words) if langs else [np.full(len(w), -1) for w in words]
            pred, score, runs = [], [], []
            for text_, path in zip(texts, labels, strict=True):
                real = path[path >= 0]
                votes = np.bincount(real, minlength=1) if real.size else None
                pred.append(UNKNOWN if votes is None else langs[int(votes.argmax())])
                score.append(0.0 if votes is None else float(votes.max() / real.size))
                if spans:
                    runs.append(_runs(text_, path, langs))
            return {"lang_pred": pred, "score": score} | ({"spans": runs} if spans else {})

        return work

    columns = "lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if spans else "")
    return map_texts(df, keep, text_of(text), make, columns, block_bytes=2_000_000)


def _runs(text: str, path: np.ndarray, langs: list[str]) -> list[dict]:
    # Lower-casing can change lengths, so spans are taken from the text itself.
    found = [m.span() for m in _LETTERS.finditer(text)]
    if len(found) != len(path):
        found = found[: len(path)] + [(len(text), len(text))] * (len(path) - len(found))
    out: list[dict] = []
    for (a, b), k in zip(found, path.tolist(), strict=True):
        if k < 0:
            continue
        if out and out[-1]["lang"] == langs[k]:
            out[-1]["end"] = b
        else:
            out.append({"start": a, "end": b, "lang": langs[k]})
    return out


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """Whether a row is kept from training; a null id is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """Contract columns: learn from the rows that aren't held out, predict all."""
    out = held_out(4, 2)
    model = fit(docs.filter(~out), "text", "lang", F.col("doc_id"))
    return identify(docs, model, {"doc_id": F.col("doc_id"), "held_out": out})
