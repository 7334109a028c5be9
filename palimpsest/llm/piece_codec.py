"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Each new word of a batch is laid out as a run in one flat numpy array of symbol ids. A round
finds every adjacent pair's rank, takes the segmented minimum per word, merges all leftmost
non-overlapping pairs of that rank at once, and compacts the array. Words without a mergeable
pair leave the array, so later rounds touch only what still changes.

Merging all pairs of the least rank together equals the one-at-a-time order only if no merge
can create a pair of equal or lesser rank. The model is checked for that when it is loaded:
products that can are merged one (the leftmost) per round.

Every round touches a whole word, so a long run without a space would cost the square of its
length. Words of more than :data:`LONG_WORD` characters are therefore first cut where no piece
holds the two characters next to each other, which no merge can bridge; parts that are still
longer take their merges from a heap, in time proportional to their length and its logarithm.

A piece never holds a space mark after another character, so a text splits exactly at each
run of marks; words are encoded once and kept in a bounded cache.

Null text is read as empty; the empty text encodes to the begin and end ids alone. Every row
is returned, repeated rows too. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_texts, text_of

MARK = "▁"
#: Words kept by one Python worker between batches.
CACHE_WORDS = 150_000
#: Characters from which a word is cut, and its parts are merged by a heap.
LONG_WORD = 400
#: Characters of new words encoded in one set of rounds.
BLOCK_CHARS = 2_000_000
_NONE = np.int64(1) << 40


class PieceCodec:
    """Encoder and decoder for one BPE model with byte fallback and the identity normaliser."""

    def __init__(self, model: str):
        import sentencepiece

        # Only the vocabulary is read from the library; encoding and decoding are done here.
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.bytes_id = np.zeros(256, dtype=np.int64)
        normal: dict[str, int] = {}
        score = {}
        self.surface: list[bytes] = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_id[value] = i
                self.surface.append(bytes([value]))
            elif sp.is_control(i):
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                normal[piece] = i
                score[piece] = sp.get_score(i)
                self.surface.append(piece.replace(MARK, " ").encode())
        self.single = {p: i for p, i in normal.items() if len(p) == 1}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {p: order[s] for p, s in score.items()}
        left, right, product, ranks = [], [], [], []
        unsafe = set()
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in normal and b in normal:
                    left.append(normal[a])
                    right.append(normal[b])
                    product.append(i)
                    ranks.append(rank[piece])
                    for part in (a, b):
                        if len(part) > 1 and rank[part] >= rank[piece]:
                            unsafe.add(rank[part])
        # Symbols that are in no piece (raw characters for byte fallback) get ids beyond the vocabulary.
        self.base = np.int64(1) << 21
        key = np.array(left, dtype=np.int64) * self.base + np.array(right, dtype=np.int64)
        at = np.argsort(key)
        self.key, self.product, self.rank = key[at], np.array(product, dtype=np.int64)[at], np.array(ranks, dtype=np.int64)[at]
        self.unsafe = np.zeros(max(order.values(), default=0) + 2, dtype=bool)
        self.unsafe[list(unsafe)] = True
        inside = {single[0] * (1 << 21) + single[1] for p in normal for single in zip([self.single.get(c, -1) for c in p], [self.single.get(c, -1) for c in p[1:]])}
        self.inside = np.array(sorted(k for k in inside if k >= 0), dtype=np.int64)
        self.merges: dict[int, tuple[int, int]] = {}
        self.cache: dict[str, bytes] = {}
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray, rank: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fill in rank and product of the pairs that begin at ``at``."""
        pair = symbols[at] * self.base + symbols[at + 1]
        row = np.searchsorted(self.key, pair)
        row[row == self.key.size] = 0
        same = (self.key[row] == pair) & (owner[at] == owner[at + 1])
        rank[at[same]] = self.rank[row[same]]
        product[at[same]] = self.product[row[same]]
        return rank, product

    def _rounds(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes."""
        count = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=count)
        text = "".join(words)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        seen, inverse = np.unique(chars, return_inverse=True)
        ids = np.array([self.single.get(chr(c), -1) for c in seen], dtype=np.int64)
        raw = ids < 0
        # an unknown character keeps its code point, moved beyond all ids
        ids[raw] = seen[raw].astype(np.int64) + (1 << 20)
        symbols = ids[inverse]
        owner = np.repeat(np.arange(count, dtype=np.int64), lengths)
        done_owner, done_symbols = [], []
        rank, product = self._pairs(symbols, owner, np.arange(max(0, symbols.size - 1)), np.full(symbols.size, _NONE), np.zeros(symbols.size, dtype=np.int64))
        while symbols.size:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, symbols.size])
            ended = least == _NONE
            if ended.any():
                stuck = np.repeat(ended, sizes)
                done_owner.append(owner[stuck])
                done_symbols.append(symbols[stuck])
                live = ~stuck
                symbols, owner, rank, product = symbols[live], owner[live], rank[live], product[live]
                least, sizes = least[~ended], sizes[~ended]
                if not symbols.size:
                    break
                starts = np.cumsum(sizes) - sizes
            # The hits of a round, and of overlapping ones in a run the first, third, ...
            where = np.flatnonzero(rank == np.repeat(least, sizes))
            new_run = np.r_[True, np.diff(where) != 1]
            order = np.arange(where.size)
            where = where[(order - np.maximum.accumulate(np.where(new_run, order, 0))) % 2 == 0]
            if self.unsafe[least].any():
                word = np.searchsorted(starts, where, side="right") - 1
                where = where[~self.unsafe[least[word]] | np.r_[True, word[1:] != word[:-1]]]
            symbols[where] = product[where]
            keep = np.ones(symbols.size, dtype=bool)
            keep[where + 1] = False
            symbols, owner, rank, product = symbols[keep], owner[keep], rank[keep], product[keep]
            moved = where - np.arange(where.size)
            near = np.r_[moved, moved[moved > 0] - 1]
            rank[near] = _NONE
            rank, product = self._pairs(symbols, owner, near[near < symbols.size - 1], rank, product)
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        owner, symbols = owner[order], symbols[order]
        raw = symbols >= (1 << 20)
        if raw.any():
            utf8 = {c: self.bytes_id[list(chr(c - (1 << 20)).encode("utf-8", "surrogatepass"))] for c in np.unique(symbols[raw]).tolist()}
            width = np.ones(symbols.size, dtype=np.int64)
            width[raw] = [len(utf8[c]) for c in symbols[raw].tolist()]
            out = np.repeat(symbols, width)
            begin = np.cumsum(width) - width
            for c, b in utf8.items():
                spots = begin[symbols == c]
                for k, v in enumerate(b):
                    out[spots + k] = v
            owner, symbols = np.repeat(owner, width), out
        bounds = (4 * np.searchsorted(owner, np.arange(count + 1))).tolist()
        raw_ids = symbols.astype("<u4").tobytes()
        return [raw_ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _long(self, word: str) -> bytes:
        """Ids of a long word: cut where nothing merges, short parts by rounds and long ones by a heap."""
        ids = np.array([self.single.get(c, -1) for c in word], dtype=np.int64)
        pair = ids[:-1] * self.base + ids[1:]
        row = np.minimum(np.searchsorted(self.inside, pair), self.inside.size - 1)
        cuts = np.flatnonzero((self.inside[row] != pair) | (ids[:-1] < 0) | (ids[1:] < 0)) + 1
        edges = [0, *cuts.tolist(), len(word)]
        parts = [word[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        short = list({p for p in parts if len(p) <= LONG_WORD})
        coded, begin, chars = {}, 0, 0
        for k, part in enumerate(short):
            chars += len(part)
            if chars >= BLOCK_CHARS or k == len(short) - 1:
                coded |= zip(short[begin : k + 1], self._rounds(short[begin : k + 1]), strict=True)
                begin, chars = k + 1, 0
        return b"".join([coded[p] if len(p) <= LONG_WORD else self._heaped(p) for p in parts])

    def _heaped(self, word: str) -> bytes:
        """Ids of a word of known characters, one merge at a time: least rank first, leftmost of equal ones."""
        if not self.merges:
            self.merges = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.product.tolist(), strict=True), strict=True))
        merges, base = self.merges, int(self.base)
        symbols = [self.single[c] for c in word]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, symbols[i], symbols[i + 1], m[1]) for i in range(n - 1) if (m := merges.get(symbols[i] * base + symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, product = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = product, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(product * base + symbols[k]):
                    heapq.heappush(heap, (m[0], i, product, symbols[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get(symbols[h] * base + product)):
                heapq.heappush(heap, (m[0], h, symbols[h], product, m[1]))
        return np.array([x for x in symbols if x >= 0], dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode new words in blocks of bounded size and put them into the cache."""
        for word in words:
            if len(word) > LONG_WORD:
                self.cache[word] = self._long(word)
        words = [w for w in words if len(w) <= LONG_WORD]
        begin, chars = 0, 0
        for k, word in enumerate(words):
            chars += len(word)
            if chars >= BLOCK_CHARS or k == len(words) - 1:
                block = words[begin : k + 1]
                self.cache.update(zip(block, self._rounds(block), strict=True))
                begin, chars = k + 1, 0

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, begin and end ids included, as little-endian unsigned 32-bit integers."""
        split = self.words.findall
        pieces = [split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = set().union(*pieces) if pieces else set()
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.cache.clear()
        self._learn([w for w in fresh if w not in self.cache])
        first, last = (np.array([i], dtype="<u4").tobytes() for i in (self.bos, self.eos))
        get = self.cache.__getitem__
        made = [first + b"".join(map(get, p)) + last for p in pieces]
        for word in fresh:  # long words would make the cache's size depend on the texts
            if len(word) > LONG_WORD:
                del self.cache[word]
        return made

    def decode(self, ids: bytes) -> str:
        """Text of ids given as little-endian unsigned 32-bit integers."""
        surface = self.surface
        raw = b"".join([surface[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        if raw[:1] == b" ":  # the mark that encoding put before the text
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)


def _lenient(raw: bytes) -> str:
    """Decode, each byte that is not part of a valid character becoming U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(raw[at : at + error.start].decode())
            out.append("�")
            at += error.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(model: str) -> PieceCodec:
    return PieceCodec(model)


def encode_decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, ids binary, n_tokens, decoded)``; ids as little-endian unsigned 32-bit integers."""

    def make():
        tool = codec(model)

        def work(texts: list[str]) -> dict:
            coded = tool.encode_batch(texts)
            return {"ids": coded, "n_tokens": [len(c) // 4 for c in coded], "decoded": [tool.decode(c) for c in coded]}

        return work

    return map_texts(df, {id_col: F.col(id_col)}, text_of(text_col), make, "ids binary, n_tokens long, decoded string")


def digests(df: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``; ids are hashed in the worker and never leave it."""

    def make():
        tool, sha = codec(model), hashlib.sha256

        def work(texts: list[str]) -> dict:
            coded = tool.encode_batch(texts)
            return {
                "n_tokens": [len(c) // 4 for c in coded],
                "ids_sha256": [sha(c).hexdigest() for c in coded],
                "decoded_sha256": [sha(tool.decode(c).encode()).hexdigest() for c in coded],
            }

        return work

    return map_texts(df, {"doc_id": F.col("doc_id")}, text_of(), make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(df: DataFrame, model: str, keep: dict, text_col: str = "text") -> DataFrame:
    """``keep`` plus ``n_tokens, ids`` and ``round_trip``: whether the ids decode to the text.

    They do unless the text holds the space mark itself, which decodes to a space.
    """

    def make():
        tool = codec(model)

        def work(texts: list[str]) -> dict:
            coded = tool.encode_batch(texts)
            return {"n_tokens": [len(c) // 4 for c in coded], "ids": coded, "round_trip": [tool.decode(c) == t for c, t in zip(coded, texts, strict=True)]}

        return work

    return map_texts(df, keep, text_of(text_col), make, "n_tokens long, ids binary, round_trip boolean")
