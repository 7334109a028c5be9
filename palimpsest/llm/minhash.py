"""MinHash near-dedup with an LSH forest.

A document is its set of word shingles. Documents with equal sets form one class, and only one
member of each goes on. A class's signature is laid out in several orders ("trees"); each tree
sorts all signatures, and the longest common prefix with the neighbours is known from the order.
A class's depth in a tree is the longest prefix that it shares with a neighbour there; those of
its ``NEAR`` predecessors that share almost as much (:data:`LOOSE` values less) and the shortest prefix
at least are its candidates, with the first class of its prefix. So crowded regions are matched
deep and sparse ones shallow without a setting. Sorting is by range, so a crowded prefix is
spread over tasks.

Candidates whose sizes or one-bit sketches rule the similarity out are dropped; all others are
compared on their full sets. The first round compares each class with its least candidate. After
each round the links found are joined to components, and what is still apart goes on: the
candidates themselves, and each class with the hubs of its candidate's component (the classes
with most links there), which finds the members of a large family of copies whose neighbours in
the trees are all just too far. These rounds end when one finds no new link.

That is only the fast start. Every prefix that still holds more than one component is then
compared in full: what isn't in its largest component, and the largest component, are each cut
into salted blocks, and each pair of blocks meets in a task. Rows for which sizes and sketches
leave a partner in another component possible get their full sets there, and intersections are
counted for all of them. Never pairs but only the links that join two components leave a task, at most one
for each row. So two classes of similarity 0.8 or more that share a prefix in any tree end in one
component, however crowded it is and wherever the ranges are cut.

The empty set (null or empty text, or only white space) is linked with nothing. Rows that share
an id each go by their own text; texts that share their least id are in one component. Rows
with a null id are returned, linked with nothing. An empty table gives an empty result. Texts
are read whole, whatever their length. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches, map_texts, stage, text_of, unstage
from palimpsest.llm.graph import extend

TREES = 20
#: Signature values that neighbours must share at least, and values that go on ordering them.
SHORTEST, DEEPER = 4, 8
#: Predecessors in an order that may become candidates, and values by which their common prefix may fall short of the longest.
NEAR, LOOSE = 2, 3
#: Hubs of a component.
HUBS = 8
SKETCH_BITS = 128
#: Sketch bits that may differ: 4.5 standard deviations beyond what similarity 0.8 gives.
SKETCH_SLACK = 28
#: Children of one parent that are compared by one task.
GROUP = 500
#: Rows and shingles of one prefix that are at home in one block, on average.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
#: A class of more members than this is dealt to as many tasks as :data:`SALTS` when its members look it up.
HOT_CLASS, SALTS = 1000, 64
_CACHE_WORDS = 100_000
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (wrapping arithmetic)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Shingler:
    """Sets of shingles as sorted arrays of 64-bit hashes; word hashes are cached."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        # bytes.lower and bytes.split know ASCII only, as the contract does
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=_U)
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=_U, count=len(words))
        if len(known) > _CACHE_WORDS:
            known.clear()
        k = min(self.words, len(words))
        n = len(words) - k + 1
        out = np.full(n, _U(k))
        for i in range(k):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
        return np.unique(out)


def _signer(words: int):
    rng = np.random.default_rng(20_240_601)
    count = TREES * SHORTEST
    times = rng.integers(1, 1 << 62, count, dtype=_U) * _U(2) + _U(1)
    plus = rng.integers(0, 1 << 62, count, dtype=_U)
    s_times = rng.integers(1, 1 << 62, SKETCH_BITS, dtype=_U) * _U(2) + _U(1)
    s_plus = rng.integers(0, 1 << 62, SKETCH_BITS, dtype=_U)
    times, plus = np.r_[times, s_times], np.r_[plus, s_plus]
    shingle = Shingler(words)
    room = np.empty((128, times.size), dtype=_U)  # fits the processor's cache
    shifts = (_U(16) * np.arange(4, dtype=_U))[None, :]

    def sign(text: str):
        got = shingle(text)
        if not got.size:
            return 0, 0, 0, None, None
        least = np.full(times.size, _U(0xFFFFFFFFFFFFFFFF))
        for at in range(0, got.size, len(room)):
            part = got[at : at + len(room)]
            made = room[: part.size]
            np.multiply(part[:, None], times, out=made)
            made += plus
            np.minimum(least, made.min(axis=0), out=least)
        values = _mix(least)
        sig, sketch = values[:count], np.packbits((values[count:] & _U(1)).astype(np.uint8)).tobytes()
        folded = np.zeros(TREES, dtype=_U)
        for i in range(SHORTEST):
            folded = _mix(folded * _U(0x9E3779B97F4A7C15) + sig[i::SHORTEST])
        # the values that follow a tree's own go on ordering it
        follow = (np.arange(TREES)[:, None] * SHORTEST + SHORTEST + np.arange(DEEPER)) % count
        deep = (sig[follow] & _U(0xFFFF)).reshape(TREES, -1, 4)
        packed = (deep << shifts).sum(axis=2, dtype=_U)
        order = np.concatenate([folded[:, None], packed], axis=1)
        return got.size, int(_mix(got).sum(dtype=_U).astype(np.int64)), int(_mix(got ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U).astype(np.int64)), order.astype(np.int64).ravel(), sketch

    return sign


def signatures(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n, h1, h2`` (128-bit hash of the set), ``orders`` (per tree: prefix and the values after it), ``sketch``."""

    def make():
        sign = _signer(words)

        def work(texts: list[str]) -> dict:
            rows = [sign(t) for t in texts]
            return {"n": [r[0] for r in rows], "h1": [r[1] for r in rows], "h2": [r[2] for r in rows], "orders": [r[3] for r in rows], "sketch": [r[4] for r in rows]}

        return work

    return map_texts(docs, {key: F.col(key)}, text_of(text), make, "n long, h1 long, h2 long, orders array<long>, sketch binary")


def common_prefix(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Values of the order that rows share from its start: the folded prefix first, then 16 bits each."""
    out = np.where(a[0] == b[0], SHORTEST, 0)
    open_ = out > 0
    for x, y in zip(a[1:], b[1:], strict=True):
        apart = x.view(_U) ^ y.view(_U)
        same = (apart < _U(1 << 48)).astype(np.int64) + (apart < _U(1 << 32)) + (apart < _U(1 << 16)) + (apart == 0)
        out = out + np.where(open_, same, 0)
        open_ &= same == 4
    return out


def candidates(classes: DataFrame, partitions: int) -> DataFrame:
    """Distinct pairs ``a < b`` of class ids that are neighbours in a tree."""
    width = 1 + DEEPER // 4
    tree = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.slice("orders", t * width + 1, F.lit(width)))).alias("tree", "order")
    rows = classes.select("id", "n", "sketch", tree)
    rows = rows.select(F.col("tree").cast("int").alias("tree"), *[F.get("order", F.lit(i)).alias(f"o{i}") for i in range(width)], "id", "n", "sketch")
    order = ["tree", *[f"o{i}" for i in range(width)], "id"]

    def neighbours(batches):
        import pyarrow as pa

        held = None  # the last NEAR rows and the first row of the open prefix
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sketch")).to_pylist()), dtype=_U).reshape(-1, SKETCH_BITS // 64)
            rows = [_column(batch, c) for c in ("tree", "id", "n", *[f"o{i}" for i in range(width)])] + [sketch]
            fresh = 0
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
                fresh = len(held[0])
            tree, ids, n, *order_, sketch = rows
            size = len(ids)
            place = np.arange(size)
            shared = common_prefix([o[1:] for o in order_], [o[:-1] for o in order_]) * (tree[1:] == tree[:-1])
            before = np.r_[0, shared]  # with the row before
            first = np.maximum.accumulate(np.where(before == 0, place, 0))
            deepest = np.maximum(before, np.r_[shared, 0])
            least, reached = np.maximum(SHORTEST, deepest - LOOSE), before
            left, right = [], []
            for j in range(1, NEAR + 2):
                # the last turn takes the first row of the prefix instead of a neighbour
                if j <= NEAR:
                    other, ok = place - j, (place >= j) & (reached >= least)
                    # the common prefix with the row one further back is the least on the way
                    reached = np.minimum(reached, np.r_[np.zeros(min(j, size), dtype=np.int64), before[: max(0, size - j)]])
                else:
                    other, ok = first, first != place
                ok &= place >= fresh
                x, y = place[ok], other[ok]
                small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                ok = (100 * small >= 80 * large) & (np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1) <= SKETCH_SLACK) & (ids[x] != ids[y])
                left.append(np.minimum(ids[x], ids[y])[ok])
                right.append(np.maximum(ids[x], ids[y])[ok])
            keep = np.unique(np.r_[first[-1], place[-NEAR:]])
            keep = keep[keep >= first[-1]]
            held = [r[keep] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    placed = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return placed.mapInArrow(neighbours, "a long, b long").distinct()


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``id, set`` (sorted 64-bit shingle hashes) of ``texts`` (``id, text``)."""

    def make():
        shingle = Shingler(words)
        return lambda found: {"set": [shingle(t).tobytes() for t in found]}

    return map_texts(texts, {"id": F.col("id")}, text_of("text"), make, "set binary")


def _column(batch, name: str) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)))


def _sketches(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=_U).reshape(-1, SKETCH_BITS // 64)


def _groups(batches, keys: list[str]):
    """Tables of the rows of sorted batches that have equal ``keys``, one after another."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([_column(batch, k).astype(np.int64) for k in keys], axis=1)
        cuts = np.r_[0, np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1, len(values)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if last is not None and not np.array_equal(values[a], last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield pa.Table.from_batches(held)


def shared_prefixes(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``tree, prefix, id, n, sketch, all, component``: each class in each tree whose prefix it shares with another; ``all`` are its prefixes by tree.

    Most prefixes have one class. Only keys move until they are out.
    """
    width = 1 + DEEPER // 4
    all_ = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.get("orders", t * width))
    keys = classes.select(F.posexplode(all_).alias("tree", "prefix"), "id")
    several = keys.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("tree", "prefix")
    rows = keys.join(several.hint("merge"), ["tree", "prefix"], "left_semi")
    known = classes.select("id", "n", "sketch", all_.alias("all"))
    placed = rows.join(known.hint("merge"), "id").join(found.hint("merge"), F.col("id") == F.col("node"), "left")
    return placed.select("tree", "prefix", "id", "n", "sketch", "all", F.coalesce("component", "id").alias("component"))


GROUP_KEYS = ["tree", "prefix", "i", "j"]


def crowded(placed: DataFrame) -> DataFrame:
    """``tree, prefix, i, j, side, id, n, sketch, all, component``: the rows (of :func:`shared_prefixes`) whose prefix holds several components, in each pair of blocks that has theirs.

    Blocks of rows outside the prefix's largest component are numbered from 0 and meet each
    other and the blocks of the largest one, numbered from -1 downwards; ``side`` is a row's own.
    """
    sizes = placed.groupBy("tree", "prefix", "component").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_s"))
    split = sizes.groupBy("tree", "prefix").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.max(F.struct("_n", "component", "_s")).alias("_top"), F.count(F.lit(1)).alias("_apart")).filter("_apart > 1")
    parts = lambda n, shingles: F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    split = split.select("tree", "prefix", F.col("_top.component").alias("_main"), parts(F.col("_top._n"), F.col("_top._s")).alias("_mains"), parts(F.col("_n") - F.col("_top._n"), F.col("_s") - F.col("_top._s")).alias("_loose"))
    dealt = placed.join(split.hint("merge"), ["tree", "prefix"]).withColumn("_apart", F.col("component") != F.col("_main"))
    side = F.when(F.col("_apart"), F.pmod(F.hash("id"), F.col("_loose"))).otherwise(-1 - F.pmod(F.hash("id"), F.col("_mains")))
    dealt = dealt.withColumn("side", side.cast("int"))
    others = F.sequence(F.lit(0), F.col("_loose") - 1)
    meets = F.when(
        F.col("_apart"),
        F.concat(
            F.transform(others, lambda j: F.struct(F.least(F.col("side"), j).alias("i"), F.greatest(F.col("side"), j).alias("j"))),
            F.transform(F.sequence(F.lit(0), F.col("_mains") - 1), lambda k: F.struct(F.col("side").alias("i"), (-1 - k).alias("j"))),
        ),
    ).otherwise(F.transform(others, lambda i: F.struct(i.alias("i"), F.col("side").alias("j"))))
    return dealt.select("tree", "prefix", F.explode(meets).alias("_meet"), "side", "id", "n", "sketch", "all", "component").select("tree", "prefix", "_meet.i", "_meet.j", "side", "id", "n", "sketch", "all", "component")


def possible(rows: DataFrame, partitions: int) -> DataFrame:
    """Those of ``rows`` (of :func:`crowded`) that sizes and sketches leave a partner in another component, without the sketch.

    A pair counts in the first tree only where it shares a prefix.
    """

    def compare(batches):
        import pyarrow as pa

        for rows_ in _groups(batches, GROUP_KEYS):
            size = rows_.num_rows
            n, component, side = (rows_.column(c).to_numpy() for c in ("n", "component", "side"))
            signs, touched = _sketches(rows_), np.zeros(size, dtype=bool)
            earlier = rows_.column("all").combine_chunks().flatten().to_numpy().reshape(size, TREES)[:, : rows_.column("tree")[0].as_py()]
            own_block = bool(rows_.column("i")[0].as_py() == rows_.column("j")[0].as_py())
            loose = np.flatnonzero(side >= 0)
            step = max(1, 100_000 // max(1, size))
            for at in range(0, len(loose), step):
                x = loose[at : at + step, None]
                ok = component[x] != component[None, :]
                if not own_block:
                    ok &= side[x] != side[None, :]
                ok &= (100 * n[x] >= 80 * n[None, :]) & (100 * n[None, :] >= 80 * n[x])
                a, b = np.nonzero(ok)
                a = loose[at + a]
                ok = np.bitwise_count(signs[a] ^ signs[b]).sum(axis=1) <= SKETCH_SLACK
                a, b = a[ok], b[ok]
                ok = ~(earlier[a] == earlier[b]).any(axis=1)
                touched[a[ok]] = touched[b[ok]] = True
            if touched.any():
                kept = rows_.filter(pa.array(touched)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([kept.column(kept.schema.get_field_index(c)) for c in (*GROUP_KEYS, "side", "id", "component")], names=[*GROUP_KEYS, "side", "id", "component"])

    placed = rows.repartition(partitions, *GROUP_KEYS).sortWithinPartitions(*GROUP_KEYS)
    return placed.mapInArrow(compare, "tree int, prefix long, i int, j int, side int, id long, component long")


def joining_links(rows: DataFrame, sets: DataFrame, partitions: int) -> DataFrame:
    """Links ``a < b`` that join the components of each group of ``rows`` (of :func:`possible`) as far as the full ``sets`` (``id, set``) allow."""

    def compare(batches):
        import pyarrow as pa

        for rows_ in _groups(batches, GROUP_KEYS):
            ids, component, side = (rows_.column(c).to_numpy() for c in ("id", "component", "side"))
            own_block = bool(rows_.column("i")[0].as_py() == rows_.column("j")[0].as_py())
            sets_ = [np.frombuffer(v.as_buffer(), dtype=_U) for chunk in rows_.column("set").chunks for v in chunk]
            n = np.array([len(v) for v in sets_])
            _, shingle = np.unique(np.concatenate(sets_), return_inverse=True)
            holder = np.repeat(np.arange(len(ids)), n)[np.argsort(shingle, kind="stable")]
            many = np.bincount(shingle)
            first, begin = np.cumsum(many) - many, np.cumsum(n) - n
            _, label = np.unique(component, return_inverse=True)
            left, right = [], []
            for x in np.flatnonzero(side >= 0).tolist():
                other = label != label[x]
                if not own_block:
                    other &= side != side[x]
                if not n[x] or not other.any():
                    continue
                mine = shingle[begin[x] : begin[x] + n[x]]
                count = many[mine]
                spots = np.arange(int(count.sum())) + np.repeat(first[mine] - (np.cumsum(count) - count), count)
                both = np.bincount(holder[spots], minlength=len(ids))
                for y in np.flatnonzero(other & (100 * both >= 80 * (n[x] + n - both)) & (ids != ids[x])).tolist():
                    if label[y] != label[x]:
                        left.append(min(ids[x], ids[y]))
                        right.append(max(ids[x], ids[y]))
                        label[label == label[y]] = label[x]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    armed = rows.join(sets.hint("merge"), "id")
    placed = armed.repartition(partitions, *GROUP_KEYS).sortWithinPartitions(*GROUP_KEYS)
    return placed.mapInArrow(compare, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, partitions: int) -> DataFrame:
    """The pairs whose full sets have similarity 0.8 or more; ``sets`` has ``id, set``.

    Each task gets a parent's set once, then its children one after another. A parent with
    many children is given to several tasks.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_m")).select("a", F.ceil(F.col("_m") / GROUP).cast("int").alias("_parts"))
    dealt = pairs.join(many, "a").withColumn("_part", F.pmod(F.hash("b"), F.col("_parts"))).select("a", "b", "_part")
    # Sorted joins at every size: what is small here isn't small for certain on larger inputs.
    sets = sets.hint("merge")
    children = dealt.join(sets, dealt["b"] == sets["id"]).select("a", "_part", F.lit(1).alias("_child"), "b", "set")
    parents = dealt.select("a", "_part").distinct().join(sets, F.col("a") == sets["id"]).select("a", "_part", F.lit(0).alias("_child"), F.col("a").alias("b"), "set")
    rows = children.unionByName(parents).repartition(partitions, "a", "_part").sortWithinPartitions("a", "_part", "_child", "b")

    def compare(batches):
        import pyarrow as pa

        group, held = None, []
        for batch in batches:
            left, right = [], []
            for a, part, child, b, got in zip(*(_column(batch, c).tolist() for c in ("a", "_part", "_child", "b")), batch.column(4), strict=True):
                got = np.frombuffer(got.as_buffer(), dtype=_U)
                if not child:
                    if group != (a, part):
                        group, held = (a, part), []
                    held.append(got.copy())
                    continue
                for s in held:
                    both = int(np.count_nonzero(s[np.minimum(np.searchsorted(s, got), s.size - 1)] == got)) if s.size else 0
                    if both and 100 * both >= 80 * (s.size + got.size - both):
                        left.append(a)
                        right.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def cluster(docs: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept``: one row for each row of ``docs``."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bound_batches(spark)
    plain = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))
    signed = stage(signatures(plain, words, "id"), "signed")
    # Equal sets form a class; its least id stands for it.
    names = ["n", "h1", "h2"]
    sets = signed.filter("id is not null and n > 0")
    classes = sets.groupBy(*names).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_members"))
    chosen = sets.join(classes.withColumnsRenamed({c: f"_{c}" for c in names}), (F.col("id") == F.col("rep")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n") == F.col("_n"))).select("id", "n", "sketch", "orders")
    chosen = stage(chosen, "chosen")
    pairs = stage(candidates(chosen, partitions), "pairs")
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets_of = lambda nodes: stage(shingle_sets(plain.filter("id is not null").join(nodes.hint("merge"), "id", "left_semi"), words), "sets")
    full = sets_of(nodes)
    wanted = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = tried = found = None
    apart, depth = pairs, 0
    while True:
        asked = stage(wanted, "asked")
        new = stage(confirmed(asked, full, partitions), "links")
        fresh = new.limit(1).count() > 0
        tried = asked if tried is None else tried.unionByName(asked)
        links = new if links is None else links.unionByName(new)
        if not fresh and depth == HUBS:
            break
        depth = HUBS if depth or not fresh else 1
        if fresh or found is None:
            old, found = found, stage(extend(found, new), "components")
            if old is not None:
                unstage(old)
        ends = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("_links"))
        # the rank's limit is applied within tasks before rows are dealt by component
        top = Window.partitionBy("component").orderBy(F.desc("_links"), "node")
        hubs = stage(found.join(ends, "node").withColumn("_rank", F.row_number().over(top)).filter(F.col("_rank") <= depth).select("component", F.col("node").alias("hub")), "hubs")
        side = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        apart = stage(apart.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").filter("coalesce(ca, a) <> coalesce(cb, b)"), "apart")
        seen = apart.select(F.col("a").alias("x"), F.col("cb").alias("component")).unionAll(apart.select(F.col("b").alias("x"), F.col("ca").alias("component"))).filter("component is not null").distinct()
        hubbed = seen.join(hubs, "component").select(F.least("x", "hub").alias("a"), F.greatest("x", "hub").alias("b"))
        every = apart.select("a", "b").unionAll(hubbed).distinct()
        wanted = every.join(tried, ["a", "b"], "left_anti")
    # What is still apart in a shared prefix is compared there.
    shared = stage(shared_prefixes(chosen, found), "shared")
    near = stage(possible(crowded(shared), partitions), "possible")
    unstage(shared)
    rest = sets_of(near.select("id").distinct())
    new = stage(joining_links(near, rest, partitions), "links")
    if new.limit(1).count():
        old, found = found, stage(extend(found, new), "components")
        unstage(old)
    of_class = classes.join(found, classes["rep"] == found["node"], "left").select(*[F.col(c).alias(f"_{c}") for c in names], F.coalesce("component", "rep").alias("_component"), "_members")
    whole = _looked_up(signed.select("id", *names), of_class, names)
    component = F.when(F.col("id").isNotNull(), F.coalesce("_component", "id"))
    for used in (pairs, full, near, rest, chosen):
        unstage(used)
    return whole.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _looked_up(rows: DataFrame, of_class: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the ``_component`` of their class; members of large classes look it up under a salt, so that no task gets them all."""
    same = lambda r: [F.col(c) == F.col(f"{r}{c}") for c in names]
    large = of_class.filter(F.col("_members") > HOT_CLASS).select(*[F.col(f"_{c}").alias(f"_l{c}") for c in names], F.col("_component").alias("_large"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_lsalt"))
    salted = rows.withColumn("_salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(large.hint("merge"), [*same("_l"), F.col("_salt") == F.col("_lsalt")], "left")
    # what has its component already, or an empty set, looks for a class that there isn't, each row another one
    gone = F.col("_large").isNotNull() | (F.col("n") == 0)
    asked = salted.select("id", *names, "_large", *[F.when(gone, F.lit(-1) if c == "n" else F.xxhash64("id", F.lit(c))).otherwise(F.col(c)).alias(f"_a{c}") for c in names])
    small = of_class.filter(F.col("_members") <= HOT_CLASS)
    joined = asked.join(small.hint("merge"), [F.col(f"_a{c}") == F.col(f"_{c}") for c in names], "left")
    return joined.select("id", *names, F.coalesce("_large", "_component").alias("_component"))
