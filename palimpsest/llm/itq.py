"""Embedding near-dedup: iterative quantisation codes, multi-index Hamming tables, exact reranking.

A rotation of the centred vectors is learned so that the signs of the rotated coordinates are
balanced binary codes (iterative quantisation: alternate the codes and the orthogonal matrix
closest to them), on at most :data:`SAMPLE_ROWS` vectors chosen by hash. All vectors are
indexed: a code is cut into ``TABLES`` parts, and each part is filed under itself and under
every value one bit away, so two vectors meet in a table when their parts differ in two bits at
most. Those that meet, whose whole codes differ in :data:`RADIUS` bits at most and whose signs
at :data:`SKETCH_BITS` random planes differ in no more places than cosine 0.9 can explain, are
compared by cosine in double precision on the original vectors.

Only vectors of equal length are compared. Each of the :data:`TRAINED` most common lengths
learns its own rotation; the others are coded by a random one, which finds as much but fills its
tables less evenly. Vectors are scaled by their largest component before their norm is taken,
so that very large and very small ones neither overflow nor vanish.

Equal vectors form one class with one member in the tables. A bucket is compared in
blocks of :data:`BLOCK` members, each pair of blocks by a task of its own, so no bucket is ever in
one task's memory whole; only counts and one link for each member leave a task, never all
pairs. A pair that meets more than once is counted at its first meeting only.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and
are returned. Rows with the same id are returned each; a link of one links all. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches, stage, unstage
from palimpsest.llm.graph import components

SAMPLE_ROWS = 10_000
ROUNDS = 30
TABLES = 4
#: Bits of a part at most; parts are as wide as that or as the code allows.
PART_BITS = 16
RADIUS = 20
#: Lengths that learn a rotation of their own.
TRAINED = 8
#: Planes of the sketch; at cosine 0.9 a sign differs with probability 0.1435, so 27.6 in the mean with deviation 4.9.
SKETCH_BITS, SKETCH_RADIUS = 192, 50
BLOCK = 512
#: Pairs that a task compares at once.
PAIRS = 1_000_000
THRESHOLD = 0.9


def learn(x: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions by bits) of the codes ``(x - mean) @ projection > 0``."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    centred = x - mean
    if len(x) > bits:
        _, vectors = np.linalg.eigh(centred.T @ centred)
        basis = vectors[:, ::-1][:, :bits]
    else:
        basis = np.eye(x.shape[1])[:, :bits]
    v = centred @ basis
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((basis.shape[1],) * 2))[0]
    for _ in range(rounds if len(x) > bits else 0):
        codes = np.where(v @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ v)
        rotation = (left @ right).T
    return mean, basis @ rotation


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; their scale neither overflows nor vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def planes(dims: int) -> np.ndarray:
    """The sketch's random planes for vectors of this length."""
    return np.random.default_rng([11, dims]).standard_normal((dims, SKETCH_BITS))


def sketch(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Signs at the planes, as bytes of rows."""
    return np.packbits(x @ by > 0, axis=1)


def plain(dims: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean zero and a random orthogonal projection, for lengths that learn none."""
    bits = min(64, dims)
    return np.zeros(dims), np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, bits)))[0]


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as unsigned 64-bit integers; bit i is the sign of rotated coordinate i."""
    signs = ((x - mean) @ projection > 0).astype(np.uint64)
    return (signs << np.arange(signs.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _parts(bits: int) -> list[tuple[int, int]]:
    """Shift and width of each table's part of the code."""
    tables = min(TABLES, max(1, bits))
    edges = [round(i * bits / tables) for i in range(tables + 1)]
    return [(a, min(PART_BITS, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def _part(codes: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (codes >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def first_meeting(a: np.ndarray, b: np.ndarray, table: np.ndarray, key: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """Whether ``key`` of ``table`` is where each pair of codes meets first."""
    out, before = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=bool)
    for t, (shift, width) in enumerate(parts):
        x, y = _part(a, shift, width), _part(b, shift, width)
        delta = x ^ y
        apart = np.bitwise_count(delta)
        low = delta & (~delta + np.uint64(1))
        lowest = np.where(apart == 2, np.minimum(x ^ low, y ^ low), np.minimum(x, y))
        met = apart <= 2
        out |= (table == t) & met & ~before & (lowest == key)
        before |= met
    return out


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (at, to) of all pairs within consecutive groups of these sizes."""
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    left = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(starts, sizes)) - 1
    at = np.repeat(np.arange(n), left)
    begin = np.cumsum(left) - left
    return at, at + 1 + np.arange(len(at)) - np.repeat(begin, left)


def _by_group(batches, names: list[str], work):
    """Feed whole groups (equal columns ``names`` of sorted rows) to ``work``, about PAIRS pairs and one length of vectors at a time."""
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([held.column(c).to_numpy().astype(np.int64) for c in names], axis=1)
        if not len(keys):
            continue
        cuts = np.r_[0, np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1]
        done = int(cuts[-1])
        if done:
            yield from _chunks(held.slice(0, done), np.diff(cuts), keys[cuts[:-1], 0], work)
            held = held.slice(done)
    if held is not None and held.num_rows:
        yield from _chunks(held, np.array([held.num_rows]), np.zeros(1), work)


def _chunks(rows, sizes: np.ndarray, lengths: np.ndarray, work):
    at = first = 0
    weight = np.cumsum(sizes * sizes)
    changes = np.r_[np.flatnonzero(np.diff(lengths)) + 1, len(sizes)]
    while first < len(sizes):
        base = weight[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(weight, base + 2 * PAIRS, side="right")))
        last = min(last, int(changes[np.searchsorted(changes, first, side="right")]))
        n = int(sizes[first:last].sum())
        if (out := work(rows.slice(at, n), sizes[first:last])) is not None:
            yield out
        at, first = at + n, last


def _models(good: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and projection of the most common lengths, each learned on a bounded sample."""
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(TRAINED).collect()
    out = {}
    for d, total in common:
        chosen = good.filter(F.size("v") == d).select("v", F.pmod(F.xxhash64("v"), F.lit(1 << 30)).alias("p"))
        chosen = chosen.filter(F.col("p") < int(min(1.0, SAMPLE_ROWS / total) * (1 << 30)) + 1).select("v").distinct().limit(2 * SAMPLE_ROWS)
        x = np.asarray(chosen.toArrow().column("v").combine_chunks().flatten(), dtype=float).reshape(-1, d)
        out[d] = learn(unit(x), min(64, d)) if len(x) > min(64, d) else plain(d)
    return out


def similar(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``key, n_links, component_id, kept``: one row for each row of ``vectors``."""
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bound_batches(spark)
    rows = vectors.select(F.col(key).alias("id"), F.transform(F.col(vector), lambda c: c.cast("double")).alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    good = rows.filter(usable).withColumn("h", F.xxhash64("v"))
    # Equal vectors are one class; its least id stands for it.
    classes = stage(good.groupBy("h", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")), "vectors")
    models = _models(classes)

    def coded(batches):
        import pyarrow as pa

        rest: dict = {}
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(np.asarray(column.offsets))
            flat, begin = np.asarray(column.flatten()), np.cumsum(sizes) - sizes
            code, units = np.zeros(len(sizes), dtype=np.int64), [b""] * len(sizes)
            signs = np.zeros((len(sizes), SKETCH_BITS // 8), dtype=np.uint8)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = unit(flat[begin[at][:, None] + np.arange(d)])
                if d not in rest:
                    rest[d] = (*(models.get(d) or plain(d)), planes(d))
                mean, projection, by = rest[d]
                code[at] = encode(x, mean, projection).view(np.int64)
                signs[at] = sketch(x, by)
                for i, u in zip(at.tolist(), x, strict=True):
                    units[i] = u.tobytes()
            made = [batch.column(0), batch.column(3), batch.column(2), pa.array(sizes, pa.int32()), pa.array(code), pa.array([s.tobytes() for s in signs], pa.binary()), pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["rep", "h", "m", "d", "code", "s", "u"])

    codes = stage(classes.select("rep", "v", "m", "h").mapInArrow(coded, "rep long, h long, m long, d int, code long, s binary, u binary"), "codes")
    by_bits = {bits: _parts(bits) for bits in range(1, 65)}

    # A class is filed under its part and every value one bit away.
    def keys(table: int, shift: int, width: int):
        part = F.shiftrightunsigned("code", shift).bitwiseAND(F.lit((1 << width) - 1))
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(width)])
        return F.transform(flips, lambda flip: F.struct(F.lit(table).alias("t"), part.bitwiseXOR(flip).alias("k")))

    widths = sorted(r["b"] for r in codes.select(F.least("d", F.lit(64)).alias("b")).distinct().collect())  # 64 at most
    every = F.lit(None)
    for bits in widths:
        every = F.when(F.least("d", F.lit(64)) == bits, F.concat(*[keys(t, *p) for t, p in enumerate(by_bits[bits])])).otherwise(every)
    # (a repeated id may stand for several classes, so the vector's hash names a class here)
    filed = codes.select("h", "d", "code", "s", F.explode(every if widths else F.expr("cast(null as array<struct<t:int,k:bigint>>)")).alias("_f")).select("h", "d", "code", "s", "_f.*")
    blocks = filed.groupBy("d", "t", "k").count().filter("count > 1").select("d", "t", "k", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # Block i meets each block j >= i: members go to every pair of blocks that has theirs.
    own = F.pmod(F.col("h"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    group = ["d", "t", "k", "i", "j"]
    dealt = filed.join(blocks, ["d", "t", "k"]).withColumn("own", own).withColumn("_meet", F.explode(meets)).select("d", "t", "k", F.col("_meet.i").alias("i"), F.col("_meet.j").alias("j"), "own", "h", "code", "s")

    def near(rows, sizes):
        """Pairs of rows that meet here first and whose codes and sketches are near."""
        dims, table, key, i, j, own = (rows.column(c).to_numpy() for c in (*group, "own"))
        code = rows.column("code").to_numpy().view(np.uint64)
        at, to = _pairs(sizes)
        keep = (np.bitwise_count(code[at] ^ code[to]) <= RADIUS) & ((i == j)[at] | (own[at] != own[to]))
        at, to = at[keep], to[keep]
        signs = np.frombuffer(b"".join(rows.column("s").to_pylist()), dtype=np.uint64).reshape(-1, SKETCH_BITS // 64)
        keep = np.bitwise_count(signs[at] ^ signs[to]).sum(axis=1) <= SKETCH_RADIUS
        at, to = at[keep], to[keep]
        keep = first_meeting(code[at], code[to], table[at], key[at].astype(np.uint64), by_bits[min(64, int(dims[0]))])
        return at[keep], to[keep]

    def touched(batches):
        """Members that have a near partner in their group; only these need their vectors there."""

        def work(rows, sizes):
            at, to = near(rows, sizes)
            return rows.take(np.union1d(at, to)).combine_chunks().to_batches()[0] if len(at) else None

        yield from _by_group(batches, group, work)

    columns = "d int, t int, k long, i int, j int, own int, h long, code long, s binary"
    spread = lambda df: df.repartition(partitions, *group).sortWithinPartitions(*group, "h")
    wanted = stage(spread(dealt).mapInArrow(touched, columns), "wanted")

    def compare(batches):
        """For each member its links and one row that joins it to its component in the group."""
        import pyarrow as pa

        def work(rows, sizes):
            at, to = near(rows, sizes)
            u = np.frombuffer(b"".join(rows.column("u").to_pylist()), dtype=np.float64).reshape(rows.num_rows, -1)
            linked = [np.einsum("ij,ij->i", u[at[s : s + 50_000]], u[to[s : s + 50_000]]) >= threshold for s in range(0, len(at), 50_000)]
            if not linked:
                return None
            linked = np.concatenate(linked)
            at, to = at[linked], to[linked]
            rep, m = rows.column("rep").to_numpy(), rows.column("m").to_numpy()
            n = np.zeros(len(rep), dtype=np.int64)
            np.add.at(n, at, m[to])
            np.add.at(n, to, m[at])
            label = np.arange(len(rep))
            while True:
                new = label.copy()
                np.minimum.at(new, at, label[to])
                np.minimum.at(new, to, label[at])
                if (new == label).all():
                    break
                label = new
            got = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(rows.column("h").to_numpy()[got]), pa.array(rep[got]), pa.array(n[got]), pa.array(rep[label[got]])], names=["h", "rep", "n", "to"]) if len(got) else None

        yield from _by_group(batches, group, work)

    armed = wanted.join(codes.select("h", "rep", "m", "u"), "h").select(*group, "own", "h", "rep", "code", "s", "m", "u")
    met = stage(spread(armed).mapInArrow(compare, "h long, rep long, n long, to long"), "met")
    degree = met.groupBy("h").agg(F.sum("n").alias("n"))
    joined = components(met.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    of_class = classes.select("h", "v", "rep", "m").join(degree, "h", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("h", "v", F.coalesce("component", "rep").alias("c"), (F.coalesce("n", F.lit(0).cast("long")) + F.col("m") - 1).alias("n_links"))
    linked = good.join(of_class, ["h", "v"]).select("id", F.col("n_links"), "c")
    alone = rows.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("c"))
    unstage(wanted)
    unstage(codes)
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))
