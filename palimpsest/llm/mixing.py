"""Mixing sources to target weights by Efraimidis-Spirakis sampling [native].

Sources get weights; each source's target is its share of all words, but at most
:data:`MOST_EPOCHS` times its own size; what is cut off is shared again by weight until no
target is above that. A source's target is met by complete epochs first. The rest is taken from
a weighted sample without replacement: every document gets the key ``-ln(u) / quality`` with u
from a hash of its id and text, and documents are taken in order of their keys until the words
left over are used up; of the last one only the words still needed are counted.

Nothing of a source meets in one task: a document's key decides one of many buckets, bucket
totals are prefix-summed within the source, and only inside a bucket are documents ordered.
Everything is DataFrame functions; no Python runs on the executors.

Null text has size 0 and is never taken. The null source is a source of its own, ordered last.
Rows that repeat share a key and are ordered by nothing else, so which of them is the last one
taken doesn't matter; each is a document of its own. An empty table gives an empty mix.
Other columns are kept out of the result, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, stage, text_of

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Documents that one bucket of a source holds on average.
BUCKET_ROWS = 5_000
SEED = "mix-1"
JUNK = r"[0-9#$%&*|<>{}=~^@\\]"


def quality_weight(text: Column) -> Column:
    """Sampling weight of a document: 1 for plain prose, less the more junk characters it holds."""
    return 1.0 / (1.0 + 20.0 * F.regexp_count(text, F.lit(JUNK)).cast("double") / F.greatest(F.lit(1), F.length(text)).cast("double"))


def uniform(key: Column, text: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a hash."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(key.cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``_source, source_size, target`` for each source of ``sized`` (``_source``, ``size``).

    Sharing again until none is above its limit ends at targets ``min(limit, level * weight)``.
    With sources sorted by limit per weight, the level follows from running sums.
    """
    per = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    # One row for each source from here on.
    by_name = Window.orderBy("_source")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    per = per.withColumn("_w", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    per = per.withColumn("_limit", F.col("source_size") * MOST_EPOCHS)
    tight = Window.orderBy(F.col("_limit") / F.col("_w"), "_source")
    every = Window.partitionBy()
    per = per.withColumn("_cut", F.coalesce(F.sum("_limit").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("_open", F.sum("_w").over(tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("_level", (F.sum("source_size").over(every) - F.col("_cut")).cast("double") / F.col("_open").cast("double"))
    # The first source whose limit the level doesn't pass sets the level for all that follow.
    free = F.col("_level") * F.col("_w") <= F.col("_limit")
    per = per.withColumn("_final", F.min(F.when(free, F.struct(F.col("_limit") / F.col("_w"), F.col("_level").alias("level")))).over(every)["level"])
    target = F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_limit").cast("double")))
    return per.select("_source", "source_size", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, carry: dict[str, Column] | None = None) -> DataFrame:
    """``key, size, source_size, target, taken, copies`` and the carried columns, one row for each row of ``docs``.

    ``taken`` counts words, repeats included; ``copies`` is the number of whole copies, the last
    one rounded.
    """
    carry = carry or {}
    body = text_of(text)
    sized = docs.select(
        F.col(key).alias("_key"),
        # never null, and in the order of sources with null last
        F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string"))).alias("_source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        (-F.log(uniform(F.col(key), body)) / quality_weight(body)).alias("_order"),
        *[c.alias(f"_carry_{n}") for n, c in carry.items()],
    )
    # Words are counted once for everything that needs no carried column.
    narrow = stage(sized.select("_key", "_source", "size", "_order"), "sizes")
    targets = source_targets(narrow.select("_source", "size"), weights)
    total = narrow.count()
    buckets = max(16, total // BUCKET_ROWS)
    # exp(-key) falls as the key grows and fills (0, 1) about evenly
    bucket = F.least(F.lit(buckets - 1), F.floor((1.0 - F.exp(-F.col("_order"))) * buckets)).cast("long")
    rows = (sized if carry else narrow).withColumn("_bucket", bucket)
    sums = narrow.withColumn("_bucket", bucket).groupBy("_source", "_bucket").agg(F.sum("size").alias("_in"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0).cast("long"))).drop("_in")
    sums = sums.join(targets, "_source")
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_upto", F.sum("size").over(within))
    # dealt by source and bucket already, so only the sums move
    joined = rows.join(sums, ["_source", "_bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - (F.col("_before") + F.col("_upto") - F.col("size"))))
    taken = epochs * F.col("size") + part
    copies = epochs + F.when((F.col("size") > 0) & (2 * part >= F.col("size")), 1).otherwise(0)
    return joined.select(F.col("_key").alias(key), "size", "source_size", "target", taken.alias("taken"), copies.cast("long").alias("copies"), *[F.col(f"_carry_{n}").alias(n) for n in carry])


def contract(docs: DataFrame) -> DataFrame:
    """Contract columns."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def resampled(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken, whole texts."""
    mixed = mix(docs, carry={f"_c{i}": F.col(c) for i, c in enumerate(columns)})
    copies = F.array_repeat(F.lit(1), F.col("copies").cast("int"))
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(copies)).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])


#: The contract query in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
rows_ AS (
  SELECT doc_id, source, size,
         -ln(((('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(body)), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
         / (1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * len(regexp_extract_all(body, '[0-9#$%&*|<>{}=~^@\\]'))::DOUBLE / greatest(1, length(body))::DOUBLE)) AS ord
  FROM d),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM rows_ GROUP BY source),
lim AS (
  SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / w::DOUBLE AS ratio FROM per),
lev AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
  FROM lim),
fin AS (
  SELECT source, source_size, w, cap,
         (SELECT l.lvl FROM lev l WHERE l.lvl * l.w <= l.cap ORDER BY l.ratio, l.lvl LIMIT 1) AS level
  FROM lev),
tgt AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(level * w, cap::DOUBLE)) AS target FROM fin),
j AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
         (sum(r.size) OVER (PARTITION BY r.source ORDER BY r.ord, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM rows_ r JOIN tgt t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - (upto - size))) AS taken
FROM j
"""
