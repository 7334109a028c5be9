"""Document fingerprints by winnowing [native].

A text is cut into tokens (runs without ASCII white space; longer runs are cut into pieces of
:data:`PIECE` characters), each token is hashed, and every ``GRAM`` neighbouring token hashes are
combined into a rolling polynomial hash. The least hash of every ``WINDOW`` neighbouring grams is
kept, the rightmost of equal ones, with its position. So any passage of ``WINDOW + GRAM - 1``
tokens that two texts share leaves a common fingerprint in both.

Window minima come from doubling (minima over 2, 4, 8, ... grams), so the work for each token
doesn't depend on the window. Everything is DataFrame functions; no Python runs on the executors.

A text with fewer tokens than a gram has one hash of all its tokens; null and empty texts have
an empty fingerprint. Likeness is the Jaccard index of the sets of hashes; two empty
fingerprints are equal and so have likeness 1. Every row is returned, repeated rows too; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import stage, text_of
from palimpsest.operators import ranges

GRAM = 4
WINDOW = 8
PIECE = 16
#: Rolling hashes are polynomials modulo this prime; a position takes the low 32 bits of a packed entry.
PRIME = (1 << 31) - 1
BASE = 1_103_515_245
_BITS = 32
_POSITIONS = 1 << _BITS
#: Documents of one range of ids when neighbours are sought.
RANGE_ROWS = 2_000


def _shifted(a: Column, by: int) -> tuple[Column, Column]:
    """The array without its last ``by`` entries, and without its first."""
    left = F.greatest(F.lit(0), F.size(a) - by)
    return F.slice(a, F.lit(1), left), F.slice(a, F.lit(1 + by), left)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % PIECE), F.lit(0))


def packed(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of hash * 2^32 + (2^32 - 1 - position), one entry for each kept gram."""
    # Each step is a column of its own, so that no expression is evaluated twice.
    df = df.withColumn("_g", F.transform(tokens(F.col(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))))
    short = F.aggregate("_g", F.lit(0).cast("long"), lambda s, x: (s * BASE + x) % PRIME)
    df = df.withColumn("_s", F.when(F.size("_g").between(1, GRAM - 1), F.array(short)))
    reach = 1
    while reach < GRAM:
        step = min(reach, GRAM - reach)
        times = pow(BASE, step, PRIME)
        df = df.withColumn("_g", F.zip_with(*_shifted(F.col("_g"), step), lambda x, y: (x * times + y) % PRIME))
        reach += step
    df = df.withColumn("_p", F.transform(F.coalesce("_s", "_g"), lambda g, i: g * _POSITIONS + (_POSITIONS - 1 - i)))
    reach = 1
    while reach < WINDOW:
        step = min(reach, WINDOW - reach)
        least = F.zip_with(*_shifted(F.col("_p"), step), lambda x, y: F.least(x, y))
        # with too few grams for a window, the least of all is kept
        df = df.withColumn("_p", F.when(F.size("_p") > step, least).when(F.size("_p") > 1, F.array(F.array_min("_p"))).otherwise(F.col("_p")))
        reach += step
    return df.withColumn(out, F.array_distinct("_p")).drop("_g", "_s", "_p")


def hashes(packed_: Column) -> Column:
    return F.transform(packed_, lambda p: F.shiftright(p, _BITS))


def printed(packed_: Column) -> Column:
    """``hash@position`` entries by position, hash in hexadecimal."""
    return F.array_join(F.transform(packed_, lambda p: F.concat(F.lower(F.hex(F.shiftright(p, _BITS))), F.lit("@"), (_POSITIONS - 1 - p.bitwiseAND(F.lit(_POSITIONS - 1))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of hashes."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(both / (F.size(x) + F.size(y) - both))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint`` (array of hash and position by position); a map without a shuffle."""
    found = packed(docs.select(F.col(key).alias("_key"), text_of(text).alias("_text")), "_text", "_fp")
    entry = lambda p: F.struct(F.shiftright(p, _BITS).alias("hash"), (_POSITIONS - 1 - p.bitwiseAND(F.lit(_POSITIONS - 1))).alias("position"))
    return found.select(F.col("_key").alias(key), F.transform("_fp", entry).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, fp, next_text, next_fp``: next is the row that follows by descending id (after the last: the first).

    Equal ids follow each other by a hash of the text; null ids come last. Rows are dealt once,
    by ranges of id and hash with about as many rows each, and a window finds the neighbour there.
    Each range also gets a copy of the first row of the range that follows, put after its own rows.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("_hash", F.xxhash64("text"))
    ranged = ranges.ranged(rows, [F.col("doc_id"), F.col("_hash")], RANGE_ROWS, "_range")
    firsts = stage(ranged.groupBy("_range").agg(F.max_by("text", F.struct("doc_id", "_hash")).alias("text")), "firsts")
    # one number for each range
    numbers = sorted(r["_range"] for r in firsts.select("_range").collect())
    after = docs.sparkSession.createDataFrame([(n, numbers[i - 1]) for i, n in enumerate(numbers)], "_before long, _range long")
    extra = firsts.join(F.broadcast(after), "_range").select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.col("_before").alias("_range"), F.lit(0).cast("long").alias("_hash"), F.lit(1).alias("_extra"))
    every = packed(ranged.withColumn("_extra", F.lit(0)), "text", "fp").unionByName(packed(extra, "text", "fp"))
    w = Window.partitionBy("_range").orderBy("_extra", F.desc_nulls_last("doc_id"), F.desc("_hash"))
    return every.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).filter("_extra = 0").select("doc_id", "text", "fp", "next_text", "next_fp")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Contract columns: each text against its edited form and against the next document."""
    pairs = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next_text"), F.lit(1), third))
    pairs = packed(pairs.withColumn("edited", edited), "edited", "edited_fp")
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("fp")).alias("fingerprint"),
        printed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(hashes(F.col("fp")), hashes(F.col("edited_fp"))).alias("near_edited"),
        likeness(hashes(F.col("fp")), hashes(F.col("next_fp"))).alias("near_next"),
    )
