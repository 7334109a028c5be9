"""Line dedup by content-defined chunks of lines [native].

The lines of a text are cut into chunks where a rolling hash over the hashes of two neighbouring
lines falls on one of every :data:`MEAN_LINES` values, so an inserted or removed line moves only
the boundaries next to it. A line of :data:`LONG_WORDS` words or more is a chunk of its own.
Chunks of several lines, and long lines, that occur more than once in all texts are kept only
at their first place (smallest id, then position) and removed elsewhere.

Only 64-bit hashes of all chunks are dealt out by key, with counts added up before; the bytes of
chunks whose hash repeats are then compared, and only equal bytes count as a repeat. A common
chunk therefore arrives at most once from each task when first places are sought, and joins
back by hash with skew splitting.

Null text stays null and counts as no chunk. The empty text is one empty line and never removed.
Rows with equal id and text are one document here and treated alike: a chunk's first place in
one is its first place in both. Text left without a line is the empty text. An empty table gives an
empty table. Other columns pass through whatever their names, but ``removed_chunks`` and
``removed_lines`` are written anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, let

MEAN_LINES = 3
LONG_WORDS = 50
BASE = 1_000_003
PRIME = (1 << 31) - 1


def _long(line: Column) -> Column:
    # LONG_WORDS words hold at least LONG_WORDS - 1 blanks; only lines of such length are counted
    return F.when(F.length(line) >= 2 * LONG_WORDS - 1, F.regexp_count(line, F.lit(WORD)) >= LONG_WORDS).otherwise(F.lit(False))


def chunks(text: Column) -> Column:
    """Array of structs (body, lines, long) whose bodies joined by line ends give the text; null for null."""

    def mark(line: Column) -> Column:
        return F.struct(F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long").alias("h"), _long(line).alias("long"))

    def begins(marks: Column):
        def test(at: Column) -> Column:
            here, one, two = (F.get(marks, at - k) for k in (0, 1, 2))
            rolled = (F.coalesce(two["h"], F.lit(0).cast("long")) * BASE + one["h"]) % PRIME % MEAN_LINES
            return (at == 0) | here["long"] | one["long"] | (rolled == 0)

        return test

    def cut(lines: Column, marks: Column, starts: Column) -> Column:
        def chunk(start: Column, place: Column) -> Column:
            stop = F.coalesce(F.get(starts, place + 1), F.size(lines))
            return F.struct(F.array_join(F.slice(lines, start + 1, stop - start), "\n").alias("body"), (stop - start).alias("lines"), F.get(marks, start)["long"].alias("long"))

        return F.transform(starts, chunk)

    found = let(
        F.split(text, "\n", -1),
        lambda lines: let(F.transform(lines, mark), lambda marks: let(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), begins(marks)), lambda starts: cut(lines, marks, starts))),
    )
    return F.when(text.isNotNull(), found)


def _places(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each chunk that may be removed: row key, position, hash, body."""
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_th"), F.posexplode(chunks(F.col(text))).alias("_pos", "_chunk"))
    rows = rows.filter("(_chunk.lines > 1 or _chunk.long) and length(_chunk.body) > 0")
    return rows.select("_id", "_th", "_pos", F.xxhash64("_chunk.body").alias("_h"), F.col("_chunk.body").alias("_body"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``; adds ``removed_chunks`` and ``removed_lines``."""
    place = F.struct("_id", "_th", "_pos")
    places = _places(docs, key, text)
    repeated = places.groupBy("_h").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).filter("_a <> _b").select("_h")
    suspects = places.join(repeated, "_h", "left_semi")
    # Grouping by the bytes themselves is the comparison.
    first = suspects.groupBy("_h", "_body").agg(F.min(place).alias("_first"))
    gone = suspects.join(first, ["_h", "_body"]).filter(place != F.col("_first"))
    per_doc = gone.groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_gone"))
    # The other columns travel in one, so that no name of theirs can clash.
    others = [c for c in docs.columns if c != text]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(key).alias("_k"), F.col(text).alias("_t"), F.xxhash64(text).alias("_key"))
    joined = whole.join(per_doc, whole["_k"].eqNullSafe(per_doc["_id"]) & (whole["_key"] == per_doc["_th"]), "left")

    def without(parts: Column) -> Column:
        # set difference by hashing, so that a text which loses many chunks costs time in proportion
        kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone")), lambda i: F.get(parts, i)["body"])
        lines = F.aggregate("_gone", F.lit(0).cast("long"), lambda s, i: s + F.get(parts, i)["lines"])
        return F.struct(F.array_join(kept, "\n").alias("text"), lines.alias("lines"))

    # Texts that lose nothing aren't cut again.
    touched = F.col("_gone").isNotNull()
    done = joined.withColumn("_new", F.when(touched, let(chunks(F.col("_t")), without)))
    made = {
        text: F.when(touched, F.col("_new.text")).otherwise(F.col("_t")),
        "removed_chunks": F.when(touched, F.size("_gone")).otherwise(0).cast("long"),
        "removed_lines": F.coalesce("_new.lines", F.lit(0).cast("long")),
    }
    names = [*docs.columns, *[c for c in made if c not in docs.columns]]
    return done.select(*[(made[c] if c in made else F.col("_row").getField(c)).alias(c) for c in names])


def contract(docs: DataFrame) -> DataFrame:
    """``doc_id, removed_chunks, removed_lines, n_chars, text_sha256`` of every document."""
    done = dedup(docs.select("doc_id", "text"))
    body = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "removed_chunks", "removed_lines", F.length(body).cast("long").alias("n_chars"), F.sha2(body.cast("binary"), 256).alias("text_sha256"))


#: The contract query in DuckDB.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50 AS lng FROM l),
f AS (
  SELECT *, i = 1 OR lng OR lag(lng) OVER w OR ((coalesce(lag(h, 2) OVER w, 0) * 1000003 + lag(h) OVER w) % 2147483647) % 3 = 0 AS b
  FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, sum(b::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos FROM f),
k AS (SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n, bool_or(lng) AS lng FROM c GROUP BY doc_id, pos),
r AS (
  SELECT *, (n > 1 OR lng) AND length(body) > 0 AND row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) > 1 AS gone FROM k),
o AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS chunks, coalesce(sum(n) FILTER (WHERE gone), 0) AS lines,
         coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS body
  FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.chunks, 0)::BIGINT AS removed_chunks, coalesce(o.lines, 0)::BIGINT AS removed_lines,
       length(coalesce(o.body, ''))::BIGINT AS n_chars, sha256(coalesce(o.body, '')) AS text_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
