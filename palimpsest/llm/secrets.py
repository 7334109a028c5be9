"""Secret scan [native]: base patterns, and a battery of randomness tests on the other tokens.

Everything here is DataFrame functions; no Python runs on the executors.

Positions come without a user function: the parts that ``split`` leaves and the matches that
``regexp_extract_all`` finds alternate, so running sums of their lengths give each match's start.

The battery looks at long tokens that the base patterns don't cover. The token's characters
decide its encoding (hex, base32, base62/64), and so its alphabet. Three tests, each against the
null "written by a person", give a p-value each: chi-squared uniformity (a person's token repeats
characters: coinciding pairs are rarer than :data:`COINCIDENCE` allows), runs (a person's token
rarely changes between lower case, upper case and digits, a capital before small letters not
counted), and lag-one serial correlation (a person's token keeps neighbours alike). They are
combined by Stouffer's rule for correlated tests, so longer tokens can earn smaller p-values.
A token that the same three statistics show not to be random at all (beyond :data:`VETO`
deviations from a uniform one), or of no encoding, has p = 1. The Benjamini-Hochberg step-up rule
is applied within each class of token length, over all candidates of the corpus, those with
p = 1 included, from a histogram of p-values of fixed size (rounded up, so on the safe side).

Null text is read as empty. Every row is returned, repeated rows too (repeated rows count
repeatedly in the false-discovery control); other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import let, text_of

KINDS = ("assign", "access", "hex")
#: Base patterns in Java's syntax, the group to measure, its least length.
#: A run of hex digits, or of capitals after AKIA, that is too short can't match from a later
#: start either, so for those two the least length may stand in the pattern itself.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Tokens that the battery looks at, and the false-discovery rate.
#: A sign ``=`` is padding at a token's end or parts a name from its value; it never stands inside.
TOKEN = r"(?=[A-Za-z0-9+/_=-]{20})[A-Za-z0-9+/_-]{16,}+=*+(?![A-Za-z0-9+/_-])|[A-Za-z0-9+/_-]{20,}+"
FDR = 0.05
#: What the null allows: the least rate of coinciding pairs of characters by encoding, and how much
#: wider than Poisson their number spreads; the rate of class changes between neighbours; the least
#: correlation of neighbours. Then the correlation of the tests that their combination assumes.
COINCIDENCE = {"hex": 0.1, "base32": 0.06, "base64": 0.05}
SPREAD, CHANGE_RATE, ALIKE, TOGETHER = 2.5, 0.2, 0.3, 0.5
#: Deviations from what a uniform token would show that rule randomness out.
VETO = 3.5
#: Length classes of the false-discovery control, and bins of -ln p.
LENGTHS = (24, 32, 48, 64)
BIN, BINS = 0.25, 400


def _located(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of structs (start, end, kind) of all matches whose ``group`` has ``least`` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    sizes = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("hit"), F.transform(measured, F.length).alias("size"))
    state = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + F.coalesce(x["hit"], F.lit(0))).alias("at"),
            F.when(x["size"] >= least, F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["hit"]).alias("end"))))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    spans = F.transform(state, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    # Most texts hold no match; they cost one scan.
    return F.when(text.rlike(pattern), spans).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)"))


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = {k: i for i, k in enumerate((*KINDS, "random"))}
    order = F.create_map(*[F.lit(x) for k in rank for x in (k, rank[k])])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def battery(token: Column) -> Column:
    """Struct ``encoding, length, chi, runs, serial, evidence`` of one token.

    The three tests are about standard normal for random tokens; ``evidence`` is -ln of the
    combined p-value under the null of a person's token, 0 where that is 1. Every step is bound
    once by ``let``, so a token costs time in proportion to its length.
    """
    none = F.lit(None).cast("double")
    plain = F.struct(F.lit("word").alias("encoding"), F.length(token).alias("length"), none.alias("chi"), none.alias("runs"), none.alias("serial"), F.lit(0.0).alias("evidence"))
    return let(token, lambda t: let(_encoding(t), lambda e: F.when(e != "word", let(_even(t, e), lambda c: let(_classes(t), lambda k: _tests(t, e, c, k)))).otherwise(plain)))


LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$") & token.rlike("[2-7]") & token.rlike("[A-Z]"), "base32")
        .when(token.rlike("^[A-Za-z0-9+/_-]+=*$") & token.rlike("[a-z]") & token.rlike("[A-Z]") & token.rlike("[0-9]"), "base64")
        .otherwise("word")
    )


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _even(token: Column, encoding: Column) -> Column:
    """Places of the characters in the encoding's alphabet."""
    body = F.regexp_replace(token, "=+$", "")
    alphabet = F.when(encoding == "hex", DIGIT + "abcdef").when(encoding == "base32", UPPER + "234567").otherwise(UPPER + LOWER + DIGIT + "+/")
    even = F.when(encoding == "hex", F.lower(body)).otherwise(F.translate(body, "-_", "+/"))
    return F.transform(_letters(even), lambda c: (F.instr(alphabet, c) - 1).cast("double"))


def _classes(token: Column) -> Column:
    """a, A or 0 for each letter or digit; separators are left out."""
    return _letters(F.translate(F.regexp_replace(token, "=+$", ""), LOWER + UPPER + DIGIT + "-_+/", "a" * 26 + "A" * 26 + "0" * 10))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _neighbours(values: Column) -> Column:
    return F.arrays_zip(F.slice(values, F.lit(1), F.size(values) - 1).alias("a"), F.slice(values, 2, F.size(values)).alias("b"))


def _tests(token: Column, encoding: Column, codes: Column, classes: Column) -> Column:
    size = F.when(encoding == "hex", 16.0).when(encoding == "base32", 32.0).otherwise(64.0)
    n = F.size(codes).cast("double")
    middle = (size - 1) / 2
    squares = _total(F.transform(F.array_distinct(codes), lambda c: F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), F.lit(2.0))))

    def runs(above: Column) -> Column:
        expected = 2 * above * (n - above) / n
        spread = F.sqrt(F.greatest(F.lit(0.25), expected * (expected - 1) / (n - 1)))
        turns = _total(F.transform(_neighbours(codes), lambda p: F.when((p["a"] > middle) != (p["b"] > middle), 1.0).otherwise(0.0)))
        return (turns - expected) / spread

    def correlation(mean: Column) -> Column:
        cov = _total(F.transform(_neighbours(codes), lambda p: (p["a"] - mean) * (p["b"] - mean)))
        return let(_total(F.transform(codes, lambda c: (c - mean) * (c - mean))), lambda var: F.when(var > 0, cov / var).otherwise(1.0))

    above = _total(F.transform(codes, lambda c: F.when(c > middle, 1.0).otherwise(0.0)))
    turned = lambda p: F.when((p["a"] != p["b"]) & ~((p["a"] == "A") & (p["b"] == "a")), 1.0).otherwise(0.0)
    changes = _total(F.transform(_neighbours(classes), turned)) / (n - 1)
    steps = F.struct(squares.alias("squares"), let(above, runs).alias("runs"), let(_total(codes) / n, correlation).alias("serial"), changes.alias("changes"))

    def made(s: Column) -> Column:
        chi = (size / n * s["squares"] - n - (size - 1)) / F.sqrt(2 * (size - 1))
        serial = s["serial"] * F.sqrt(n)
        fits = (chi < VETO) & (F.abs(s["runs"]) < VETO) & (F.abs(serial) < VETO)
        evidence = F.when(fits, _combined(encoding, n, s["squares"], s["changes"], s["serial"])).otherwise(0.0)
        return F.struct(encoding.alias("encoding"), F.length(token).alias("length"), chi.alias("chi"), s["runs"].alias("runs"), serial.alias("serial"), evidence.alias("evidence"))

    return let(steps, made)


def _combined(encoding: Column, n: Column, squares: Column, changes: Column, serial: Column) -> Column:
    """-ln p of the three tests together, each against a person's token.

    Each test's bound exp(-z * z / 2) gives its z: Chernoff's for too few coinciding pairs, taken as
    Poisson counts of wider spread, and for too many class changes; Fisher's for the correlation.
    """
    rate = F.when(encoding == "hex", COINCIDENCE["hex"]).when(encoding == "base32", COINCIDENCE["base32"]).otherwise(COINCIDENCE["base64"])
    pairs = (squares - n) / 2
    expected = n * (n - 1) / 2 * rate
    few = F.when(pairs < expected, (expected - pairs + F.when(pairs > 0, pairs * F.log(F.greatest(pairs, F.lit(1e-9)) / expected)).otherwise(0.0)) / SPREAD).otherwise(0.0)
    q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), changes))
    many = F.when(q > CHANGE_RATE, (n - 1) * (q * F.log(q / CHANGE_RATE) + (1 - q) * F.log((1 - q) / (1 - CHANGE_RATE)))).otherwise(0.0)
    bounded = F.least(F.lit(0.999), F.greatest(F.lit(-0.999), serial))
    unlike = F.greatest(F.lit(0.0), (F.lit(math.atanh(ALIKE)) - F.atanh(bounded)) * F.sqrt(n - 3))
    z = (F.sqrt(2 * few) + F.sqrt(2 * many) + unlike) / math.sqrt(3 + 6 * TOGETHER)
    return z * z / 2


def random_tokens(docs: DataFrame, key: list[str], text: str, base: str) -> DataFrame:
    """``key`` and struct (start, end, kind='random') of the tokens that pass; ``base`` are the base spans."""
    apart = lambda spans, taken: F.filter(spans, lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    tested = lambda s: F.struct(s.alias("span"), battery(F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])).alias("test"))
    # Tests run inside the generator, below which no later filter can be pushed and so repeat them.
    made = F.when(F.col(text).rlike(TOKEN), let(F.col(base), lambda taken: F.transform(apart(_located(F.col(text), TOKEN, "random"), taken), tested)))
    scored = docs.select(*key, F.explode_outer(made).alias("_made")).select(*key, F.col("_made.span").alias("_span"), "_made.test.*")
    every = scored.filter("_span is not null")
    stratum = F.lit(0)
    for edge in LENGTHS:
        stratum = stratum + F.when(F.col("length") >= edge, 1).otherwise(0)
    binned = every.select(*key, "_span", stratum.alias("_stratum"), F.least(F.floor(F.col("evidence") / BIN), F.lit(BINS - 1)).cast("int").alias("_bin"))
    # Step-up rule on the histogram: the least evidence whose p times the tests is within the rate.
    histogram = binned.groupBy("_stratum", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    per = histogram.groupBy("_stratum").agg(F.collect_list(F.struct("_bin", "_n")).alias("_h"))
    m = F.aggregate("_h", F.lit(0).cast("long"), lambda s, x: s + x["_n"])
    ahead = lambda b: F.aggregate(F.filter("_h", lambda x: x["_bin"] >= b), F.lit(0).cast("long"), lambda s, x: s + x["_n"])
    good = F.filter("_h", lambda x: F.exp(-BIN * x["_bin"].cast("double")) * m <= FDR * ahead(x["_bin"]))
    cut = per.select(F.col("_stratum"), F.array_min(F.transform(good, lambda x: x["_bin"])).alias("_cut"))
    # At most one row per length class.
    return binned.join(F.broadcast(cut), "_stratum").filter("_bin >= _cut").select(*key, "_span")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``base`` and ``spans`` (arrays of start, end, kind in code points), one row for each row of ``docs``."""
    prepared = docs.select(F.col(key).alias("_id"), text_of(text).alias("_text"))
    based = prepared.withColumn("_base", _ordered(F.concat(*[_located(F.col("_text"), p, k, g, least) for k, (p, g, least) in BASE.items()])))
    # Rows with equal id and text share their result, so found tokens are kept once for each.
    found = random_tokens(based.withColumn("_hash", F.xxhash64("_text")), ["_id", "_hash"], "_text", "_base")
    more = found.distinct().groupBy("_id", "_hash").agg(F.collect_list("_span").alias("_more"))
    narrow = based.select("_id", F.xxhash64("_text").alias("_hash"), "_base")
    joined = narrow.join(more, narrow["_id"].eqNullSafe(more["_id"]) & (narrow["_hash"] == more["_hash"]), "left").select(narrow["_id"].alias(key), "_base", "_more")
    return joined.select(key, F.col("_base").alias("base"), F.when(F.col("_more").isNull(), F.col("_base")).otherwise(_ordered(F.concat("_base", "_more"))).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """Contract columns."""
    found = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
