"""What the operators share: table access, staged tables in the shared folder, text rules."""

from __future__ import annotations

import ctypes
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word as every contract here counts it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset (tests, a
    laptop) a folder inside the warehouse is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


#: Staged tables of this driver that are still there.
_STAGED: set[str] = set()


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{tag}-{uuid.uuid4().hex}"
    _STAGED.add(path)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _STAGED.discard(path)


def unstage(df: DataFrame) -> None:
    """Delete a table made by :func:`stage` once nothing will read it again."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)


def staged() -> set[str]:
    """The staged tables that are there now; what a call adds to them, its result may still read."""
    return set(_STAGED)


def clean_up(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Delete all staged tables but ``keep``, once the results that read them have been written."""
    for path in staged() - set(keep):
        _delete(spark, path)


def text_of(name: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def release() -> None:
    """Give freed memory back to the system, so that a worker that waits for its next task holds little."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


#: Bytes of rows that executors hand to Python at once.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python in small Arrow batches, unless the session has set a size of its own.

    The default of 64 MB is held several times over on both sides, and pooled there afterwards.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "64m"):
        spark.conf.set(name, str(BATCH_BYTES))


def map_texts(df: DataFrame, keep: dict[str, Column], text: Column, make, columns: str, block_bytes: int = 8_000_000) -> DataFrame:
    """Map whole texts in Python, batch by batch, without a shuffle.

    ``keep`` are columns carried through untouched (as Arrow, so nulls and large integers
    survive); ``make()`` runs once per task and returns ``f(texts) -> {name: values}`` for the
    new ``columns`` (a DDL string). Texts are handed over in blocks of about ``block_bytes``
    bytes, so the memory of a worker doesn't depend on how long its texts are (beyond one).
    """
    bound_batches(df.sparkSession)
    source = df.select(*[c.alias(k) for k, c in keep.items()], text.alias("_text"))
    names = list(keep)
    schema = T.StructType(source.schema.fields[: len(names)] + T.StructType.fromDDL(columns).fields)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, work = to_arrow_schema(schema), make()
        for batch in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(batch.column(len(names))), 0).cast("int64"))
            block = (np.cumsum(size) // block_bytes) if len(size) else size
            cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(size)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                made = work(part.column(len(names)).to_pylist())
                arrays = [part.column(i) for i in range(len(names))]
                arrays += [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], type=f.type) for f in list(arrow)[len(names) :]]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(arrays, arrow, strict=True)], schema=arrow)
                del made, arrays, part
        del work
        release()

    return source.mapInArrow(run, schema)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, even where ``body`` uses it inside a lambda.

    A plain column may be inlined by the optimiser into each place that uses it, lambdas included.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
