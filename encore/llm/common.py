"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.session import scratch_path

# An Arrow batch handed to Python ends at the first of these, so a run of very long texts stays bounded.
ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2097152",
}


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session (records and bytes)."""
    for key, value in ARROW_BATCH.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """As :func:`written`, in one folder per value of ``column``, so that a filter on it reads only its files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 2000, limit_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches that end at ``limit`` rows or about ``limit_bytes`` of text and bytes."""
    buf: list[tuple] = []
    size = 0
    for row in rows:
        buf.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
        if len(buf) >= limit or size >= limit_bytes:
            yield _batch(buf, schema)
            buf, size = [], 0
    if buf:
        yield _batch(buf, schema)


@lru_cache(maxsize=1)
def _malloc_trim() -> Callable[[int], int] | None:
    """glibc's, where it is there."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def trim() -> None:
    """Return what Arrow and the allocator hold but do not use."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim():
        _malloc_trim()(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, giving unused memory back after every batch and at the end.

    Python workers stay for later tasks, several beside one executor; without this each holds the peak of all it ran.
    """
    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(parts):
            yield out
            del out
            trim()
        trim()

    return each


def _batch(buf: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=f.type) for col, f in zip(zip(*buf, strict=True), schema, strict=True)], schema=schema)


def rows_that_stay(docs: DataFrame, stay: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """The rows of ``docs`` whose id and ``mark`` (a string) are in ``stay`` (``id, mark``), one row for each; all columns.

    Both steps go by one key column, so that the texts are shuffled once.
    """
    key = lambda i, m: F.concat_ws(":", m, F.coalesce(i.cast("string"), F.lit("")))
    name = "__stay_key"
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key(F.col(id_col), mark).alias(name))
    once = keyed.groupBy(name).agg(F.first("row").alias("row"))
    return once.join(stay.select(key(F.col("id"), F.col("mark")).alias(name)), name, "left_semi").select("row.*")
