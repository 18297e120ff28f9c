"""R11 kept up to date: plays per year, distinct tracks, and tracks first played that year, from batches in any order.

What is kept are signed changes per year and, per track, the years in which it was played in full. A batch counts its
plays per year, adds 1 to the distinct tracks of every (track, year) that is new, and moves a track's first year: a track
not known before adds 1 to the new tracks of its first year; an older play that arrives late takes that 1 back from the
year it was counted in and adds it to the older one. The table is the sum of the changes.

Tracks are dealt to folders by hash, so that a batch reads those of its own tracks only; ``compact_every`` batches the
years of all tracks are merged. Batches are numbered; one that runs again replaces what it wrote and does not see it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH, BUCKET = "batch_id", "bucket"
BUCKETS = 64
COMPACT_EVERY = 32
_TRACK = ["track_name", "artist_name"]


def _read(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """What batches before ``before`` wrote under ``path``."""
    try:
        return spark.read.option("basePath", path).parquet(path).where(F.col(BATCH) < before)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def _years(spark: SparkSession, path: str, by: Sequence[str], before: int) -> DataFrame | None:
    """Years per track, in parts: the last merged state and the batches after it."""
    parts = _read(spark, f"{path}/years", before)
    merged = _read(spark, f"{path}/merged", before)
    if merged is None:
        return parts
    last = merged.agg(F.max(BATCH)).first()[0]
    if last is None:
        return parts
    return merged.where(F.col(BATCH) == last).unionByName(parts.where(F.col(BATCH) > last))


def _merge(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    return parts.groupBy(*by, *_TRACK, BUCKET).agg(F.array_distinct(F.flatten(F.collect_list("years"))).alias("years"))


def update(plays: DataFrame, batch_id: int, path: str, by: Sequence[str] = (), compact_every: int = COMPACT_EVERY) -> None:
    """Take the plays of one batch (``track_name``, ``artist_name``, ``year``, ``full_play`` and ``by``) into the state at ``path``."""
    spark, by = plays.sparkSession, list(by)
    full = plays.where("full_play").groupBy(*by, "year", *_TRACK).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        named = full.dropna(subset=_TRACK)
        own = named.groupBy(*by, *_TRACK).agg(F.collect_set("year").alias("years")).withColumn(
            BUCKET, F.pmod(F.xxhash64(*_TRACK), F.lit(BUCKETS)).cast("int"))
        known = _years(spark, path, by, batch_id)
        if known is None:
            seen = own.select("*", F.lit(None).cast("array<int>").alias("old"))
        else:
            touched = [r[0] for r in own.select(BUCKET).distinct().collect()]  # at most BUCKETS numbers
            of_batch = known.where(F.col(BUCKET).isin(touched)).join(own.select(*by, *_TRACK), [*by, *_TRACK], "left_semi")
            seen = own.join(_merge(of_batch, by).withColumnRenamed("years", "old"), [*by, *_TRACK, BUCKET], "left")
        seen = seen.withColumn("added", F.array_except("years", F.coalesce("old", F.array().cast("array<int>"))))

        def change(year, total=0, unique=0, new=0):
            return F.struct(year.alias("year"), *[F.lit(v).cast("long").alias(c) for c, v in (
                ("total", total), ("unique_per_year", unique), ("new", new))])

        first, was = F.array_min("years"), F.array_min("old")
        moved = (F.when(F.col("old").isNull(), F.array(change(first, new=1)))
                 .when(first < was, F.array(change(first, new=1), change(was, new=-1)))
                 .otherwise(F.array().cast("array<struct<year:int,total:bigint,unique_per_year:bigint,new:bigint>>")))
        changes = seen.select(*by, F.explode(F.concat(F.transform("added", lambda y: change(y, unique=1)), moved)).alias("c")).select(*by, "c.*")
        totals = full.select(*by, "year", F.col("n").alias("total"), *[F.lit(0).cast("long").alias(c) for c in ("unique_per_year", "new")])
        sums = [F.sum(c).alias(c) for c in ("total", "unique_per_year", "new")]
        changes.unionByName(totals).groupBy(*by, "year").agg(*sums).coalesce(1).write.mode("overwrite").parquet(f"{path}/changes/{BATCH}={batch_id}")
        added = seen.where(F.size("added") > 0).select(*by, *_TRACK, F.col("added").alias("years"), BUCKET)
        added.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/years/{BATCH}={batch_id}")
    finally:
        full.unpersist()
    if (batch_id + 1) % compact_every == 0:
        whole = _years(spark, path, by, batch_id + 1)
        _merge(whole, by).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/merged/{BATCH}={batch_id}")


def current(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """The R11 table of all batches so far: ``year, total, unique_per_year, new`` (per ``by``)."""
    changes = spark.read.option("basePath", f"{path}/changes").parquet(f"{path}/changes")
    sums = [F.sum(c).alias(c) for c in ("total", "unique_per_year", "new")]
    return changes.groupBy(*by, "year").agg(*sums).where("total > 0")


def start(spark: SparkSession, src: str, path: str, checkpoint: str, by: Sequence[str] = (), max_files_per_trigger: int = 100,
          compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Follow the parquet files of a play fact under ``src``; drains what is there and stops."""
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(src)
    return (stream.writeStream.foreachBatch(lambda df, n: update(df, n, path, by, compact_every))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
