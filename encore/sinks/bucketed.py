"""A play fact stored by track, so that joins on the track need no shuffle of it.

The fact is written once, hash-bucketed by ``(track_id, salt)``: the only shuffle it takes. Every later enrichment joins
one table with a row per track to it, and only that table is shuffled, to the fact's buckets. A track with very many
plays has several salts, over which its plays are dealt; its row in the other table is repeated for each. The hot tracks
and their salts are a small table beside the fact: at most ``MAX_HOT`` rows, because a track is hot from one
``MAX_HOT``-th of all plays on.

``path/fact`` holds the plays, ``path/hot`` the salts and ``path/about`` what a later session needs to open it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_HOT = 1000
SALT = "track_salt"
KEY = "track_id"


@dataclass(frozen=True)
class BucketedFact:
    spark: SparkSession
    path: str
    buckets: int

    @property
    def table(self) -> str:
        return "encore_fact_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]

    def plays(self) -> DataFrame:
        """The plays with their ``track_salt``; a scan of it is dealt by track and salt."""
        return self.spark.table(self.table)

    def per_salt(self, tracks: DataFrame) -> DataFrame:
        """``tracks`` (a row per track), every hot track once for each of its salts."""
        hot = F.broadcast(self.spark.read.parquet(f"{self.path}/hot"))  # at most MAX_HOT rows
        last = F.coalesce(F.col("salts"), F.lit(1)) - 1
        return tracks.join(hot, KEY, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), last))).drop("salts")

    def join_tracks(self, tracks: DataFrame, shadowed: Sequence[str] = ()) -> DataFrame:
        """The plays (without ``shadowed`` columns) with the columns of their track; others, or of none, keep nulls."""
        return self.plays().drop(*shadowed).join(self.per_salt(tracks), [KEY, SALT], "left").drop(SALT)


def write_bucketed(plays: DataFrame, path: str, buckets: int | None = None, max_hot: int = MAX_HOT,
                   counts: DataFrame | None = None) -> BucketedFact:
    """Write ``plays`` under ``path`` (replacing what is there) in ``buckets`` files (default: the shuffle partitions).

    Plays without a track are dealt over salts as a hot track's are. ``counts``: the plays per track (``track_id, n``), a
    row per track, where they are known already; else they are counted.
    """
    spark = plays.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fact = BucketedFact(spark, path.rstrip("/"), buckets)
    if counts is None:
        counts = plays.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    whole = plays.count()
    least = max(1, -(-whole // max_hot))
    hot = counts.where((F.col("n") >= least) & (F.col("n") > 1)).select(
        KEY, F.least(F.lit(buckets), F.ceil(F.col("n") / least)).cast("int").alias("salts"))
    hot.coalesce(1).write.mode("overwrite").parquet(f"{fact.path}/hot")
    known = F.broadcast(spark.read.parquet(f"{fact.path}/hot").withColumnRenamed(KEY, "_hot"))  # at most max_hot rows
    salt = F.pmod(F.xxhash64(*plays.columns), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = plays.join(known, F.col(KEY).eqNullSafe(F.col("_hot")), "left").withColumn(SALT, salt).drop("_hot", "salts")
    # dealt as the buckets are, so that a bucket is one file
    (dealt.repartition(buckets, KEY, SALT).write.format("parquet").mode("overwrite").bucketBy(buckets, KEY, SALT)
     .sortBy(KEY, SALT).option("path", f"{fact.path}/fact").saveAsTable(fact.table))
    about = spark.range(1).select(F.lit(buckets).alias("buckets"))
    about.coalesce(1).write.mode("overwrite").parquet(f"{fact.path}/about")
    return fact


def open_bucketed(spark: SparkSession, path: str) -> BucketedFact:
    """A fact that :func:`write_bucketed` wrote, in this session or an earlier one."""
    path = path.rstrip("/")
    about = spark.read.parquet(f"{path}/about").first()
    fact = BucketedFact(spark, path, about["buckets"])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/fact").schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {fact.table} ({columns}) USING parquet CLUSTERED BY ({KEY}, {SALT}) "
              f"SORTED BY ({KEY}, {SALT}) INTO {fact.buckets} BUCKETS LOCATION '{path}/fact'")
    return fact
