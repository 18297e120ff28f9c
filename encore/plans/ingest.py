"""The two ingest jobs as Spark jobs: exports → cleaned fact, fact + documents → wide fact.

Both are plain DataFrame plans ending in a parquet sink; inputs are folders
(or globs) on shared storage, read in parallel by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.operators import clean, enrich
from encore.sinks import writers
from encore.sinks.bucketed import KEY, BucketedFact
from encore.sources import documents, history


def exports_to_fact(spark: SparkSession, exports: str, out: str | None = None, archives: bool = False,
                    partition_by: Sequence[str] = ("year",), listener: str | None = None, malformed: str = "fail") -> DataFrame:
    """S1/S2 (or S3) → P1–P15 → S6. Returns the cleaned fact (read back when written).

    ``archives=True`` reads export zips (history folder members only), whose
    ``listener_id`` is the archive's name; otherwise a folder of JSON-array
    files. ``listener`` is a regular expression over the path whose first group
    is the listener. The listener is part of a play before the dedup.
    ``malformed="skip"`` leaves malformed files or members out; :func:`rejects`
    lists them. The written fact is clustered by time (``writers.write_parquet``).
    """
    by = {} if listener is None else {"listener": listener}
    raw = (history.ingest_archives(spark, exports, malformed=malformed, **by).drop("archive", "member") if archives
           else history.read_history(spark, exports, malformed=malformed, **by))
    fact = clean.clean_history(raw)
    if out is None:
        return fact
    to_write = fact.withColumn("year", F.year("ts")) if "year" in partition_by else fact
    writers.write_parquet(to_write, out, partition_by=list(partition_by), cluster_by=["ts"])
    return spark.read.parquet(out)


def rejects(spark: SparkSession, exports: str, archives: bool = False) -> DataFrame:
    """What ``exports_to_fact(malformed="skip")`` leaves out: ``path, reason`` (of an archive's member: ``archive!member``)."""
    if not archives:
        return history.rejected_files(spark, exports)
    bad = history.rejected_members(spark, exports)
    return bad.select(F.concat_ws("!", "archive", "member").alias("path"), "reason")


def enrich_fact(spark: SparkSession, plays: DataFrame | BucketedFact, tracks_dir: str, artists_dir: str, albums_dir: str,
                graph_dir: str | None = None, out: str | None = None) -> DataFrame:
    """S9 → E4/E11/E12 → E6 → E14 (→ S6): the wide fact with hours played.

    ``plays`` may be a fact stored by track (``sinks.bucketed``), which is then joined without a shuffle of it.
    """
    tracks = enrich.flatten_tracks(documents.read_track_docs(spark, tracks_dir))
    artists = enrich.flatten_artists(documents.read_artist_docs(spark, artists_dir),
                                     documents.read_kg_docs(spark, graph_dir) if graph_dir else None)
    albums = enrich.flatten_albums(documents.read_album_docs(spark, albums_dir))
    if isinstance(plays, BucketedFact):
        wide = enrich_stored_fact(plays, tracks, albums, artists)
    else:
        wide = enrich.wide_fact(plays, tracks, albums, artists)
    if out is None:
        return wide
    writers.write_parquet(wide, out)
    return spark.read.parquet(out)


def enrich_stored_fact(fact: BucketedFact, tracks: DataFrame, albums: DataFrame, artists: DataFrame) -> DataFrame:
    """E6 + E14 over a fact stored by track: one join, for which only the dimension is shuffled."""
    dimension = enrich.track_dimension(tracks, albums, artists)
    shadowed = [c for c in fact.plays().columns if c in dimension.columns and c != KEY]
    wide = fact.join_tracks(dimension, shadowed)
    return wide.withColumn("hours_played", F.col("ms_played") / 3_600_000)
