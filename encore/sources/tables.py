"""S5 table scans and the binding of the driver's star-schema tables to plays.

The driver tables are TPC-H-like; ``plays_raw_wide`` maps them onto the wide
play fact (fact ⟕ tracks ⟕ albums ⟕ artists) with *raw* reason codes, so the
cleaning operators run on top of it exactly as they do on a real export.

Plan shape: the fact is shuffled once, with the orders, which have met their
listener before. Tracks (part) and artists (supplier) are then joined as plain
scans, of which the planner knows the size: it broadcasts them up to
``spark.sql.autoBroadcastJoinThreshold``, without a shuffle of the fact, and
sort-merges larger ones. Only nation/region carry an explicit broadcast hint
(25 / 5 rows by definition of the schema).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Columns of the binding, in order (FIXTURES §3.1 plus track_duration_ms and website).
RAW_WIDE_COLUMNS = [
    "listener_id", "track_id", "track_name", "artist_id", "artist_name", "album_id", "album_name",
    "album_release_year", "wikidata_entity_id", "gender", "is_band", "country", "artist_genres",
    "artist_popularity", "track_duration_ms", "website", "ts", "ms_played", "reason_start",
    "reason_end", "conn_country", "platform", "shuffle", "offline", "incognito_mode",
]


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table (pushdown + pruning by Catalyst)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _with_artist(spark: SparkSession, sf_dir: str, plays: DataFrame) -> DataFrame:
    """``plays`` ⋈ supplier ⋈ nation ⋈ region on ``l_suppkey``.

    The suppliers are joined as they are scanned, so that the planner knows their size; a join's is only guessed.
    """
    s = scan(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey", "s_acctbal")
    n = scan(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("sn_name"), "n_regionkey"
    )
    r = scan(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return plays.join(s, "l_suppkey").join(F.broadcast(n), "s_nationkey").join(F.broadcast(r), "n_regionkey")


def _artist_columns() -> dict[str, Column]:
    """The artist's attributes, one artist per supplier, from the columns of :func:`_with_artist`."""
    k = F.col("l_suppkey")
    genre = (
        F.when(k % 4 == 0, "art rock").when(k % 4 == 1, "Hip-Hop").when(k % 4 == 2, "dream pop")
        .otherwise("classical")
    )
    return {
        "artist_name": F.col("s_name"),
        "album_release_year": F.lit(1940) + (k * 7) % 85,
        "wikidata_entity_id": F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("Q"), k.cast("string"))),
        "gender": F.when(k % 3 == 0, "female").when(k % 3 == 1, "male"),
        "is_band": F.when(k % 4 == 3, F.lit(None).cast("boolean")).otherwise(k % 2 == 0),
        "country": F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("sn_name")),
        "artist_genres": F.when(k % 10 == 0, F.lit("")).otherwise(F.concat(genre, F.lit(";"), F.lower("r_name"))),
        "artist_popularity": F.abs(F.floor("s_acctbal").cast("long")) % 101,
        "website": F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://artist"), k.cast("string"), F.lit(".example.org"))),
    }


def with_artist_columns(spark: SparkSession, sf_dir: str, tracks: DataFrame) -> DataFrame:
    """Rows of the bound plays that were stored without their artist's attributes (with ``artist_id``), and these attributes.

    The same rows as if the plays had carried them; the artists of bound plays are all there. An artist whose key the
    suppliers list twice gives its rows twice.
    """
    joined = _with_artist(spark, sf_dir, tracks.withColumn("l_suppkey", F.col("artist_id")))
    return joined.select(*tracks.columns, *[value.alias(name) for name, value in _artist_columns().items()])


def _listener_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scan(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = scan(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("conn_country")
    )
    return c.join(F.broadcast(n), "c_nationkey").select(
        "c_custkey", (F.col("c_custkey") % 50).alias("listener_id"), "conn_country",
        F.col("c_mktsegment").alias("platform"),
    )


def plays_raw_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding view: one row per lineitem as a wide play with raw reason codes."""
    hour = ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 3) % 24).cast("int")
    # what comes from the line alone is reduced before the joins, so that shuffles carry the result
    li = scan(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
        (F.col("l_shipdate").cast("timestamp_ntz") + F.make_interval(hours=hour)).alias("ts"),
        (F.col("l_linestatus") == "F").alias("shuffle"),
        (F.col("l_discount") == 0.0).alias("incognito_mode"),
    )
    o = scan(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", (F.col("o_orderstatus") == "P").alias("offline"),
        F.substring("o_orderpriority", 1, 1).alias("prio"),
    )
    p = scan(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    listeners = _listener_dim(spark, sf_dir).withColumnRenamed("c_custkey", "o_custkey")

    album_name = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    prio, artist = F.col("prio"), _artist_columns()
    # the orders meet their listener before the lines, of which there are several an order
    joined = _with_artist(spark, sf_dir, li.join(o.join(listeners, "o_custkey"), "l_orderkey").join(p, "l_partkey"))
    return joined.select(
        "listener_id",
        F.concat(F.col("p_name"), F.lit("|"), F.col("l_suppkey").cast("string")).alias("track_id"),
        F.col("p_name").alias("track_name"),
        F.col("l_suppkey").alias("artist_id"),
        artist["artist_name"].alias("artist_name"),
        F.concat(album_name, F.lit("|"), F.col("l_suppkey").cast("string")).alias("album_id"),
        album_name.alias("album_name"),
        *[artist[c].alias(c) for c in ("album_release_year", "wikidata_entity_id", "gender", "is_band", "country",
                                       "artist_genres", "artist_popularity")],
        (F.col("p_size").cast("long") * 6000).alias("track_duration_ms"),
        artist["website"].alias("website"),
        "ts",
        (F.col("l_quantity").cast("long") * 6000).alias("ms_played"),
        F.when(prio == "1", "clickrow").when(prio == "2", "fwdbtn").when(prio == "3", "trackdone")
        .when(prio == "4", "backbtn").otherwise("playbtn").alias("reason_start"),
        F.when(F.col("l_returnflag") == "N", "trackdone").when(F.col("l_returnflag") == "A", "fwdbtn")
        .otherwise("endplay").alias("reason_end"),
        "conn_country", "platform", "shuffle", "offline", "incognito_mode",
    )


# Plays of these lengths lose a name in the bound history, so that every operator meets missing ones.
MISSING_NAMES = {"artist_name": 17 * 6000, "track_name": 23 * 6000, "album_name": 29 * 6000}


def with_missing_names(raw: DataFrame) -> DataFrame:
    """The bound plays, some without artist, track or album name."""
    return raw.withColumns({c: F.when(F.col("ms_played") != ms, F.col(c)) for c, ms in MISSING_NAMES.items()})
