"""The fact stored by track: same rows as the plain join, no shuffle of the fact, hot tracks over several buckets."""

import re

import pytest
from pyspark.sql import functions as F

from encore.operators import enrich
from encore.plans import ingest
from encore.sinks import bucketed

PLAYS = "listener_id int, track_id string, ts timestamp_ntz, ms_played long, track_name string"


@pytest.fixture(scope="module")
def tables(spark):
    # a third of the plays have one track, a tenth no track, and some a track without a document
    n = F.col("id")
    track = F.when(n % 3 == 0, F.lit("hot")).when(n % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("t"), (n % 97).cast("string")))
    plays = spark.range(6000).select(
        (n % 7).cast("int").alias("listener_id"), track.alias("track_id"),
        F.timestamp_seconds(n * 1000).cast("timestamp_ntz").alias("ts"), (n * 10).alias("ms_played"), F.lit("own").alias("track_name"))
    ids = ["hot", *[f"t{i}" for i in range(90)]]
    tracks = spark.createDataFrame([(t, f"name {t}", f"al{i % 9}", f"ar{i % 5}") for i, t in enumerate(ids)],
                                   "track_id string, track_name string, album_id string, artist_id string")
    albums = spark.createDataFrame([(f"al{i}", f"album {i}") for i in range(8)], "album_id string, album_name string")
    artists = spark.createDataFrame([(f"ar{i}", f"artist {i}") for i in range(4)], "artist_id string, artist_name string")
    return plays, tracks, albums, artists


def rows(df):
    columns = sorted(df.columns)
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_same_rows_as_the_plain_join(spark, tables, tmp_path):
    plays, tracks, albums, artists = tables
    fact = bucketed.write_bucketed(plays, str(tmp_path / "fact"), buckets=6)
    got = ingest.enrich_stored_fact(fact, tracks, albums, artists)
    want = enrich.wide_fact(plays, tracks, albums, artists)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and got.count() == 6000
    assert got.where("track_name = 'own'").count() == 0  # the dimension's names, null where it has none


def test_the_fact_is_not_shuffled(spark, tables, tmp_path):
    plays, tracks, albums, artists = tables
    fact = bucketed.write_bucketed(plays, str(tmp_path / "fact"), buckets=6)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = ingest.enrich_stored_fact(fact, tracks, albums, artists)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    final = plan[:plan.index("== Initial Plan ==")].splitlines()
    scan = next(i for i, line in enumerate(final) if "FileScan" in line and "ms_played" in line)
    assert "Bucketed: true" in final[scan]
    # the nodes above the scan: each line up whose indent is smaller
    indent = lambda line: re.search(r"[A-Za-z*]", line).start()
    above, at = [], indent(final[scan])
    for line in reversed(final[:scan]):
        if re.search(r"[A-Za-z*]", line) and indent(line) < at:
            above.append(line)
            at = indent(line)
    names = " ".join(above)
    assert names.count("SortMergeJoin") == 1 and "Exchange" not in names and "ShuffleQueryStage" not in names


def test_hot_tracks_are_spread_and_files_are_bounded(spark, tables, tmp_path):
    plays, *_ = tables
    fact = bucketed.write_bucketed(plays, str(tmp_path / "fact"), buckets=8, max_hot=20)
    per = fact.plays().groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()
    assert len(per) <= 8 and max(r.n for r in per) < 2000  # one track has 2,000 plays
    hot = {r.track_id: r.salts for r in spark.read.parquet(str(tmp_path / "fact" / "hot")).collect()}
    assert hot["hot"] == 7 and hot[None] >= 1 and len(hot) <= 20


def test_opened_again_and_written_again(spark, tables, tmp_path):
    plays, tracks, albums, artists = tables
    path = str(tmp_path / "fact")
    fact = bucketed.write_bucketed(plays, path, buckets=4)
    spark.sql(f"DROP TABLE {fact.table}")  # as in a new session; the files stay
    again = bucketed.open_bucketed(spark, path)
    assert again == fact and rows(again.plays()) == rows(spark.read.parquet(path + "/fact"))
    assert rows(ingest.enrich_stored_fact(again, tracks, albums, artists)) == rows(enrich.wide_fact(plays, tracks, albums, artists))
    small = bucketed.write_bucketed(plays.where("ms_played < 100"), path, buckets=4)
    assert small.plays().count() == 10
    assert bucketed.write_bucketed(plays.where("false"), path, buckets=4).plays().count() == 0
