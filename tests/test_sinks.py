"""S8 report documents: split layout, typed cells, order, display names, half-even rounding; S7 CSV."""

import json
import pathlib

import numpy as np
import pandas as pd

from encore.sinks import writers


def lines(folder):
    """The JSON lines of a written table, file after file."""
    return [json.loads(line) for f in sorted(pathlib.Path(folder).glob("part-*")) for line in f.read_text().splitlines()]


def test_split_documents(spark, tmp_path):
    t = spark.createDataFrame([("B", 5, 2.675, 1), ("C \"x\"", 4, 0.5, 2), ("A", 3, 1.125, 3)],
                              "artist_name string, play_count long, hours_played double, rank long")
    week = spark.createDataFrame([("Friday", 4.5), ("Monday", 3.0), ("Sunday", None)], "day_name string, avg_hours_played_per_day double")
    kpis = spark.createDataFrame([("2020-01-01", 7)], "first_day string, played_songs long")
    writers.write_report({"most_played_artists_total": t, "avg_hours_played_per_day_name": week}, kpis, str(tmp_path / "rep"))
    [doc] = lines(tmp_path / "rep" / "most_played_artists_total")
    # display rounding equals pandas' frame rounding (numpy: scale, rint, unscale)
    a, b, c = pd.Series([2.675, 0.5, 1.125]).round(2).tolist()
    assert doc == {"first": 0, "columns": ["artist", "play count", "hours played"], "data": [["B", 5, a], ['C "x"', 4, b], ["A", 3, c]]}
    [doc] = lines(tmp_path / "rep" / "avg_hours_played_per_day_name")
    assert doc["data"] == [["Monday", 3.0], ["Friday", 4.5], ["Sunday", None]]
    [kpi] = lines(tmp_path / "rep" / "single_values")
    assert kpi == {"first_day": "2020-01-01", "played_songs": 7}


def test_a_long_table_is_several_documents_in_order(spark):
    t = spark.range(2500).selectExpr("id AS number_of_tracks", "id / 25.0D AS percent_of_played_songs").repartition(7)
    docs = [json.loads(r.value) for r in writers.split_documents("cumulative_percent_play_count_track", t).collect()]
    assert [d["first"] for d in docs] == [0, 1000, 2000] and [len(d["data"]) for d in docs] == [1000, 1000, 500]
    assert [r[0] for d in docs for r in d["data"]] == list(range(2500))


def test_documents_per_group(spark):
    t = spark.createDataFrame([(1, "y", 1, 2), (1, "x", 2, 1), (2, "z", 3, 1)], "listener_id long, artist_name string, play_count long, rank long")
    docs = [json.loads(r.value) for r in writers.split_documents("most_played_artists_total", t, ["listener_id"]).collect()]
    assert [(d["listener_id"], d["data"]) for d in docs] == [(1, [["x", 2], ["y", 1]]), (2, [["z", 3]])]


def test_display_rounding_matches_pandas(spark):
    from encore.operators.clean import round_numeric

    values = [0.285, 1.005, 2.675, 1.125, 0.015, 10.555, 123.455, 0.0049999]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.x for r in round_numeric(df).collect()]
    assert got == pd.Series(values).round(2).tolist() == list(np.round(values, 2))


def test_csv_keeps_every_text(spark, tmp_path):
    from encore import schemas
    from encore.sources.history import read_csv

    names = ["  lead and trail  ", "", None, 'say "hi", twice', "two\nlines", "back\\slash", "comma, here", "'", "é漢"]
    rows = [(f"t{i}", n, n, "x", None, i, "a", "b", True, "AT", "p", False, None, True) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, schemas.PLAY_CSV)
    writers.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "csv")).collect())) == sorted(rows)


def test_a_clustered_write_has_few_files_and_prunes(spark, tmp_path):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    # 40 tasks, each with plays of all 8 years
    plays = spark.range(0, 40_000, 1, 40).select(
        F.timestamp_seconds(F.lit(1_000_000_000) + F.pmod(F.xxhash64("id"), F.lit(8 * 31_536_000))).cast("timestamp_ntz").alias("ts"), "id")
    plays = plays.withColumn("year", F.year("ts"))
    path = tmp_path / "plays"
    writers.write_parquet(plays, str(path), partition_by=["year"], cluster_by=["ts"], files=10)
    back = spark.read.parquet(str(path))
    assert back.count() == 40_000 and back.exceptAll(plays.select(*back.columns)).count() == 0
    files = sorted(path.rglob("*.parquet"))
    years = len(list(path.glob("year=*")))
    assert len(files) <= 10 + years
    bounds = sorted(tuple(getattr(pq.ParquetFile(f).metadata.row_group(0).column(0).statistics, b) for b in ("min", "max")) for f in files)
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:], strict=False))  # no two files overlap in time
    writers.write_parquet(plays.where("false"), str(path), partition_by=["year"], cluster_by=["ts"])
    writers.write_parquet(plays, str(tmp_path / "plain"), cluster_by=["ts"], files=4)
    assert len(list((tmp_path / "plain").glob("*.parquet"))) <= 4
