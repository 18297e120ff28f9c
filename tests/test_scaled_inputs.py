"""Inputs derived from the tables and the operators over them read the plays once, and the results stay the same."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from encore.operators import clean, report
from encore.session import scratch_path
from encore.sources import derived, history, tables

N_LINES = 240


@pytest.fixture(scope="module")
def sf_dir(spark):
    """A small star schema; order 7 comes twice, line 0 has a part that is not there, customer 3 has no nation."""
    path = scratch_path(spark, "own-tables")

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")

    write("region", [(0, "ASIA")], "r_regionkey int, r_name string")
    write("nation", [(0, "JAPAN", 0), (1, "INDIA", 0)], "n_nationkey int, n_name string, n_regionkey int")
    write("customer", [(i, None if i == 3 else i % 2, "FURNITURE") for i in range(8)], "c_custkey bigint, c_nationkey int, c_mktsegment string")
    write("supplier", [(i, f"S{i}", i % 2, 10.5 * i) for i in range(5)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
    write("part", [(i, f"big p{i}", i + 1) for i in range(6)], "p_partkey bigint, p_name string, p_size int")
    orders = [(i, i % 8, "P" if i % 3 else "O", f"{i % 5 + 1}-X") for i in range(20)]
    write("orders", [*orders, orders[7]], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string")
    write("lineitem", [(i % 20, 99 if i == 0 else i % 6, i % 5, i % 7, float(1 + i % 40), i % 3 / 100, "NAR"[i % 3], "FO"[i % 2],
                        dt.datetime(1996 + i % 3, 1 + i % 12, 1 + i % 28)) for i in range(N_LINES)],
          "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, "
          "l_returnflag string, l_linestatus string, l_shipdate timestamp")
    return path


def _plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def _bindings(plan):
    """How often the lines are scanned."""
    return plan.count("FileScan parquet [l_orderkey")


def test_small_tables_are_broadcast_by_their_size(spark, sf_dir):
    """Before, suppliers and listeners came as joins of guessed size, and the lines were sort-merged with each."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = _plan(tables.plays_raw_wide(spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [l_suppkey" not in plan and "SortMergeJoin [o_custkey" not in plan


def test_joined_rows_repeat_and_go_missing_as_their_keys_do(spark, sf_dir):
    raw = tables.plays_raw_wide(spark, sf_dir)
    lines = [(i % 20, 99 if i == 0 else i % 6) for i in range(N_LINES)]
    kept = [o for o, p in lines if p < 6 and o % 8 != 3]
    assert raw.count() == len(kept) + kept.count(7)


def test_raw_export_binds_the_plays_once(spark, sf_dir):
    raw = tables.plays_raw_wide(spark, sf_dir)
    records = derived.raw_export(raw)
    assert _bindings(_plan(records)) == 1  # two before
    twice = raw.where(F.hour("ts") == 3).count()
    assert records.count() == raw.count() + twice and twice > 0


def test_export_files_are_gzipped_and_bounded(spark, sf_dir):
    path = scratch_path(spark, "own-export")
    records = derived.raw_export(tables.plays_raw_wide(spark, sf_dir))
    derived.export_files(records, path, plays_per_file=10)
    files = spark.read.option("multiLine", True).option("pathGlobFilter", "*.txt.gz").json(path)
    sizes = [r[0] for r in files.groupBy(F.input_file_name()).count().select("count").collect()]
    assert max(sizes) <= 10 and sum(sizes) == records.count()
    back = history.read_history(spark, path, listener=r"listener_id=(\d+)/", glob="*.txt.gz")
    cleaned = clean.clean_history(back.withColumn("listener_id", F.col("listener_id").cast("bigint")))
    want = clean.clean_history(derived.parse_export(records))
    assert sorted(map(str, cleaned.collect())) == sorted(map(str, want.collect()))


def test_export_zips_keep_every_play(spark, sf_dir):
    path = scratch_path(spark, "own-zips")
    records = derived.raw_export(tables.plays_raw_wide(spark, sf_dir))
    derived.export_zips(records, path, history.HISTORY_FOLDER, plays_per_member=10, members_per_zip=2)
    plays = history.ingest_archives(spark, path, listener=r"/(\d+)--?\d+\.zip$", malformed="skip")
    assert plays.count() == records.count()
    members = history.archive_manifest(spark, path).where(F.col("member").contains("plays_")).groupBy("archive").count()
    assert members.agg(F.max("count")).first()[0] <= 2
    assert history.rejected_members(spark, path).count() == plays.where("cast(listener_id as int) % 7 = 0").select("listener_id").distinct().count()


@pytest.mark.parametrize("table", [
    report.avg_hours_per_year_month, report.avg_hours_per_year, report.avg_hours_per_month_of_year, report.avg_hours_per_weekday,
    lambda p: report.monthly_play_series(p, "artist", 3), lambda p: report.monthly_play_series(p, "track", 3)])
def test_period_tables_bind_the_plays_once(spark, sf_dir, table):
    """Hours and first and last day, top entities and first month came from two bindings before."""
    plays = clean.report_plays(tables.with_missing_names(tables.plays_raw_wide(spark, sf_dir)))
    df = table(plays)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert _bindings(plan) == 1


def test_average_hours_of_a_listener_without_a_key(spark):
    rows = [(None, dt.date(2020, 1, 31), 3_600_000), (1, dt.date(2020, 1, 30), 3_600_000), (1, dt.date(2020, 3, 1), 7_200_000), (1, None, 5)]
    plays = spark.createDataFrame(rows, "listener_id bigint, day date, ms_played bigint").withColumns(
        {"year": F.year("day"), "month": F.month("day"), "year_month": F.date_format("day", "yyyy-MM")})
    by = ["listener_id"]
    months = {tuple(r) for r in report.avg_hours_per_year_month(plays, by).collect()}
    assert months == {(None, "2020-01", None), (1, "2020-01", 0.5), (1, "2020-02", None), (1, "2020-03", 2.0)}
    years = {r["year"]: r["avg_hours_played_per_day"] for r in report.avg_hours_per_year(plays, by).collect()}
    assert years == {2020: 3 / 61, None: 5 / (365 * 3_600_000)}


def test_documents_derive_from_a_row_per_track(spark, sf_dir, monkeypatch):
    """Before, each of the four kinds of document was derived from all plays."""
    from encore.plans import catalog

    seen = {}
    for kind in ("track_docs", "album_docs", "artist_docs", "kg_docs"):
        def watched(raw, kind=kind, keep=getattr(derived, kind)):
            seen[kind] = (raw, keep(raw))
            return seen[kind][1]

        monkeypatch.setattr(derived, kind, watched)
    counted = []
    keep = catalog.ingest_queries()["e14_wide_fact_from_documents"](spark, sf_dir)
    raw = tables.plays_raw_wide(spark, sf_dir)
    tracks = raw.select("track_id").distinct().count()
    assert keep.count() == raw.count() > tracks and len(seen) == 4
    monkeypatch.undo()
    for kind, (given, docs) in seen.items():
        counted.append(given.count())
        want = getattr(derived, kind)(raw)
        assert sorted(map(str, docs.collect())) == sorted(map(str, want.collect())), kind
    assert set(counted) == {tracks}


def test_a_fact_stored_with_known_counts_is_the_same(spark, tmp_path):
    from encore.sinks import bucketed

    plays = spark.range(300).selectExpr("if(id % 3 = 0, 'hot', if(id % 10 = 1, null, 't' || id % 20)) AS track_id", "id AS ms_played")
    counts = plays.groupBy("track_id").agg(F.count("*").alias("n"))
    a = bucketed.write_bucketed(plays, str(tmp_path / "a"), buckets=4, max_hot=20)
    b = bucketed.write_bucketed(plays, str(tmp_path / "b"), buckets=4, max_hot=20, counts=counts)
    assert sorted(map(str, a.plays().collect())) == sorted(map(str, b.plays().collect()))
    hot = [sorted(map(str, spark.read.parquet(str(tmp_path / x / "hot")).collect())) for x in ("a", "b")]
    assert hot[0] == hot[1] and hot[0]
