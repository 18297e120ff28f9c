"""Report operators on tiny hand-made facts: ties, gap months, one-day data,
calendar denominators, leap years, cumulative shares."""

import datetime as dt

import pytest

from encore.operators import clean, kpis, report

COLS = ("track_name string, artist_name string, album_name string, ts timestamp_ntz, ms_played long, "
        "reason_start string, reason_end string, conn_country string, shuffle boolean, incognito_mode boolean")


def plays(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    return clean.with_calendar(clean.mark_full_play(clean.map_reasons(df)))


def row(t, a, day, ms=3_600_000, end="trackdone", start="clickrow", hour=10, album="L", country="DE", shuffle=False):
    return (t, a, album, dt.datetime(day.year, day.month, day.day, hour), ms, start, end, country, shuffle, False)


D = dt.date


@pytest.fixture
def gap_plays(spark):
    # Jan and Mar 2020 have plays, Feb 2020 has none; ties between artists B and A
    return plays(spark, [
        row("s1", "B", D(2020, 1, 10)), row("s2", "B", D(2020, 1, 11)),
        row("s1", "A", D(2020, 1, 12)), row("s3", "A", D(2020, 3, 5)),
        row("s4", "C", D(2020, 3, 6), end="fwdbtn", ms=2000),
    ])


def test_most_played_ties_and_zero_plays(gap_plays):
    r1 = report.most_played_artists(gap_plays, k=10).collect()
    got = {r.artist_name: (r.play_count, r.unique_tracks_played) for r in r1}
    assert got == {"A": (2, 2), "B": (2, 2)}  # C has no full play → dropped
    top1 = report.most_played_artists(gap_plays, k=1).collect()
    assert [r.artist_name for r in top1] == ["A"]  # tie → key ascending


def test_calendar_averages_with_gap_month(gap_plays):
    ym = {r.year_month: r.avg_hours_played_per_day for r in report.avg_hours_per_year_month(gap_plays).collect()}
    assert set(ym) == {"2020-01", "2020-02", "2020-03"}
    assert ym["2020-02"] is None
    assert ym["2020-01"] == pytest.approx(3 / 22)  # Jan 10..31
    assert ym["2020-03"] == pytest.approx((3_600_000 + 2000) / 3_600_000 / 6)  # Mar 1..6
    years = report.avg_hours_per_year(gap_plays).collect()
    # first and last year are both 2020: the last-year rule wins (Jan 1 → Mar 6 = 66 days)
    assert years[0].avg_hours_played_per_day == pytest.approx((4 * 3_600_000 + 2000) / 3_600_000 / 66)
    wk = {r.day_name: r.avg_hours_played_per_day for r in report.avg_hours_per_weekday(gap_plays).collect()}
    assert len(wk) == 7 and sum(1 for v in wk.values() if v is None) >= 1
    months = [r.month for r in report.avg_hours_per_month_of_year(gap_plays).collect()]
    assert months == ["January", "February", "March"]


def test_weekday_counts_match_calendar(spark):
    start, end = D(2019, 12, 30), D(2020, 2, 14)
    df = plays(spark, [row("s", "A", start), row("s", "A", end)])
    got = {r.day_name: r.avg_hours_played_per_day for r in report.avg_hours_per_weekday(df).collect()}
    n = (end - start).days + 1
    counts = {}
    for i in range(n):
        name = (start + dt.timedelta(days=i)).strftime("%A")
        counts[name] = counts.get(name, 0) + 1
    assert got["Monday"] == pytest.approx(1 / counts["Monday"])  # Dec 30 2019 is a Monday
    assert got["Friday"] == pytest.approx(1 / counts["Friday"])  # Feb 14 2020 is a Friday
    assert got["Tuesday"] is None


def test_one_day_history_kpis(spark):
    df = plays(spark, [row("s1", "A", D(2021, 6, 1)), row("s2", "A", D(2021, 6, 1), end="fwdbtn", ms=1000)])
    k = kpis.single_values(df).first()
    assert k.number_of_days == 0
    assert k.percent_of_days_with_tracks_played is None and k.played_songs_per_day is None
    assert k.skipped_songs == 1 and k.percent_of_songs_skipped_before_3s == 100
    assert k.top_1_artist == "A" and k.top_2_artist == "-" and k.top_1_track == "s1"
    # unique = 1 → rank min(N, 0) = 0 → 0 %
    assert k.top_10_track_play_count_percent == 0


def test_cumulative_share_matches_running_sum(spark):
    rows = []
    for t, n in [("a", 5), ("b", 3), ("c", 3), ("d", 1), ("e", 1), ("f", 1)]:
        rows += [row(t, "X", D(2020, 1, 1 + i)) for i in range(n)]
    df = plays(spark, rows)
    got = sorted((r.number_of_tracks, r.percent_of_played_songs)
                 for r in report.cumulative_play_share(df, "track").collect())
    counts = sorted([5, 3, 3, 1, 1, 1], reverse=True)
    expect, run = [(0, 0.0)], 0
    for i, c in enumerate(counts, 1):
        run += c
        expect.append((i, run * 100 / 14))
    assert got == expect
    share = report.share_at_rank(df, "track", [1, 3, 10]).first()
    assert (share.top_1, share.top_3, share.top_10) == (round(5 * 100 / 14), round(11 * 100 / 14), round(13 * 100 / 14))


def test_cumulative_share_large_bucket_chunks(spark, monkeypatch):
    monkeypatch.setattr(report, "RANK_CHUNK", 7)
    rows = [row(f"t{i}", "X", D(2020, 1, 1)) for i in range(30)] + [row("top", "X", D(2020, 1, 2))] * 4
    df = plays(spark, rows)
    got = sorted(r.number_of_tracks for r in report.cumulative_play_share(df, "track").collect())
    assert got == list(range(0, 32))


def test_monthly_series_dense(gap_plays):
    s = report.monthly_play_series(gap_plays, "artist", k=10).collect()
    b = sorted((r.month_index, r.play_count) for r in s if r.artist_name == "B")
    assert b == [(0, 2), (1, 0), (2, 0)]
    assert all(0 <= r.bar_height <= 40 for r in s)


def test_most_played_monthly_labels(gap_plays):
    out = {r.year_month: r for r in report.most_played_monthly(gap_plays).collect()}
    assert out["2020-01"].most_played_artist == "B (2 times)"
    assert out["2020-01"].most_played_track == "s1 (by A, 1 times)"
    assert out["2020-03"].most_played_album == "L (by A, 1 times)"


def test_filter_and_spine(gap_plays):
    f = report.filter_history(gap_plays, (2020, 2), (2020, 3), "A")
    assert f.count() == 1 and report.has_full_plays(f)
    assert not report.has_full_plays(report.filter_history(gap_plays, (2020, 2), (2020, 2)))
    spine = [r.year_month for r in report.month_spine(gap_plays).orderBy("year_month").collect()]
    assert spine == ["2020-01", "2020-02", "2020-03"]


def test_random_sample_shape(gap_plays):
    s = report.random_sample(gap_plays, n=2, seed=1)
    assert s.columns == ["column", "sample_1", "sample_2"]
    assert [r.column for r in s.collect()] == gap_plays.columns


def test_kpi_fixed_variant(spark):
    df = plays(spark, [row("s1", "A", D(2021, 6, 1), shuffle=True), row("s2", "A", D(2021, 6, 2), end="fwdbtn"),
                       row("s3", "A", D(2021, 6, 3), end="fwdbtn", shuffle=True), row("s4", "A", D(2021, 6, 4))])
    k = kpis.single_values(df, with_fixed=True).first()
    assert k.percent_of_skipped_songs_not_using_shuffle == 50  # 1 of 2 shuffle rows (reference's denominator)
    assert k.percent_of_skipped_songs_not_using_shuffle_fixed == 50  # 1 of 2 non-shuffle rows
    assert k.percent_of_skipped_songs_using_shuffle == 50


def test_report_bundle_materializes_and_cleans_up(spark, gap_plays):
    from encore.plans.report import Report

    with Report(gap_plays, k=5) as rep:
        paths = list(rep._written)
        assert len(paths) in (4, 5) and all(spark.read.parquet(p).count() > 0 for p in paths)
        sizes = {name: df.count() for name, df in rep.tables.items()}
        assert sizes["avg_hours_played_per_year_month"] == 3
        assert rep.single_values.count() == 1
    assert all(spark.read.parquet(p).count() == 0 for p in paths)


@pytest.mark.parametrize("by", [(), ("listener_id",)])
def test_tables_from_cuboids_equal_tables_from_the_fact(spark, by):
    from conftest import SF_SMALL

    from encore.plans import catalog
    from encore.plans.report import Report
    from encore.session import scratch_path

    path = scratch_path(spark, "fact")
    catalog.plays(spark, SF_SMALL).write.parquet(path)
    fact = spark.read.parquet(path)
    plain = Report(fact, k=20, by=by, materialize=None)
    text = lambda rows: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    with Report(fact, k=20, by=by, materialize="cuboids") as rep:
        assert len(rep._written) == (3 if by else 4)
        for name, df in [*rep.tables.items(), ("single_values", rep.single_values)]:
            if name != "single_values":
                assert not any(path.split(":")[-1] in f for f in df.inputFiles()), name  # cuboids only
            want = (plain.tables | {"single_values": plain.single_values})[name]
            assert df.columns == want.columns, name
            assert text(df.collect()) == text(want.collect()), name


def test_cuboids_of_parts_add_up(spark):
    from conftest import SF_SMALL

    from encore.operators import cuboids as C
    from encore.plans import catalog

    fact = catalog.plays(spark, SF_SMALL).cache()
    for make in (C.entity_months, C.days, C.places):
        whole = make(fact, ["listener_id"])
        parts = make(fact.where("ms_played % 18000 = 0"), ["listener_id"]).unionByName(make(fact.where("ms_played % 18000 != 0"), ["listener_id"]))
        nulls = whole.na.fill(0, [c for c in whole.columns if c.startswith("_")])
        assert C.merged(parts).na.fill(0, [c for c in whole.columns if c.startswith("_")]).exceptAll(nulls).count() == 0
        assert C.merged(parts).count() == whole.count() < fact.count() + 1
    fact.unpersist()


def test_the_sample_depends_on_the_rows_alone(spark, gap_plays):
    rows = gap_plays.unionByName(gap_plays.withColumn("ms_played", gap_plays.ms_played + 1)).select("track_name", "artist_name", "ts", "ms_played")
    first = report.sampled_rows(rows, 4, seed=3).collect()
    for n in (1, 5):
        assert report.sampled_rows(rows.repartition(n), 4, seed=3).collect() == first
    assert report.sampled_rows(rows, 4, seed=4).collect() != first
    # the sample of a union comes from the samples of its parts
    parts = [rows.where("ms_played % 2 = 0"), rows.where("ms_played % 2 = 1")]
    both = parts[0].limit(0)
    for part in parts:
        both = both.unionByName(report.sampled_rows(part, 4, seed=3).drop("sample"))
    assert report.sampled_rows(both, 4, seed=3).collect() == first
    assert report.sampled_rows(rows.where("false"), 4).count() == 0
    assert report.random_sample(rows, 2).count() == 4  # without a seed too
