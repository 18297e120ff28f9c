"""Cross-table invariants of the report at sf0.01, and per-listener
results equal to the single-listener computation."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from encore.operators import kpis, recipes, report
from encore.plans import catalog


@pytest.fixture(scope="module")
def fact(spark):
    return catalog.plays(spark, SF_MID).persist()


def test_report_invariants(fact):
    k = kpis.single_values(fact).first()
    r11 = report.yearly_track_play_count(fact).collect()
    r17 = report.plays_per_country(fact).collect()
    r10 = report.play_count_distribution(fact).collect()
    assert sum(r.total for r in r11) == sum(r.play_count for r in r17) == k.played_songs
    assert sum(r.new for r in r11) == sum(r.num_songs for r in r10) == k.unique_tracks_played
    # plays without a name count as played, but belong to no track
    named = fact.where("full_play and track_name is not null and artist_name is not null").count()
    assert sum(r.play_count * r.num_songs for r in r10) == named < k.played_songs
    assert all(r.new <= r.unique_per_year <= r.total for r in r11)
    r12 = report.hour_of_day_share(fact).collect()
    assert abs(sum(r.percent_of_play_time for r in r12) - 100) < 0.2
    r18 = sorted((r.number_of_tracks, r.percent_of_played_songs)
                 for r in report.cumulative_play_share(fact, "track").collect())
    vals = [v for _, v in r18]
    assert vals[0] == 0 and vals == sorted(vals) and abs(vals[-1] - 100 * named / k.played_songs) < 1e-9
    assert [n for n, _ in r18] == list(range(len(r18)))


def _rows(df, drop=("listener_id",)):
    return sorted(tuple(r) for r in df.drop(*drop).collect())


@pytest.mark.parametrize("op", ["r01", "r05", "r06", "r07", "r10", "r12", "r13", "r16", "r18", "r19",
                                "q01", "q05", "q14", "q16", "q17", "q18"])
def test_by_listener_equals_single_listener(spark, op):
    plays = catalog.plays(spark, SF_SMALL)
    wide = catalog.wide(spark, SF_SMALL)
    fns = {
        "r01": lambda df, by: report.most_played_artists(df, 5, by),
        "r05": lambda df, by: report.monthly_play_series(df, "track", 3, by),
        "r06": lambda df, by: report.top_songs_of_top_artists(df, 4, by),
        "r07": lambda df, by: report.most_played_monthly(df, by),
        "r16": lambda df, by: report.avg_hours_per_weekday(df, by),
        "q05": lambda df, by: recipes.top_track_per_female_artist(df, "2001-11-05", 5, by=by),
        "q14": lambda df, by: recipes.top_artist_per_top_country(df, 3, by),
        "q17": lambda df, by: recipes.least_played_of_top_albums(df, 3, by),
        "q18": lambda df, by: recipes.one_hit_wonders(df, 1, 100, 5, by),
        "r10": lambda df, by: report.play_count_distribution(df, by),
        "r12": lambda df, by: report.hour_of_day_share(df, by),
        "r13": lambda df, by: report.avg_hours_per_year_month(df, by),
        "r18": lambda df, by: report.cumulative_play_share(df, "artist", by),
        "r19": lambda df, by: kpis.single_values(df, by),
        "q01": lambda df, by: recipes.top_artists_by_hours(df, 5, by),
        "q16": lambda df, by: recipes.never_finished(df, 3, by),
    }
    src = wide if op.startswith("q") else plays
    per = fns[op](src, ["listener_id"]).persist()
    # a fixed handful of listeners is checked one by one (the grouped run covers all)
    for lid in (0, 7, 23, 49):
        alone = fns[op](src.filter(F.col("listener_id") == lid), [])
        assert _rows(per.filter(F.col("listener_id") == lid)) == _rows(alone, ()), (op, lid)
    per.unpersist()
