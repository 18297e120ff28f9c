"""Plans over a written fact: how often it is scanned, and what the first aggregate over it is."""

import contextlib
import io
import re

import pytest
from conftest import SF_SMALL

from encore.checks import recipes_sql as P
from encore.operators import recipes, report
from encore.plans import catalog


@pytest.fixture(scope="module")
def fact(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "fact")
    catalog.plays(spark, SF_SMALL).write.parquet(path)
    return spark.read.parquet(path)


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("by", [(), ("listener_id",)])
@pytest.mark.parametrize("name,scans", [
    ("most_played_artists", 1), ("most_played_tracks", 1), ("most_played_monthly", 1), ("top_songs_of_top_artists", 1),
    ("monthly_play_series", 2),
])
def test_report_scans(fact, name, scans, by):
    args = ("artist",) if name == "monthly_play_series" else ()
    text = plan(getattr(report, name)(fact, *args, by=by))
    # the k rows of R5 feed its statistics and its series: the same subplan, which the run reuses
    found = text.count("FileScan parquet")
    assert found == scans or name == "monthly_play_series" and found <= 2 * scans


@pytest.mark.parametrize("by", [(), ("listener_id",)])
@pytest.mark.parametrize("recipe,args", [
    (recipes.top_track_per_female_artist, (P.AS_OF,)), (recipes.artists_without_kg_by_hours, ()),
    (recipes.artists_without_kg_by_popularity, ()), (recipes.top_solo_tracks_by_release_era, ()),
    (recipes.top_tracks_in_genre, ()), (recipes.discovered_in_year, (P.DISCOVERY_YEAR,)), (recipes.never_finished, ()),
    (recipes.not_played_since, (P.AS_OF,)), (recipes.top_artist_per_top_country, ()), (recipes.least_played_of_top_albums, ()),
])
def test_recipes_scan_once_and_hash_the_fact(fact, recipe, args, by):
    text = plan(recipe(fact, *args, by=by))
    assert text.count("FileScan parquet") == 1
    aggregates = re.findall(r"(\w*Aggregate)\(", text)
    assert aggregates[-1] == "HashAggregate"  # the lowest one


def test_first_values_change_over_time(spark):
    rows = [("t1", None, "2020-01-01", 1), ("t1", "old", "2020-01-02", 2), ("t1", "new", "2020-01-03", 3), ("t2", None, "2020-01-01", 4)]
    df = spark.createDataFrame(rows, "track_id string, track_name string, day string, ms_played long").selectExpr(
        "track_id", "track_name", "cast(day as timestamp_ntz) as ts", "ms_played")
    from pyspark.sql import functions as F

    from encore.operators.common import grouped_firsts

    out = grouped_firsts(df, ["track_id"], ["track_name"], {"ms": F.sum("ms_played")}).collect()
    assert sorted((r.track_id, r.track_name, r.ms) for r in out) == [("t1", "old", 6), ("t2", None, 4)]


@pytest.mark.parametrize("by", [(), ("listener_id",)])
def test_kpis_scan_the_fact_twice_without_expand(spark, fact, by):
    from encore.operators import kpis

    df = kpis.single_values(fact, by)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    final = final[:final.index("== Initial Plan ==")]
    assert final.count("FileScan parquet") <= 2 and "Expand" not in final
