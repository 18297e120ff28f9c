"""First values in time where several plays have one time: the nine recipes against DuckDB, on any partitioning."""

import pytest
from conftest import SF_MID
from oracle_check import duck
from pyspark.sql import functions as F

from encore.checks import recipes_sql as P
from encore.checks import sqltext
from encore.plans import catalog
from encore.session import scratch_path

RECIPES = ["q02_top_tracks_of_artist", "q05_top_track_per_female_artist", "q06_artists_without_kg_by_hours",
           "q07_artists_without_kg_by_popularity", "q09_top_solo_tracks_by_release_era", "q11_top_tracks_in_genre",
           "q15_discovered_in_year", "q16_never_finished", "q19_not_played_since"]


@pytest.fixture(scope="module")
def tied(spark):
    """The bound history with times cut to the year, and names that differ from play to play."""
    wide = catalog.wide(spark, SF_MID)
    other = F.concat(F.lit(" v"), (F.col("ms_played") / 6000 % 3).cast("int").cast("string"))
    rows = wide.withColumns({"ts": F.date_trunc("year", F.col("ts").cast("timestamp")).cast("timestamp_ntz"),
                             "track_name": F.concat("track_name", other), "album_name": F.concat("album_name", other)})
    path = scratch_path(spark, "tied")
    rows.write.parquet(path)
    con = duck(SF_MID)
    con.sql(f"CREATE VIEW tied AS SELECT * FROM '{path.replace('file:', '')}/*.parquet'")
    return spark.read.parquet(path), con


def shown(rows):
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", RECIPES)
def test_recipes_on_tied_times(spark, tied, name, monkeypatch):
    fact, con = tied
    found = []
    for n in (1, 7):
        monkeypatch.setattr(catalog, "wide", lambda s, d, n=n: fact.repartition(n))
        df = catalog.recipe_queries()[name](spark, SF_MID)
        columns = sorted(df.columns)
        found.append(shown(df.select(*columns).collect()))
    assert found[0] == found[1]
    prefix = sqltext.with_wide("").rstrip()
    sql = P.recipe_sql()[name]
    assert sql.startswith(prefix)
    body = sql[len(prefix):]
    rel = con.sql("WITH wide AS (SELECT * FROM tied)" + body)
    order = [rel.columns.index(c) for c in columns]
    assert shown([tuple(r[i] for i in order) for r in rel.fetchall()]) == found[0] and found[0]
