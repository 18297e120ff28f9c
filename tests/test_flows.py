"""End-to-end: export files → cleaned fact → wide fact from documents → report."""

from encore.plans import ingest
import pytest

from encore.plans.report import NoPlays, Report, filtered_report
from test_cleaning import rec, write
from test_enrich import b, dump


def test_exports_documents_report(spark, tmp_path):
    write(tmp_path / "raw", "a.json", [
        rec(ts="2020-01-01T10:00:00Z", spotify_track_uri="media:track:t1"),
        rec(ts="2020-01-01T10:00:00Z", spotify_track_uri="media:track:t1"),  # duplicate
        rec(ts="2020-02-01T10:00:00Z", spotify_track_uri="media:track:t2", reason_end="fwdbtn"),
        rec(ts="2021-03-01T10:00:00Z", spotify_track_uri="media:track:t2"),
    ])
    fact = ingest.exports_to_fact(spark, str(tmp_path / "raw"), out=str(tmp_path / "fact"))
    assert fact.count() == 3 and "year" in fact.columns
    dump(tmp_path / "tracks", {
        f"t{i}": {"id": f"t{i}", "name": f"Song {i}", "duration_ms": 1000, "explicit": False, "popularity": 1,
                  "track_number": i, "disc_number": 1, "album": {"id": "al1", "artists": [{"id": "ar1"}]},
                  "artists": [{"id": "ar1"}]} for i in (1, 2)})
    dump(tmp_path / "artists", {"ar1": {"id": "ar1", "name": "Artist X", "followers": {"total": 5},
                                        "genres": ["pop"], "popularity": 9, "images": []}})
    dump(tmp_path / "albums", {"al1": {"id": "al1", "name": "Album 1", "album_type": "album", "label": "L",
                                       "release_date": "2001-01-01", "release_date_precision": "day",
                                       "total_tracks": 2, "popularity": 3, "artists": [{"id": "ar1"}],
                                       "tracks": {"items": [{"id": "t1"}, {"id": "t2"}]}, "images": []}})
    dump(tmp_path / "graph", {"ar1": {"results": {"bindings": [b("genre", "dance")]}}})
    wide = ingest.enrich_fact(spark, fact.drop("year"), str(tmp_path / "tracks"), str(tmp_path / "artists"),
                              str(tmp_path / "albums"), str(tmp_path / "graph"), out=str(tmp_path / "wide"))
    rows = wide.collect()
    assert {r.artist_genres for r in rows} == {"dance;pop"} and {r.album_release_year for r in rows} == {2001}

    from encore.operators import clean

    plays = clean.with_calendar(fact.drop("year"))
    with Report(plays, k=5) as rep:
        assert rep.single_values.first().played_songs == 2
    with pytest.raises(NoPlays):
        filtered_report(plays, (2022, 1), (2022, 12))
    rep = filtered_report(plays, (2020, 1), (2020, 12), "Artist X", k=5)
    assert rep.single_values.first().played_songs == 1
    rep.close()
    # months are numbered from the first month of the whole history, not of the filtered one
    with filtered_report(plays, (2021, 3), (2021, 3), k=5) as rep:
        series = {r.month_index: r.play_count for r in rep.tables["monthly_play_series_artists"].collect()}
    assert series[14] == 1 and set(series) == set(range(15)) and sum(series.values()) == 1
