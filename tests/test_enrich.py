"""E1–E14 and S9 on hand-made nested documents (FIXTURES §1.2–1.5 cases)."""

import datetime as dt
import json

from pyspark.sql import functions as F

from encore.operators import enrich
from encore.sources import documents


def dump(folder, docs):
    folder.mkdir(parents=True, exist_ok=True)
    for name, doc in docs.items():
        (folder / f"{name}.json").write_text(json.dumps(doc))


def b(prop, value, item="http://www.wikidata.org/entity/Q42"):
    return {"item": {"value": item}, "propLabel": {"value": prop}, "valueLabel": {"value": value}}


def test_tracks_albums_and_join(spark, tmp_path):
    dump(tmp_path / "tracks", {
        "t1": {"id": "t1", "name": "One", "duration_ms": 1000, "explicit": True, "popularity": 5, "track_number": 1,
               "disc_number": 1, "album": {"id": "al1", "artists": [{"id": "ar1"}, {"id": "ar3"}]},
               "artists": [{"id": "ar1"}, {"id": "ar2"}]},
        "t2": {"id": "t2", "name": "Two", "duration_ms": 2000, "explicit": False, "popularity": 6, "track_number": 2,
               "disc_number": 1, "album": {"id": "al2", "artists": [{"id": "ar2"}]}, "artists": [{"id": "ar2"}]},
    })
    tracks = enrich.flatten_tracks(documents.read_track_docs(spark, str(tmp_path / "tracks")))
    t = {r.track_id: r for r in tracks.collect()}
    assert t["t1"].artist_id == "ar1" and t["t1"].artist_ids == "ar1;ar2" and t["t1"].album_id == "al1"
    ref = {(r.kind, r.id) for r in enrich.referenced_ids(documents.read_track_docs(spark, str(tmp_path / "tracks"))).collect()}
    assert ref == {("album", "al1"), ("album", "al2"), ("artist", "ar1"), ("artist", "ar2"), ("artist", "ar3")}

    albums_docs = {}
    for i, date in enumerate(["1999", "1999-05", "1999-05-01", "1900-01-01", "garbage"]):
        albums_docs[f"al{i}"] = {"id": f"al{i}", "name": f"A{i}", "album_type": "album", "label": "L",
                                 "release_date": date, "release_date_precision": "day", "total_tracks": 2,
                                 "popularity": 3, "artists": [{"id": "ar1"}],
                                 "tracks": {"items": [{"id": "t1"}, {"id": "t2"}]}, "images": []}
    dump(tmp_path / "albums", albums_docs)
    albums = enrich.flatten_albums(documents.read_album_docs(spark, str(tmp_path / "albums")))
    years = {r.album_id: r.album_release_year for r in albums.collect()}
    assert years == {"al0": 1999, "al1": 1999, "al2": 1999, "al3": 0, "al4": None}
    assert albums.first().album_track_ids == "t1;t2"

    plays = spark.createDataFrame([("t1", 3_600_000), ("t2", 1_800_000), ("tx", 1)], "track_id string, ms_played long")
    with_artist = enrich.attach_primary_artist(plays, tracks)
    assert with_artist.columns[:2] == ["track_id", "artist_id"]
    artists = spark.createDataFrame([("ar1", "Name1")], "artist_id string, artist_name string")
    wide = enrich.wide_fact(with_artist, tracks, albums, artists)
    w = {r.track_id: r for r in wide.collect()}
    assert w["t1"].artist_name == "Name1" and w["t1"].hours_played == 1.0
    assert w["tx"].artist_id is None and wide.count() == 3


def test_artists_with_graph_fold(spark, tmp_path):
    dump(tmp_path / "artists", {
        "ar1": {"id": "ar1", "name": "Solo", "followers": {"total": 10}, "genres": ["pop", "art rock"],
                "popularity": 50, "images": [{"url": "http://i/1.jpg"}]},
        "ar2": {"id": "ar2", "name": "Band", "followers": {"total": 20}, "genres": None, "popularity": 40,
                "images": []},
        "ar3": {"id": "ar3", "name": "Nobody", "followers": {"total": 0}, "genres": [], "popularity": 1,
                "images": [{"url": ""}]},
        "ar4": {"id": "ar4", "name": "Empty", "followers": {"total": 1}, "genres": [], "popularity": 2,
                "images": [{"url": "http://i/4.jpg"}]},
    })
    dump(tmp_path / "kg", {
        "ar1": {"results": {"bindings": [
            b("instance of", "human"), b("instance of", "unknown thing"), b("Sex or Gender", "female"),
            b("country of origin", "France"), b("country of citizenship", "Germany"),
            b("date of birth", "1980-02-03T00:00:00Z"), b("genre", "chanson"), b("genre", "pop"),
            b("official website", "http://a.example")]}},
        "ar2": {"results": {"bindings": [b("instance of", "musical group", "http://www.wikidata.org/entity/Q7"),
                                         b("date of birth", "not a date", "http://www.wikidata.org/entity/Q7")]}},
        "ar3": {},
        "ar4": {"results": {"bindings": []}},
    })
    kg = documents.read_kg_docs(spark, str(tmp_path / "kg"))
    out = {r.artist_id: r for r in enrich.flatten_artists(
        documents.read_artist_docs(spark, str(tmp_path / "artists")), kg).collect()}
    a1 = out["ar1"]
    assert (a1.is_band, a1.gender, a1.country, a1.website) == (False, "female", "Germany", "http://a.example")
    assert a1.artist_genres == "art rock;chanson;pop" and a1.wikidata_entity_id == "Q42"
    assert a1.birth_date == dt.datetime(1980, 2, 3)
    a2 = out["ar2"]
    assert (a2.is_band, a2.birth_date, a2.artist_genres, a2.wikidata_entity_id) == (True, None, "", "Q7")
    for k in ("ar3", "ar4"):
        assert out[k].wikidata_entity_id is None and out[k].is_band is None and out[k].artist_genres == ""

    docs = documents.read_artist_docs(spark, str(tmp_path / "artists"))
    cached = spark.createDataFrame([("ar4",)], "id string")
    work = {(r.id, r.url) for r in enrich.image_worklist(docs, cached).collect()}
    assert work == {("ar1", "http://i/1.jpg")}


def test_pending_and_batches(spark):
    ids = spark.range(0, 1234).select(F.col("id").cast("string").alias("id"))
    cached = spark.range(0, 1234, 2).select(F.col("id").cast("string").alias("id"))
    pend = enrich.pending_ids(ids.union(ids), cached)
    assert pend.count() == 617
    batches = enrich.batch_ids(pend.repartition(5), 50).collect()
    assert max(len(r.ids) for r in batches) <= 50
    assert len(batches) == -(-617 // 50)  # full but for the last one
    again = enrich.batch_ids(pend.repartition(3), 50).collect()
    assert sorted((r.batch, tuple(r.ids)) for r in again) == sorted((r.batch, tuple(r.ids)) for r in batches)
    short = [r for r in enrich.batch_ids(pend, 50, bucket_batches=4).collect() if len(r.ids) < 50]
    assert len(short) <= -(-617 // 200)  # at most one per bucket
    assert sorted(i for r in batches for i in r.ids) == sorted(r.id for r in pend.collect())
