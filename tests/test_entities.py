"""Entity documents read once into one table: replaced, malformed and id-less documents; E1 against the table."""

import json
import os

from encore import schemas
from encore.operators import enrich
from encore.sources import entities
from test_enrich import b


def put(folder, name, text, at):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text(text)
    os.utime(folder / f"{name}.json", (at, at))


def artist(i, name="N"):
    return json.dumps({"id": i, "name": name, "followers": {"total": 1}, "genres": [], "popularity": 1, "images": []})


def test_last_version_wins_and_files_are_read_once(spark, tmp_path):
    src, out = tmp_path / "docs", str(tmp_path / "table")
    follow = lambda: entities.update(spark, str(src), out, schemas.ARTIST_DOC, malformed="skip")
    put(src, "a", artist("a", "old"), 1_700_000_000)
    put(src, "b", artist("b"), 1_700_000_001)
    put(src, "c", artist("c")[:20], 1_700_000_002)
    put(src, "d", artist("d")[:20], 1_700_000_002)
    put(src, "n", json.dumps({"name": "no id"}), 1_700_000_002)
    follow()
    names = lambda: {r.id: r.name for r in entities.documents(spark, out).collect()}
    assert names() == {"a": "old", "b": "N"}
    assert sorted(r.path[-6:] for r in entities.rejected(spark, out).collect()) == ["c.json", "d.json"]

    put(src, "a", artist("a", "new"), 1_700_000_100)
    put(src, "c", artist("c", "mended"), 1_700_000_100)
    put(src / "more", "e", artist("e"), 1_700_000_100)
    follow()
    assert names() == {"a": "new", "b": "N", "c": "mended", "e": "N"}
    assert [r.path[-6:] for r in entities.rejected(spark, out).collect()] == ["d.json"]
    read = spark.read.option("recursiveFileLookup", True).parquet(out + "/docs")
    assert read.where("id = 'b'").count() == 1  # unchanged files are not read again
    follow()
    assert names() == {"a": "new", "b": "N", "c": "mended", "e": "N"}

    ids = spark.createDataFrame([("a",), ("x",), ("d",), (None,)], "id string")
    assert sorted(r.id for r in enrich.pending_ids(ids, entities.documents(spark, out)).collect()) == ["d", "x"]


def test_graph_documents_take_their_id_from_the_file(spark, tmp_path):
    src, out = tmp_path / "graph", str(tmp_path / "table")
    put(src, "ar1", json.dumps({"results": {"bindings": [b("genre", "pop")]}}), 1_700_000_000)
    put(src, "ar2", "{}", 1_700_000_000)
    entities.update(spark, str(src), out, schemas.KG_DOC, id_from_name="artist_id")
    got = {r.artist_id: r.results for r in entities.documents(spark, out, "artist_id").collect()}
    assert got["ar2"] is None and got["ar1"].bindings[0].valueLabel.value == "pop"
    artists = spark.createDataFrame([("ar1", "One")], "id string, name string").selectExpr(
        "id", "name", "named_struct('total', 1) followers", "cast(null as array<string>) genres", "1 popularity")
    assert enrich.flatten_artists(artists, entities.documents(spark, out, "artist_id")).first().artist_genres == "pop"


def test_a_malformed_document_fails_unless_skipped(spark, tmp_path):
    import pytest

    put(tmp_path / "docs", "a", artist("a")[:20], 1_700_000_000)
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        entities.update(spark, str(tmp_path / "docs"), str(tmp_path / "t"), schemas.ARTIST_DOC)
