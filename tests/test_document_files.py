"""Documents listed and read by tasks are those that Spark's reader gives."""

import datetime as dt
import json
import os

import pytest
from test_entities import artist
from test_scaled_inputs import _bindings, _plan, sf_dir  # noqa: F401

from encore import schemas
from encore.session import scratch_path
from encore.sources import derived, entities, files

A = artist("a")
ODD = {
    "plain": A, "empty": "", "blank": " \n", "null": "null", "number": "5", "text": '"x"', "array": f"[{A},{A}]", "no array": "[]",
    "array with a bad one": f'[{A},{{"id":"b","popularity":"abc"}}]', "array with a number": f"[{A},5]", "array with null": f"[{A},null]",
    "cut array": f"[{A},", "array in array": f"[[{A}]]", "bad value": '{"id":"a","popularity":"abc","name":"N"}',
    "bad value below": '{"id":"a","followers":{"total":"q"}}', "cut": A[:20], "more": A + " xx", "two": A + A, "nothing": "{}",
    "other key": '{"id":"a","z":1}', "too big": '{"id":"a","popularity":99999999999}', "number as text": '{"id":5,"name":true}',
    "mark first": "﻿" + A, "control": '{"id":"a\tb"}', "spaces first": " \n" + A, "ü%20#?[x]": A, "x=1": A, "_a=1": A, "_hidden": A, ".hidden": A,
    "k=1/in a folder": A, "deep/er/still": A, "_no/data": A,
}


@pytest.fixture
def folder(tmp_path):
    for name, text in ODD.items():
        path = tmp_path / "docs" / f"{name}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    for name, data in {"utf-16": A.encode("utf-16"), "utf-16 le": A.encode("utf-16-le"), "utf-32": A.encode("utf-32-be"), "no text": b'{"id":"\xff\xfe"}'}.items():
        (tmp_path / "docs" / f"{name}.json").write_bytes(data)
    (tmp_path / "docs" / "other.txt").write_text(A)
    for n, path in enumerate(sorted((tmp_path / "docs").rglob("*.json"))):
        os.utime(path, ns=(0, (1_700_000_000_000 + n * 900) * 1_000_000 + 123_456))
    return str(tmp_path / "docs")


def good_and_bad(docs):
    """Good documents with version and file, and the files of bad ones."""
    rows = docs.collect()
    bad = {(r[entities.FILE], r[entities.VERSION]) for r in rows if r[entities.CORRUPT] is not None}
    return sorted(str(r) for r in rows if (r[entities.FILE], r[entities.VERSION]) not in bad), bad


@pytest.mark.parametrize("after", [None, dt.datetime(2023, 11, 14, 22, 13, 33)])
@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_the_same_documents_as_by_sparks_reader(spark, folder, after, scheme):
    assert files.by_tasks(spark, scheme + folder)
    got, want = (good_and_bad(read(spark, scheme + folder + "/", schemas.ARTIST_DOC, after, True)) for read in (entities._read_by_tasks, entities._read_by_spark))
    assert got == want and len(want[0]) > 3 and len(want[1]) > 3
    single = folder + "/array.json"
    one, two = (good_and_bad(read(spark, single, schemas.ARTIST_DOC, None, True)) for read in (entities._read_by_tasks, entities._read_by_spark))
    assert one == two and len(one[0]) == 2


@pytest.mark.parametrize("name", [n for n in ODD if "/" not in n and not n.startswith((".", "_h"))])
def test_what_fails_is_the_same(spark, tmp_path, name):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.json").write_text(ODD[name], encoding="utf-8")
    found = []
    for ranged in (True, False):
        try:
            entities.update(spark, str(tmp_path / "docs"), str(tmp_path / f"t{ranged}"), schemas.ARTIST_DOC, ranged=ranged)
            found.append(sorted(map(str, entities._table(spark, str(tmp_path / f"t{ranged}/docs")).collect())))
        except Exception as error:
            assert "malformed" in str(error).lower()
            found.append("fails")
    assert found[0] == found[1]


def test_updates_by_tasks_name_no_file_on_the_driver(spark, tmp_path, monkeypatch):
    """Before, Spark's reader kept the name, times and place of every file on the driver."""
    (tmp_path / "docs").mkdir()
    for i in range(20):
        (tmp_path / "docs" / f"{i}.json").write_text(artist(str(i)))
    monkeypatch.setattr(entities, "_read_by_spark", None, raising=False)
    plans, keep = [], entities._read_by_tasks
    monkeypatch.setattr(entities, "_read_by_tasks", lambda *a: plans.append(keep(*a)) or plans[-1])
    entities.update(spark, str(tmp_path / "docs"), str(tmp_path / "t"), schemas.ARTIST_DOC, malformed="skip")
    assert entities.documents(spark, str(tmp_path / "t")).count() == 20
    assert "FileScan" not in _plan(plans[0]) and not plans[0].inputFiles()


def test_globs_and_unknown_stores_are_left_to_spark(spark, tmp_path):
    (tmp_path / "docs" / "x").mkdir(parents=True)
    (tmp_path / "docs" / "x" / "a.json").write_text(A)
    for path in (f"{tmp_path}/docs/*", "viewfs://store/in", f"{tmp_path}/none", "docs"):
        assert not files.by_tasks(spark, path)
    entities.update(spark, f"{tmp_path}/docs/*", str(tmp_path / "t"), schemas.ARTIST_DOC, id_from_name="stem")
    assert [r.stem for r in entities.documents(spark, str(tmp_path / "t")).collect()] == ["a"]


def test_s9_binds_the_plays_once_and_writes_with_several_tasks(spark, sf_dir, monkeypatch):  # noqa: F811
    """Before, the plays were bound for each of two writes of the documents and for the graph, and one task wrote all files."""
    from encore.plans import catalog

    given = {}
    for kind in ("artist_docs", "kg_docs"):
        monkeypatch.setattr(derived, kind, lambda raw, kind=kind, keep=getattr(derived, kind): given.setdefault(kind, raw) and keep(raw))
    out = catalog.ingest_queries()["s9_entity_documents"](spark, sf_dir)
    assert out.count() == given["artist_docs"].select("artist_id").distinct().count() == 5
    assert _bindings(_plan(given["artist_docs"])) == _bindings(_plan(given["kg_docs"])) == 0
    path = scratch_path(spark, "own-docs")
    derived.document_files(spark.createDataFrame([(str(i), "x") for i in range(50)], "id string, name string").coalesce(1), path)
    local = path.removeprefix("file://")
    assert sorted(os.listdir(local)) == sorted(f"{i}.json" for i in range(50))
    assert json.loads(open(f"{local}/7.json").read()) == {"id": "7", "name": "x"}
