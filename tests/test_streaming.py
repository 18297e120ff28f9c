"""Incremental ingest equals the batch cleaning on the same files; R11 kept up to date equals R11."""

import json

import pytest
from pyspark.sql import functions as F

from encore.operators import clean, report
from encore.sources import history
from encore.streaming import ingest, yearly
from test_cleaning import rec

LISTENER = r"/([^/]+)/[^/]+\.json$"


def run(spark, src, out, ckpt, **options):
    q = ingest.start_ingest(spark, str(src), str(out), checkpoint=str(ckpt), **options)
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def rows(df, *extra):
    return sorted(str(tuple(r)) for r in df.select(*extra, *clean.PLAY_COLUMNS).collect())


def test_stream_ingest_matches_batch(spark, tmp_path):
    src = tmp_path / "drop"
    src.mkdir()
    (src / "a.json").write_text(json.dumps([rec(), rec(), rec(ts="2020-01-05T10:00:00Z", reason_end="fwdbtn"),
                                            rec(master_metadata_track_name=None)]))
    (src / "b.json").write_text(json.dumps([rec(ts="2020-02-01T10:00:00Z", offline_timestamp=1577872800500,
                                                spotify_track_uri="media:track:zzz")]))
    out = tmp_path / "fact"
    run(spark, src, out, tmp_path / "ckpt")
    got = rows(ingest.stored(spark, str(out)))
    want = rows(clean.clean_history(history.read_history(spark, str(src))))
    assert got == want and len(got) == 3

    # a new file arriving later is picked up by a restart from the same checkpoint; it holds
    # plays years older than those already ingested and must not be dropped as late data
    (src / "c.json").write_text(json.dumps([rec(ts="2012-03-01T10:00:00Z", spotify_track_uri="media:track:old"),
                                            rec(ts="2012-03-01T10:00:00Z", spotify_track_uri="media:track:old"), rec()]))
    run(spark, src, out, tmp_path / "ckpt")
    back = ingest.stored(spark, str(out))
    assert back.count() == 4 and back.filter("track_id = 'old'").count() == 1


def test_result_does_not_depend_on_files_per_trigger(spark, tmp_path):
    src = tmp_path / "drop"
    src.mkdir()
    for n in range(5):  # every file repeats the plays of the one before, once with a null flag
        plays = [rec(ts=f"2020-01-0{m + 1}T10:00:00Z", skipped=None if m == n else False) for m in range(max(0, n - 1), n + 1)]
        (src / f"{n}.json").write_text(json.dumps(plays))
    found = []
    for size in (1, 2, 100):
        out = tmp_path / f"fact{size}"
        run(spark, src, out, tmp_path / f"ckpt{size}", max_files_per_trigger=size)
        found.append(rows(ingest.stored(spark, str(out))))
    want = rows(clean.clean_history(history.read_history(spark, str(src))))
    assert found == [want] * 3 and len(want) == 5


def test_the_same_play_of_two_listeners_is_two_plays(spark, tmp_path):
    for name in ("ann", "bob"):
        (tmp_path / "drop" / name).mkdir(parents=True)
        (tmp_path / "drop" / name / "plays.json").write_text(json.dumps([rec(), rec()]))
    run(spark, tmp_path / "drop", tmp_path / "fact", tmp_path / "ckpt", listener=LISTENER)
    got = rows(ingest.stored(spark, str(tmp_path / "fact")), "listener_id")
    want = rows(clean.clean_history(history.read_history(spark, str(tmp_path / "drop" / "*"), listener=LISTENER)), "listener_id")
    assert got == want and len(got) == 2
    run(spark, tmp_path / "drop", tmp_path / "alone", tmp_path / "ckpt2")
    assert [r.listener_id for r in ingest.stored(spark, str(tmp_path / "alone")).collect()] == [None]


def test_a_new_checkpoint_keeps_what_is_stored_and_adds_nothing_twice(spark, tmp_path):
    src = tmp_path / "drop"
    src.mkdir()
    old, new = rec(ts="2015-01-01T10:00:00Z"), rec(ts="2021-01-01T10:00:00Z")
    (src / "a.json").write_text(json.dumps([old, rec()]))
    out = tmp_path / "fact"
    run(spark, src, out, tmp_path / "first")
    (src / "a.json").rename(tmp_path / "a.moved")
    (src / "b.json").write_text(json.dumps([rec(), new]))
    run(spark, src, out, tmp_path / "second")
    assert sorted(r.ts.year for r in ingest.stored(spark, str(out)).collect()) == [2015, 2020, 2021]
    # everything again under a third checkpoint, in two batches
    (src / "c.json").write_text(json.dumps([old, new, rec()]))
    run(spark, src, out, tmp_path / "third", max_files_per_trigger=1)
    assert ingest.stored(spark, str(out)).count() == 3
    assert ingest.stored(spark, str(out)).select(ingest.RUN).distinct().count() >= 2


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([rec()]))
    raw = history.read_history(spark, str(tmp_path)).withColumn("listener_id", F.lit("x"))
    fresh, out = ingest.keyed_plays(raw), str(tmp_path / "fact")
    for batch in (0, 0):
        ingest.store_batch(fresh, batch, out, "run")
    assert ingest.stored(spark, out).count() == 1
    assert ingest.other_runs(spark, out, "run") is None
    ingest.store_batch(fresh, 0, out, "later", ingest.other_runs(spark, out, "later"))
    assert ingest.stored(spark, out).count() == 1


def test_a_batch_of_a_run_reads_nothing_of_the_fact(spark, tmp_path, monkeypatch):
    src = tmp_path / "drop"
    src.mkdir()
    for n in range(4):
        (src / f"{n}.json").write_text(json.dumps([rec(ts=f"20{n + 10}-01-0{m + 1}T10:00:00Z") for m in range(n + 2)]))
    others = []
    keep = ingest.store_batch

    def watched(fresh, batch_id, out, run_, other=None):
        others.append(other)
        keep(fresh, batch_id, out, run_, other)

    monkeypatch.setattr(ingest, "store_batch", watched)
    q = run(spark, src, tmp_path / "fact", tmp_path / "ckpt", max_files_per_trigger=1)
    assert others == [None] * 4
    state = [p["stateOperators"][0] for p in (json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress) if p["stateOperators"]]
    assert max(s["numRowsTotal"] for s in state) == 14 and "rocksdb" in json.dumps(state).lower()


PLAYS = "track_name string, artist_name string, year int, full_play boolean"


@pytest.mark.parametrize("compact_every", [2, 100])
def test_yearly_counts_of_batches_in_any_order(spark, tmp_path, compact_every):
    batches = [
        [("a", "x", 2020, True), ("a", "x", 2020, True), ("b", "x", 2020, False), (None, "x", 2020, True)],
        [("a", "x", 2018, True), ("b", "x", 2021, True), ("a", "y", 2020, True)],  # an older play of a known track
        [("a", "x", 2018, True), ("b", None, 2018, True)],
        [("b", "x", 2017, True), ("a", "x", 2019, True)],
        [],
        [("b", "x", 2016, True), ("c", "x", 2016, False)],
    ]
    path, seen = str(tmp_path / "state"), []
    for n, batch in enumerate(batches):
        seen += batch
        for _ in range(2 if n in (1, 3) else 1):  # a batch that runs again
            yearly.update(spark.createDataFrame(batch, PLAYS), n, path, compact_every=compact_every)
        got = sorted(tuple(r) for r in yearly.current(spark, path).collect())
        want = sorted(tuple(r) for r in report.yearly_track_play_count(spark.createDataFrame(seen, PLAYS)).collect())
        assert got == want
    changes = spark.read.parquet(path + "/changes")
    assert changes.where("new < 0").count() >= 2  # taken back from the years they were counted in


def test_yearly_counts_per_listener(spark, tmp_path):
    schema = "listener_id int, " + PLAYS
    first = [(1, "a", "x", 2020, True), (2, "a", "x", 2019, True)]
    late = [(1, "a", "x", 2010, True), (2, "a", "x", 2020, True)]
    for n, batch in enumerate((first, late)):
        yearly.update(spark.createDataFrame(batch, schema), n, str(tmp_path), by=["listener_id"])
    got = sorted(tuple(r) for r in yearly.current(spark, str(tmp_path), by=["listener_id"]).collect())
    want = report.yearly_track_play_count(spark.createDataFrame(first + late, schema), by=["listener_id"])
    assert got == sorted(tuple(r) for r in want.collect())
