"""What the ingest jobs write and shuffle stays small beside their plays, with the same rows as before."""

import gzip
import itertools
import json
import os
import time
import zipfile

from pyspark.sql import functions as F
from test_scaled_inputs import sf_dir  # noqa: F401

from encore import schemas
from encore.functions import exprs as X
from encore.operators import clean
from encore.session import freed_shuffles, scratch_path
from encore.sources import derived, history, tables
from encore.streaming import ingest
from test_cleaning import rec


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def records_in(path):
    """The records of every export file, and the files by listener."""
    found, files = [], {}
    for folder in os.listdir(path):
        for name in os.listdir(f"{path}/{folder}"):
            texts = json.loads(gzip.open(f"{path}/{folder}/{name}").read())
            files.setdefault(folder, []).append(len(texts))
            found += [(folder, json.dumps(t, sort_keys=True)) for t in texts]
    return sorted(found), files


def test_export_files_lie_in_a_folder_per_listener(spark, sf_dir):  # noqa: F811
    """Before, each file had a folder of its own, made, listed and renamed by itself."""
    raw = tables.plays_raw_wide(spark, sf_dir)
    plays = raw.unionByName(raw.limit(1).withColumn("listener_id", F.lit(None).cast("bigint")))
    want = sorted((f"listener_id={r.listener_id}", json.dumps(json.loads(r.json), sort_keys=True)) for r in derived.raw_export(raw).collect())
    for records in (derived.raw_records(plays), derived.raw_export(plays)):
        path = local(scratch_path(spark, "own-files"))
        derived.export_files(records, path, plays_per_file=10)
        found, files = records_in(path)
        assert found == want and len(files) == len({who for who, _ in want})
        assert max(map(max, files.values())) <= 10 and max(map(len, files.values())) > 1


def test_a_task_that_runs_again_makes_the_same_files(spark, sf_dir):  # noqa: F811
    raw = derived.raw_records(tables.plays_raw_wide(spark, sf_dir))
    a, b = (raw.coalesce(1).orderBy(F.rand(seed)).coalesce(1) for seed in (1, 2))
    paths = [local(scratch_path(spark, "own-files")) for _ in range(2)]
    for records, path in zip((a, b), paths, strict=True):
        derived.export_files(records, path, plays_per_file=10)
    one, two = ({f"{d}/{n}": open(f"{p}/{d}/{n}", "rb").read() for d in os.listdir(p) for n in os.listdir(f"{p}/{d}")} for p in paths)
    assert one == two and one


def test_packed_texts_come_back_as_they_were(spark):
    odd = [None, "", " ", "a", "\x01", "\x02", "\x02n", "\x02e", "\x02s", "\x01\x02", "e\x02\x02s", "n", "é\x00"]
    rows = [(a, i, b, True) for i, (a, b) in enumerate(itertools.product(odd, odd))]
    df = spark.createDataFrame(rows, "a string, i int, b string, c boolean")
    packed = X.pack_texts(df, ["a", "b"])
    assert packed.select("_texts").distinct().count() == len(rows)
    assert sorted(map(str, X.unpack_texts(packed, ["a", "b"], df.columns).collect())) == sorted(map(str, df.collect()))
    twice = clean.dedup_plays(df.unionByName(df).drop("i"))
    assert twice.columns == ["a", "b", "c"] and sorted(map(str, twice.collect())) == sorted(map(str, df.drop("i").collect()))
    assert clean.dedup_plays(df.select("i", "c").unionByName(df.select("i", "c"))).count() == len(rows)


def test_the_dedup_shuffles_the_texts_of_a_play_as_one(spark, sf_dir):  # noqa: F811
    """Before, twelve texts had a slot each."""
    records = derived.parse_export(derived.raw_export(tables.plays_raw_wide(spark, sf_dir)))
    plan = clean.dedup_plays(records)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line][0]
    assert "_texts" in keys and "platform" not in keys and "spotify_track_uri" not in keys


def test_export_zips_make_each_record_once_and_shuffle_none(spark, sf_dir):  # noqa: F811
    """Before, the records were made twice, once to count them, and shuffled as JSON to their archive."""
    made = spark.sparkContext.accumulator(0)
    raw = tables.plays_raw_wide(spark, sf_dir).where("listener_id > 0")
    raw = raw.unionByName(raw.limit(1).withColumn("listener_id", F.lit(None).cast("bigint")))
    records = derived.raw_records(raw).persist()

    def counted(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    path = local(scratch_path(spark, "own-zips"))
    derived.export_zips(records.mapInArrow(counted, records.schema), path, "H", plays_per_member=7, members_per_zip=3)
    known = records.where("listener_id is not null")
    assert made.value == records.count() > known.count()
    found, kinds = [], set()
    for name in os.listdir(path):
        listener = int(name.split("-")[0])
        with zipfile.ZipFile(f"{path}/{name}") as archive:
            members = [m for m in archive.namelist() if m != "ReadMeFirst.txt"]
            kinds |= {(listener, m) for m in members if "plays_" not in m}
            plays = [json.loads(archive.read(m)) for m in members if m.startswith("H/plays_")]
        assert len(plays) <= 3 and all(1 <= len(p) <= 7 for p in plays)
        found += [(listener, json.dumps(p, sort_keys=True)) for p in itertools.chain(*plays)]
    want = [(r.listener_id, json.dumps(json.loads(r.json), sort_keys=True)) for r in known.select("listener_id", derived.record_json().alias("json")).collect()]
    assert sorted(found) == sorted(want)
    who = {r[0] for r in want}
    assert kinds == {(w, m) for w in who for m, on in (("H/cut.json", w % 7 == 0), ("MyData/share.json", w % 5 == 3), ("MyData/Userdata.json", w % 5 == 4)) if on}


def test_archives_are_listed_twice_not_three_times(spark, sf_dir, monkeypatch):  # noqa: F811
    path = scratch_path(spark, "own-zips")
    derived.export_zips(derived.raw_records(tables.plays_raw_wide(spark, sf_dir)), path, history.HISTORY_FOLDER)
    from pyspark.sql import DataFrame

    counts, keep = [], DataFrame.count
    monkeypatch.setattr(DataFrame, "count", lambda self: counts.append(1) or keep(self))
    members = history.archive_members(spark, path, history_only=True)
    assert not counts
    assert keep(members) > 0


def test_export_lines_are_the_records_and_files_follow_from_the_plays(spark, sf_dir):  # noqa: F811
    """Before, records were shuffled to their files as JSON."""
    raw = tables.plays_raw_wide(spark, sf_dir)
    raw = raw.unionByName(raw.where("ms_played = 6000 or hour(ts) = 3").withColumn("artist_name", F.lit(None).cast("string")))
    path = scratch_path(spark, "own-lines")
    derived.export_lines(derived.raw_records(raw), path, parts=3)
    back = spark.read.text(path)
    want = derived.raw_export(raw).selectExpr("cast(listener_id as int) AS listener_id", "json").collect()
    assert sorted((r.listener_id, r.value) for r in back.collect()) == sorted((r.listener_id, r.json) for r in want)
    files = [n for _, _, names in os.walk(local(path)) for n in names if n.endswith(".txt.gz")]
    assert len(files) == back.select("listener_id", "part").distinct().count()


def test_shuffles_of_a_written_table_are_freed(spark, tmp_path):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    df = spark.range(1000).repartition(8, "id")
    with freed_shuffles(spark):
        assert spark.conf.get(key) == "true"
        df.write.parquet(str(tmp_path / "t"))
    assert spark.conf.get(key) == "false"
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before
    assert df.count() == spark.read.parquet(str(tmp_path / "t")).count() == 1000  # what was freed is made again if it is asked for


def test_keys_of_the_ingest_are_short_and_go_as_numbers(spark, tmp_path):
    """Before, a key was the whole SHA-256, 32 bytes that no codec shortens, in shuffle, state, checkpoint and fact."""
    rows = [rec(), rec(), rec(ts="2020-01-05T10:00:00Z"), rec(master_metadata_album_artist_name=None), rec(platform="\x01\x02n")]
    raw = spark.createDataFrame([tuple(r.get(c) for c in schemas.RAW_PLAY.fieldNames()) for r in rows], schemas.RAW_PLAY)
    keyed = ingest.keyed_plays(raw.withColumn("listener_id", F.lit("x")))
    assert {len(r.play_key) for r in keyed.collect()} == {16}
    first = ingest.first_of_keys(keyed)
    assert first.columns == keyed.columns
    assert sorted(map(str, first.collect())) == sorted({str(r) for r in keyed.collect()})
    exchanges = [x for x in first._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and all("_key_1" in x and "_key_2" in x for x in exchanges)
    # halves with leading zeros, and negative ones
    odd = [bytes(16), b"\xff" * 16, bytes(7) + b"\x01" + b"\x80" + bytes(7), bytes(range(16))]
    keys = spark.createDataFrame([(k, "t") for k in odd], "play_key binary, t string")
    assert sorted(bytes(r.play_key) for r in ingest.first_of_keys(keys).collect()) == sorted(odd)


def test_plays_stored_with_longer_keys_are_known(spark, tmp_path):
    raw = spark.createDataFrame([tuple(rec().get(c) for c in schemas.RAW_PLAY.fieldNames())], schemas.RAW_PLAY).withColumn("listener_id", F.lit("x"))
    fresh, out = ingest.keyed_plays(raw), str(tmp_path / "fact")
    longer = fresh.withColumn("play_key", F.concat("play_key", F.lit(b"0123456789abcdef")))
    ingest.store_batch(longer, 0, out, "earlier")
    ingest.store_batch(fresh, 0, out, "later", ingest.other_runs(spark, out, "later"))
    assert ingest.stored(spark, out).count() == 1
