"""Export archives read as binary files, unzipped per archive, classified."""

import json
import zipfile

import pytest

from encore.operators import clean
from encore.sources import archives, history


def make_zip(path, members):
    with zipfile.ZipFile(path, "w") as zf:
        for name, content in members.items():
            zf.writestr(name, content)


def play(ts, track):
    return {"ts": ts, "ms_played": 1000, "master_metadata_track_name": track,
            "master_metadata_album_artist_name": "A", "spotify_track_uri": f"media:track:{track}",
            "reason_start": "clickrow", "reason_end": "trackdone", "shuffle": True, "offline": False,
            "incognito_mode": False}


def test_ingest_and_classify(spark, tmp_path):
    folder = history.HISTORY_FOLDER
    make_zip(tmp_path / "good.zip", {
        f"{folder}/Streaming_History_Audio_2020.json": json.dumps([play("2020-01-01T00:00:00Z", "t1"),
                                                                  play("2020-01-02T00:00:00Z", "t2")]),
        f"{folder}/Streaming_History_Audio_2021.json": json.dumps([play("2021-01-01T00:00:00Z", "t3")]),
        "ReadMeFirst.pdf": "x",
        "other.json": json.dumps([play("2019-01-01T00:00:00Z", "t0")]),
    })
    make_zip(tmp_path / "tech.zip", {"MyData/share.json": "[]", "MyData/x.json": "[]"})
    make_zip(tmp_path / "account.zip", {"MyData/Userdata.json": "{}"})

    plays = history.ingest_archives(spark, str(tmp_path), history_only=True)
    assert sorted(r.master_metadata_track_name for r in plays.collect()) == ["t1", "t2", "t3"]
    every = history.ingest_archives(spark, str(tmp_path / "good.zip"), history_only=False)
    assert every.count() == 4
    cleaned = clean.clean_history(plays.drop("archive", "member"))
    assert cleaned.filter("full_play").count() == 3
    assert {r.listener_id for r in cleaned.collect()} == {"good"}

    kinds = {r.archive.rsplit("/", 1)[-1]: r.kind
             for r in history.classify_archives(history.archive_manifest(spark, str(tmp_path))).collect()}
    assert kinds == {"good.zip": "streaming_history", "tech.zip": "technical_log", "account.zip": "account_data"}


def test_the_same_play_in_two_archives_stays_two_plays(spark, tmp_path):
    member = f"{history.HISTORY_FOLDER}/a.json"
    for name in ("ann", "bob"):
        make_zip(tmp_path / f"{name}.zip", {member: json.dumps([play("2020-01-01T00:00:00Z", "t1")] * 2)})
    out = clean.clean_history(history.ingest_archives(spark, str(tmp_path)).drop("archive", "member")).collect()
    assert sorted(r.listener_id for r in out) == ["ann", "bob"]
    alone = history.ingest_archives(spark, str(tmp_path), listener=None).drop("archive", "member")
    assert "listener_id" not in alone.columns and clean.clean_history(alone).count() == 1


def test_malformed_members_fail_or_are_listed(spark, tmp_path):
    whole = json.dumps([play("2020-01-01T00:00:00Z", f"t{i}") for i in range(5)])
    folder = history.HISTORY_FOLDER
    make_zip(tmp_path / "x.zip", {f"{folder}/good.json": whole, f"{folder}/cut.json": whole[:len(whole) // 2]})
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        history.ingest_archives(spark, str(tmp_path)).collect()
    assert history.ingest_archives(spark, str(tmp_path), malformed="skip").count() == 5
    [bad] = history.rejected_members(spark, str(tmp_path)).collect()
    assert bad.member.endswith("cut.json") and bad.reason


def test_malformed_files_fail_or_are_listed(spark, tmp_path):
    whole = json.dumps([play("2020-01-01T00:00:00Z", f"t{i}") for i in range(5)])
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann" / "good.json").write_text(whole)
    (tmp_path / "ann" / "cut.json").write_text(whole[:len(whole) // 2])
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        history.read_history(spark, str(tmp_path / "ann")).collect()
    good = history.read_history(spark, str(tmp_path / "ann"), malformed="skip", listener=r"/([^/]+)/[^/]+\.json$").collect()
    assert [r.listener_id for r in good] == ["ann"] * 5
    [bad] = history.rejected_files(spark, str(tmp_path / "ann")).collect()
    assert bad.path.endswith("cut.json") and bad.reason


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, file, total):
        self.file, self.total = file, total

    def read(self, n=None):
        data = self.file.read(n)
        self.total[0] += len(data)
        return data

    def __getattr__(self, name):
        return getattr(self.file, name)


def test_a_directory_takes_the_end_of_an_archive_only(tmp_path):
    import os

    found = []
    for size in (10_000, 5_000_000):
        path = tmp_path / f"{size}.zip"
        make_zip(path, {"MyData/share.json": "[]", "big.json": os.urandom(size)})
        total = [0]
        members = [m for _, m, _ in archives._directory(Counted(archives.opened(str(path)), total), str(path))]
        assert members == ["MyData/share.json", "big.json"]
        found.append(total[0])
    assert found[0] == found[1] < 5000


def test_members_of_one_archive_are_dealt_over_tasks_and_only_wanted_ones_are_read(spark, tmp_path):
    folder = history.HISTORY_FOLDER
    make_zip(tmp_path / "an export.zip", {
        **{f"{folder}/p{i}.json": json.dumps([play("2020-01-01T00:00:00Z", f"t{i}")]) for i in range(12)},
        f"{folder}/bad.json": b"\xff\xfe", "video.bin": b"\x00" * 1000})
    one = history.archive_members(spark, str(tmp_path), history_only=True)
    assert one.rdd.getNumPartitions() > 1 and one.count() == 13
    whole = history.archive_members(spark, str(tmp_path), history_only=True, ranged=False)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, whole.collect()))
    assert history.ingest_archives(spark, str(tmp_path), malformed="skip").count() == 12
    assert [r.member[-8:] for r in history.rejected_members(spark, str(tmp_path)).collect()] == ["bad.json"]
    a, b = (sorted(map(tuple, history.archive_manifest(spark, str(tmp_path), ranged=r).collect())) for r in (True, False))
    assert a == b and len(a) == 14


def test_a_folder_without_archives(spark, tmp_path):
    make_zip(tmp_path / "empty.zip", {})
    assert history.archive_manifest(spark, str(tmp_path)).count() == 0
    assert history.ingest_archives(spark, str(tmp_path)).count() == 0
