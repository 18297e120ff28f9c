"""P1–P15 and S1/S2/S7 on hand-made raw export files (FIXTURES §1.1 cases)."""

import datetime as dt
import json


from encore.operators import clean
from encore.sinks import writers
from encore.sources import history


def rec(**kw):
    base = {
        "ts": "2020-01-01T10:00:00Z", "platform": "android", "ms_played": 200000, "conn_country": "DE",
        "ip_addr_decrypted": "1.2.3.4", "master_metadata_track_name": "Song A",
        "master_metadata_album_artist_name": "Artist X", "master_metadata_album_album_name": "Album 1",
        "spotify_track_uri": "media:track:aaa", "episode_name": None, "episode_show_name": None,
        "spotify_episode_uri": None, "reason_start": "fwdbtn", "reason_end": "trackdone", "shuffle": False,
        "skipped": False, "offline": False, "offline_timestamp": 0, "incognito_mode": False,
    }
    base.update(kw)
    return base


def write(path, name, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(json.dumps(rows))


def test_read_and_clean(spark, tmp_path):
    d = tmp_path / "raw"
    write(d, "a.json", [
        rec(),
        rec(),  # exact duplicate → removed
        rec(ip_addr_decrypted="9.9.9.9"),  # differs only in IP → survives (dedup before pruning)
        rec(master_metadata_track_name=None, ts="2020-01-02T10:00:00Z"),  # podcast → dropped
        rec(master_metadata_track_name="None", ts="2020-01-03T10:00:00Z"),  # literal None → dropped
    ])
    write(d, "b.json", [
        rec(ts="2020-02-01T10:00:00Z", offline_timestamp=1577872800, spotify_track_uri="media:track:bbb"),
        rec(ts="2020-02-02T10:00:00Z", offline_timestamp=1577872800500, spotify_track_uri="media:track:ccc"),
        rec(ts="2020-02-03T10:00:00Z", offline_timestamp=1, reason_end="endplay", reason_start="backbtn",
            spotify_track_uri="media:track:ddd"),
        rec(ts="2020-02-04T10:00:00Z", offline_timestamp=None, reason_end="fwdbtn", reason_start="playbtn",
            spotify_track_uri="media:track:eee"),
    ])
    (d / "notes.txt").write_text("ignored")
    raw = history.read_history(spark, str(d))
    assert raw.count() == 9
    out = clean.clean_history(raw)
    rows = {r.track_id: r for r in out.collect()}
    assert out.count() == 6
    assert sum(1 for r in out.collect() if r.track_id == "aaa") == 2
    # seconds epoch replaces ts; ms epoch is divided by 1000 with the fraction kept
    assert rows["bbb"].ts == dt.datetime(2020, 1, 1, 10, 0, 0)
    assert rows["ccc"].ts == dt.datetime(2020, 1, 1, 10, 0, 0, 500000)
    # invalid (≤ 100) and null epochs keep the logged ts
    assert rows["ddd"].ts == dt.datetime(2020, 2, 3, 10, 0, 0)
    assert rows["eee"].ts == dt.datetime(2020, 2, 4, 10, 0, 0)
    assert rows["ddd"].reason_end == "end play" and rows["ddd"].reason_start == "back button"
    assert rows["eee"].reason_end == "forward button" and rows["eee"].reason_start == "play button"
    assert rows["aaa"].reason_start == "forward button"
    assert rows["aaa"].full_play and not rows["ddd"].full_play and not rows["eee"].full_play
    assert out.columns == clean.PLAY_COLUMNS


def test_csv_round_trip(spark, tmp_path):
    d = tmp_path / "raw"
    write(d, "a.json", [rec(), rec(ts="2021-05-06T07:08:09Z", spotify_track_uri="media:track:zzz")])
    plays = clean.clean_history(history.read_history(spark, str(d)))
    out = str(tmp_path / "csv")
    writers.write_csv(plays, out)
    back = history.read_csv(spark, out)
    a = sorted(tuple(r) for r in plays.collect())
    b = sorted(tuple(r) for r in back.collect())
    assert a == b


def test_calendar_and_month_index(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2019, 12, 31, 23, 0)), (1, dt.datetime(2020, 2, 1, 0, 0)), (2, dt.datetime(2020, 3, 5, 1, 0))],
        "listener_id long, ts timestamp_ntz")
    cal = clean.with_calendar(df)
    r = cal.orderBy("ts").first()
    assert (r.year, r.month, r.year_month, r.day_name, r.hour) == (2019, 12, "2019-12", "Tuesday", 23)
    glob = {row.ts: row.month_index for row in clean.with_month_index(cal).collect()}
    assert sorted(glob.values()) == [0, 2, 3]
    per = {(row.listener_id, row.ts): row.month_index for row in clean.with_month_index(cal, ["listener_id"]).collect()}
    assert per[(2, dt.datetime(2020, 3, 5, 1, 0))] == 0
    assert per[(1, dt.datetime(2020, 2, 1, 0, 0))] == 2


def test_round_numeric_and_split(spark):
    df = spark.createDataFrame([("a~~sep~~b", 0.125, 2.675)], "k string, x double, y double")
    r = clean.round_numeric(clean.split_composite(df, "k", ("name", "artist"))).first()
    assert (r.name, r.artist, r.x) == ("a", "b", 0.12)


def test_country_name_and_sort(spark):
    df = spark.createDataFrame([("DE", 2), ("XX", 1), (None, 3)], "conn_country string, n int")
    names = spark.createDataFrame([("DE", "Germany"), ("FR", "France")], "code string, name string")
    got = sorted((r.n, r.conn_country) for r in clean.country_name(df, names).collect())
    assert got == [(1, "unknown"), (2, "Germany"), (3, "unknown")]
    ts = spark.createDataFrame([(dt.datetime(2020, 1, d),) for d in (3, 1, 2)], "ts timestamp_ntz").coalesce(1)
    assert [r.ts.day for r in clean.sort_by_ts(ts).collect()] == [1, 2, 3]
    assert [r.ts.day for r in clean.sort_by_ts(ts, total=True).collect()] == [1, 2, 3]
