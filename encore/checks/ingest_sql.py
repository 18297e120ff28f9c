"""Oracle SQL for the cleaning (P) and enrichment (E) chains over inputs derived
from the driver tables by ``sources.derived`` — each stated directly from the
derivation rules, independent of the Spark code path (JSON round trips,
nested documents, folds)."""

from __future__ import annotations

from encore.checks.sqltext import RAW_WIDE, WIDE

_REASON_START = ("CASE {c} WHEN 'backbtn' THEN 'back button' WHEN 'fwdbtn' THEN 'forward button' "
                 "WHEN 'playbtn' THEN 'play button' ELSE {c} END")
_REASON_END = ("CASE {c} WHEN 'backbtn' THEN 'back button' WHEN 'endplay' THEN 'end play' "
               "WHEN 'fwdbtn' THEN 'forward button' ELSE {c} END")


def clean_history_sql() -> str:
    epoch = "(CAST(epoch(ts) AS BIGINT) - 3600)"
    return f"""WITH raw AS ({RAW_WIDE}),
rec AS (
  SELECT listener_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_text, platform, ms_played, conn_country,
    '10.' || CAST(listener_id AS VARCHAR) || '.0.1' AS ip,
    CASE WHEN ms_played = 6000 THEN NULL WHEN ms_played = 12000 THEN 'None' ELSE track_name END AS tn,
    artist_name AS an, album_name AS aln, 'media:track:' || track_id AS uri,
    CASE WHEN ms_played = 6000 THEN 'episode ' || track_name END AS ep,
    reason_start, reason_end, shuffle, reason_end = 'fwdbtn' AS skipped, offline,
    CASE WHEN NOT offline THEN (CASE WHEN listener_id % 3 = 0 THEN 0 END)
         WHEN listener_id % 2 = 0 THEN {epoch} * 1000 + 500 ELSE {epoch} END AS ots,
    incognito_mode, hour(ts) AS h
  FROM raw),
allrec AS (SELECT * EXCLUDE (h) FROM rec UNION ALL SELECT * EXCLUDE (h) FROM rec WHERE h = 3),
dedup AS (SELECT DISTINCT * FROM allrec WHERE tn IS NOT NULL AND tn <> 'None'),
secs AS (SELECT *, CASE WHEN ots > 2000000000 THEN ots / 1000 ELSE CAST(ots AS DOUBLE) END AS s FROM dedup)
SELECT listener_id, string_split(uri, ':')[-1] AS track_id, tn AS track_name,
  an AS artist_name,
  aln AS album_name,
  CASE WHEN s > 100 THEN make_timestamp(CAST(round(s * 1000000) AS BIGINT))
       ELSE strptime(ts_text, '%Y-%m-%dT%H:%M:%SZ') END AS ts,
  ms_played, {_REASON_START.format(c='reason_start')} AS reason_start,
  {_REASON_END.format(c='reason_end')} AS reason_end, coalesce(reason_end = 'trackdone', false) AS full_play,
  conn_country, platform, shuffle, offline, incognito_mode
FROM secs"""


# Expected dimension tables, stated from the derivation rules.
TRACKS = """SELECT track_id, track_name, track_duration_ms,
    (track_duration_ms / 6000) % 2 = 0 AS track_explicit,
    CAST(track_duration_ms // 6000 AS SMALLINT) AS track_popularity,
    CAST(1 AS SMALLINT) AS track_number, CAST(1 AS SMALLINT) AS disc_number, album_id,
    CAST(artist_id AS VARCHAR) AS artist_id,
    CASE WHEN artist_id % 3 = 0 THEN CAST(artist_id AS VARCHAR) || ';' || CAST(artist_id + 1 AS VARCHAR)
         ELSE CAST(artist_id AS VARCHAR) END AS artist_ids
  FROM (SELECT track_id, max(track_name) AS track_name, max(track_duration_ms) AS track_duration_ms,
               max(album_id) AS album_id, max(artist_id) AS artist_id FROM raw GROUP BY track_id)"""

ARTISTS = """SELECT DISTINCT CAST(artist_id AS VARCHAR) AS artist_id, artist_name,
    CAST(artist_popularity * 1000 AS INTEGER) AS artist_followers,
    CASE WHEN artist_genres = '' THEN ''
         WHEN wikidata_entity_id IS NULL THEN split_part(artist_genres, ';', 1)
         ELSE array_to_string(list_sort([split_part(artist_genres, ';', 1), split_part(artist_genres, ';', 2)]), ';')
    END AS artist_genres,
    artist_popularity, wikidata_entity_id,
    CASE WHEN wikidata_entity_id IS NULL THEN NULL ELSE is_band END AS is_band,
    CASE WHEN wikidata_entity_id IS NULL THEN NULL ELSE gender END AS gender,
    country,
    CASE WHEN wikidata_entity_id IS NULL OR artist_id % 7 = 0 THEN NULL
         ELSE make_timestamp(CAST(1900 + artist_id % 80 AS BIGINT), 3, 15, 0, 0, 0) END AS birth_date,
    website
  FROM raw"""

ALBUMS = """SELECT album_id, max(album_name) AS album_name, 'album' AS album_type,
    CAST(count(DISTINCT track_id) AS SMALLINT) AS album_total_tracks,
    'label ' || max(artist_name) AS album_label, CAST(max(artist_popularity) AS SMALLINT) AS album_popularity,
    CAST(max(artist_id) AS VARCHAR) AS album_artist_ids,
    string_agg(DISTINCT track_id, ';' ORDER BY track_id) AS album_track_ids,
    CAST(CASE WHEN max(artist_id) % 17 = 0 THEN 0 WHEN max(artist_id) % 19 = 0 THEN NULL
              ELSE max(album_release_year) END AS SMALLINT) AS album_release_year
  FROM raw GROUP BY album_id"""

WIDE_FROM_DOCS_COLUMNS = [
    "listener_id", "track_id", "artist_id", "ts", "ms_played", "full_play", "hours_played", "track_name",
    "track_duration_ms", "track_explicit", "artist_ids", "album_id", "album_total_tracks", "album_release_year",
    "album_track_ids", "artist_name", "artist_followers", "artist_genres", "wikidata_entity_id", "is_band",
    "gender", "country", "birth_date", "website",
]


def enrich_sql() -> dict[str, str]:
    head = f"WITH raw AS ({RAW_WIDE})"
    q: dict[str, str] = {}
    q["e04_flatten_tracks"] = f"{head}\n{TRACKS}"
    q["e05_referenced_ids"] = f"""{head}
SELECT 'album' AS kind, album_id AS id FROM raw
UNION SELECT 'artist', CAST(artist_id AS VARCHAR) FROM raw
UNION SELECT 'artist', CAST(artist_id + 1 AS VARCHAR) FROM raw WHERE artist_id % 3 = 0"""
    q["e11_flatten_artists"] = f"{head}\n{ARTISTS}"
    q["e12_flatten_albums"] = f"{head}\n{ALBUMS}"
    q["e01_pending_track_ids"] = f"""{head}
SELECT DISTINCT track_id AS id FROM raw WHERE artist_id % 2 = 1"""
    q["e03_image_worklist"] = f"""{head}
SELECT DISTINCT CAST(artist_id AS VARCHAR) AS id,
  'https://img.example/a' || CAST(artist_id AS VARCHAR) || '.jpg' AS url
FROM raw WHERE artist_id % 4 IN (2, 3) AND artist_id % 3 <> 0"""
    cols = ", ".join(
        {"track_id": "w.track_id", "artist_id": "t.artist_id", "album_id": "t.album_id"}.get(c, c)
        for c in WIDE_FROM_DOCS_COLUMNS)
    q["e14_wide_fact_from_documents"] = f"""{head}, wide AS ({WIDE}),
w AS (SELECT listener_id, track_id, ts, ms_played, full_play, hours_played FROM wide),
t AS ({TRACKS}), al AS ({ALBUMS}), ar AS ({ARTISTS})
SELECT {cols}
FROM w LEFT JOIN t ON w.track_id = t.track_id LEFT JOIN al ON t.album_id = al.album_id
LEFT JOIN ar ON t.artist_id = ar.artist_id"""
    return q


def parquet_sql() -> str:
    """S6 round trip: the plays columns written partitioned by year and read back."""
    return f"""WITH raw AS ({RAW_WIDE}), wide AS ({WIDE})
SELECT listener_id, track_id, ts, ms_played, full_play, CAST(year(ts) AS INTEGER) AS year,
       CAST(month(ts) AS INTEGER) AS month FROM wide"""


def csv_sql() -> str:
    """S7 round trip: the cleaned play columns written as CSV and read back."""
    return f"""WITH raw AS ({RAW_WIDE}), wide AS ({WIDE})
SELECT track_id, track_name, artist_name, album_name, ts, ms_played, reason_start, reason_end, full_play,
       conn_country, platform, shuffle, offline, incognito_mode FROM wide"""


def batches_sql() -> str:
    """Every distinct track id exactly once, in a batch within the size limit."""
    return f"""WITH raw AS ({RAW_WIDE})
SELECT DISTINCT track_id AS id, true AS within_limit FROM raw"""


def archive_kinds_sql() -> str:
    """Every listener has a history export, some a technical log or an account export too."""
    return f"""WITH raw AS ({RAW_WIDE}), who AS (SELECT DISTINCT listener_id FROM raw)
SELECT listener_id, 'streaming_history' AS kind FROM who
UNION ALL SELECT listener_id, 'technical_log' FROM who WHERE listener_id % 5 = 3
UNION ALL SELECT listener_id, 'account_data' FROM who WHERE listener_id % 5 = 4"""


def composite_sql() -> str:
    """The pairs of names behind the composite keys."""
    return f"""WITH raw AS ({RAW_WIDE}), wide AS ({WIDE})
SELECT DISTINCT track_name, artist_name FROM wide WHERE track_name IS NOT NULL AND artist_name IS NOT NULL"""


def country_names_sql() -> str:
    """Plays per country name; the nations of two regions have no name in the lookup."""
    return f"""WITH raw AS ({RAW_WIDE})
SELECT CASE WHEN n_regionkey > 1 THEN 'Nation ' || split_part(n_name, '_', 2) ELSE 'unknown' END AS conn_country, count(*) AS plays
FROM raw JOIN nation ON conn_country = n_name GROUP BY ALL"""
