"""Oracle SQL for the Q-recipes (parameters equal those registered in ``__spark_entry__``)."""

from __future__ import annotations

from encore.checks.sqltext import FP, SKIP, SUM_MS, first, hours2, pct, rr, with_wide

# Fixture parameters (FIXTURES §3.1): literals shared by the Spark side and the oracle.
ARTIST = "Supplier#000000007"
AS_OF = "2001-11-05"
DISCOVERY_YEAR = 1996
GENRE_SINCE = "1998-01-01"
ONE_HIT_MIN_TOP = 9
ONE_HIT_MAX_OTHER = 190


def recipe_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["q01_top_artists_by_hours"] = with_wide(f"""
SELECT artist_name, {hours2('sum_ms')} AS hours_played, full_play_count, skip_count FROM (
  SELECT artist_name, {SUM_MS} AS sum_ms, {FP} AS full_play_count, {SKIP} AS skip_count
  FROM wide WHERE artist_name IS NOT NULL GROUP BY artist_name)
ORDER BY hours_played DESC, artist_name ASC LIMIT 10""")

    q["q02_top_tracks_of_artist"] = with_wide(f"""
SELECT track_name, album_name, hours_played, full_play_count, skip_count FROM (
  SELECT track_id, {first('track_name')} AS track_name, {first('album_name')} AS album_name,
         {hours2(SUM_MS)} AS hours_played, {FP} AS full_play_count, {SKIP} AS skip_count
  FROM wide WHERE artist_name = '{ARTIST}' GROUP BY track_id
  ORDER BY hours_played DESC, track_id ASC LIMIT 10)""")

    q["q03_first_plays"] = with_wide("""
SELECT ts, track_name, artist_name, reason_start, ms_played, track_duration_ms, reason_end, platform,
       conn_country, website FROM wide
ORDER BY ts, track_id, track_name NULLS FIRST, artist_name NULLS FIRST, reason_start NULLS FIRST,
         ms_played NULLS FIRST, track_duration_ms NULLS FIRST, reason_end NULLS FIRST, platform NULLS FIRST,
         conn_country NULLS FIRST, website NULLS FIRST
LIMIT 5""")

    q["q04_hours_by_gender"] = with_wide(f"""
SELECT gender, {hours2(SUM_MS)} AS hours_played, {FP} AS full_play FROM wide GROUP BY gender""")

    q["q05_top_track_per_female_artist"] = with_wide(f"""
, t AS (
  SELECT track_id, {first('track_name')} AS track_name, {first('artist_name')} AS artist_name,
         {first('album_name')} AS album_name, {first('album_release_year')} AS album_release_year,
         {first('country')} AS country, {first('gender')} AS gender,
         {hours2(SUM_MS)} AS hours_played, {FP} AS full_play
  FROM wide WHERE gender = 'female' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1095 DAY
  GROUP BY track_id)
SELECT artist_name, track_name, album_name, album_release_year, country, gender, hours_played, full_play, track_id
FROM t WHERE artist_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY artist_name ORDER BY hours_played DESC, track_id) = 1
ORDER BY hours_played DESC, artist_name LIMIT 20""")

    q["q06_artists_without_kg_by_hours"] = with_wide(f"""
SELECT artist_id, artist_name, sum_ms / 3600000 AS hours_played, artist_popularity, wikidata_entity_id FROM (
  SELECT artist_id, {first('artist_name')} AS artist_name, {SUM_MS} AS sum_ms,
         {first('artist_popularity')} AS artist_popularity, {first('wikidata_entity_id')} AS wikidata_entity_id
  FROM wide WHERE wikidata_entity_id IS NULL AND artist_id IS NOT NULL GROUP BY artist_id)
ORDER BY sum_ms DESC, artist_id LIMIT 10""")

    q["q07_artists_without_kg_by_popularity"] = with_wide(f"""
SELECT artist_id, {first('artist_name')} AS artist_name, {first('artist_popularity')} AS artist_popularity,
       {first('wikidata_entity_id')} AS wikidata_entity_id
FROM wide WHERE wikidata_entity_id IS NULL AND artist_id IS NOT NULL GROUP BY artist_id
ORDER BY artist_popularity DESC NULLS LAST, artist_id LIMIT 10""")

    q["q08_top_countries"] = with_wide(f"""
SELECT country, {hours2(SUM_MS)} AS hours_played, {FP} AS full_play
FROM wide WHERE country IS NOT NULL GROUP BY country ORDER BY full_play DESC, country LIMIT 10""")

    q["q09_top_solo_tracks_by_release_era"] = with_wide(f"""
SELECT track_name, artist_name, album_name, album_release_year, country, hours_played, full_play FROM (
  SELECT track_id, {first('track_name')} AS track_name, {first('artist_name')} AS artist_name,
         {first('album_name')} AS album_name, {first('album_release_year')} AS album_release_year,
         {first('country')} AS country, {hours2(SUM_MS)} AS hours_played, {FP} AS full_play
  FROM wide WHERE is_band = false AND album_release_year BETWEEN 1950 AND 1970 GROUP BY track_id
  ORDER BY hours_played DESC, track_id LIMIT 10)""")

    q["q10_top_genres"] = with_wide(f"""
SELECT genres, {rr('sum_ms', '3600000', 0)} AS hours_played FROM (
  SELECT genres, CAST(sum(sum_ms) AS BIGINT) AS sum_ms FROM (
    SELECT unnest(string_split(artist_genres, ';')) AS genres, {SUM_MS} AS sum_ms
    FROM wide WHERE artist_genres IS NOT NULL GROUP BY artist_genres)
  GROUP BY genres)
ORDER BY hours_played DESC, genres LIMIT 20""")

    q["q11_top_tracks_in_genre"] = with_wide(f"""
SELECT track_name, artist_name, hours_played, full_play FROM (
  SELECT track_id, {first('track_name')} AS track_name, {first('artist_name')} AS artist_name,
         {hours2(SUM_MS)} AS hours_played, {FP} AS full_play
  FROM wide WHERE coalesce(contains(lower(artist_genres), 'classical'), false) GROUP BY track_id
  ORDER BY full_play DESC, track_id LIMIT 10)""")

    share = """
SELECT year, rock_full_play, hiphop_full_play, pop_full_play, total_full_play,
  {rp} AS rock_percent, {hp} AS hiphop_percent, {pp} AS pop_percent FROM (
  SELECT CAST(year(ts) AS INTEGER) AS year,
    CAST(count_if(coalesce(regexp_matches(artist_genres, '(?i)rock'), false)) AS BIGINT) AS rock_full_play,
    CAST(count_if(coalesce(regexp_matches(artist_genres, '(?i)hip.?hop'), false)) AS BIGINT) AS hiphop_full_play,
    CAST(count_if(coalesce(regexp_matches(artist_genres, '(?i)pop'), false)) AS BIGINT) AS pop_full_play,
    count(*) AS total_full_play
  FROM wide WHERE full_play {since} GROUP BY year(ts))"""
    fmt = dict(rp=pct("rock_full_play", "total_full_play", 2),
               hp=pct("hiphop_full_play", "total_full_play", 2),
               pp=pct("pop_full_play", "total_full_play", 2))
    q["q12_genre_share_by_year"] = with_wide(share.format(since="", **fmt))
    q["q12b_genre_share_since"] = with_wide(
        share.format(since=f"AND ts >= TIMESTAMP '{GENRE_SINCE}'", **fmt))

    q["q13_top_bands_and_solo"] = with_wide(f"""
SELECT artist_name, hours_played, full_play_count, is_band,
       row_number() OVER (PARTITION BY is_band ORDER BY hours_played DESC, artist_name) AS rank FROM (
  SELECT is_band, artist_name, {hours2(SUM_MS)} AS hours_played, {FP} AS full_play_count
  FROM wide WHERE is_band IS NOT NULL AND artist_name IS NOT NULL GROUP BY is_band, artist_name)
QUALIFY row_number() OVER (PARTITION BY is_band ORDER BY hours_played DESC, artist_name) <= 5""")

    q["q14_top_artist_per_top_country"] = with_wide(f"""
, c AS (
  SELECT country, {rr(SUM_MS, '3600000', 0)} AS total_hours FROM wide WHERE country IS NOT NULL
  GROUP BY country ORDER BY total_hours DESC, country LIMIT 10),
a AS (
  SELECT country, artist_name, {rr(SUM_MS, '3600000', 0)} AS hours_played_artist,
         {FP} AS full_play_count_artist
  FROM wide WHERE country IS NOT NULL AND artist_name IS NOT NULL GROUP BY country, artist_name
  QUALIFY row_number() OVER (PARTITION BY country ORDER BY hours_played_artist DESC, artist_name) = 1)
SELECT c.country, total_hours, artist_name, hours_played_artist, full_play_count_artist, rank
FROM a JOIN (SELECT *, row_number() OVER (ORDER BY total_hours DESC, country) AS rank FROM c) c ON a.country = c.country""")

    q["q15_discovered_in_year"] = with_wide(f"""
SELECT track_name, artist_name, album_name, album_release_year, full_play, hours_played, first_play FROM (
  SELECT track_id, min(ts) AS first_play, {first('track_name')} AS track_name, {first('artist_name')} AS artist_name,
         {first('album_name')} AS album_name, {first('album_release_year')} AS album_release_year,
         {FP} AS full_play, {hours2(SUM_MS)} AS hours_played
  FROM wide GROUP BY track_id HAVING year(min(ts)) = {DISCOVERY_YEAR}
  ORDER BY full_play DESC, track_id LIMIT 20)""")

    q["q16_never_finished"] = with_wide(f"""
SELECT track_name, artist_name, album_name, hours_played, partial_play_count FROM (
  SELECT track_id, {first('track_name')} AS track_name, {first('artist_name')} AS artist_name,
         {first('album_name')} AS album_name, {hours2(SUM_MS)} AS hours_played,
         count(ms_played) AS partial_play_count
  FROM wide GROUP BY track_id HAVING NOT bool_or(full_play)
  ORDER BY partial_play_count DESC, hours_played DESC, track_id LIMIT 10)""")

    q["q17_least_played_of_top_albums"] = with_wide(f"""
, t AS (
  SELECT artist_name, album_name, track_name, {SUM_MS} AS sum_ms, {FP} AS full_play FROM wide
  WHERE artist_name IS NOT NULL AND album_name IS NOT NULL AND track_name IS NOT NULL
  GROUP BY artist_name, album_name, track_name),
al AS (
  SELECT artist_name, album_name, {hours2('sum(sum_ms)', 1)} AS total_album_hours,
         {rr('sum(full_play)', 'count(*)', 1)} AS avg_full_play
  FROM t GROUP BY artist_name, album_name
  ORDER BY total_album_hours DESC, artist_name, album_name LIMIT 10),
least AS (
  SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY artist_name, album_name ORDER BY full_play, track_name) = 1)
SELECT al.artist_name, al.album_name, total_album_hours, track_name, {hours2('sum_ms', 1)} AS hours_played,
       full_play, avg_full_play, rank
FROM least JOIN (SELECT *, row_number() OVER (ORDER BY total_album_hours DESC, artist_name, album_name) AS rank FROM al) al ON least.artist_name = al.artist_name AND least.album_name = al.album_name""")

    q["q18_one_hit_wonders"] = with_wide(f"""
, t AS (
  SELECT artist_name, track_name, {FP} AS full_play, {rr(SUM_MS, '36000', 0)} AS centi_hours FROM wide
  WHERE artist_name IS NOT NULL AND track_name IS NOT NULL GROUP BY artist_name, track_name)
SELECT artist_name, min(track_name) AS top_track, max(full_play) AS top_track_plays,
       CAST(sum(centi_hours) AS BIGINT) / 100 AS hours_played,
       CAST(sum(full_play) - max(full_play) AS BIGINT) AS other_tracks_plays
FROM t GROUP BY artist_name
HAVING max(full_play) > {ONE_HIT_MIN_TOP} AND sum(full_play) - max(full_play) < {ONE_HIT_MAX_OTHER}
ORDER BY top_track_plays DESC, artist_name LIMIT 10""")

    q["q19_not_played_since"] = with_wide(f"""
SELECT track_name, artist_name, album_name, last_play, full_play, hours_played FROM (
  SELECT track_id, {first('track_name')} AS track_name, {first('artist_name')} AS artist_name,
         {first('album_name')} AS album_name, max(ts) AS last_play, {FP} AS full_play,
         {hours2(SUM_MS)} AS hours_played
  FROM wide GROUP BY track_id HAVING max(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 1095 DAY
  ORDER BY full_play DESC, track_id LIMIT 10)""")
    return q
