"""Oracle SQL for the website report operators (R1–R18, R21, R22) at k = REPORT_K."""

from __future__ import annotations

from encore.checks.sqltext import FP, SUM_MS, pct, rr, with_plays

REPORT_K = 20
FILTER_START = (1996, 1)
FILTER_END = (1997, 6)
FILTER_ARTIST = "Supplier#000000007"

_KEYS = {
    "artist": (["artist_name"], "artist_name"),
    "track": (["track_name", "artist_name"], "track_name || '~~sep~~' || artist_name"),
    "album": (["album_name", "artist_name"], "album_name || '~~sep~~' || artist_name"),
}


def _nn(keys):
    return " AND ".join(f"{k} IS NOT NULL" for k in keys)


def _top(entity: str, src: str = "plays", k: int = REPORT_K) -> str:
    keys, sort = _KEYS[entity]
    ks = ", ".join(keys)
    return f"""
  SELECT {ks}, {FP} AS play_count, {SUM_MS} AS sum_ms FROM {src} WHERE {_nn(keys)}
  GROUP BY {ks} ORDER BY play_count DESC, {sort} LIMIT {k}"""


def most_played_sql(entity: str, clickrow: bool = False) -> str:
    keys, sort = _KEYS[entity]
    sort = sort.replace(keys[0], f"top.{keys[0]}") if len(keys) == 1 else f"top.{keys[0]} || '~~sep~~' || top.artist_name"
    ks = ", ".join(f"top.{k}" for k in keys)
    src = "(SELECT * FROM plays WHERE reason_start = 'clickrow')" if clickrow else "plays"
    extra_cte, extra_col, extra_join = "", "", ""
    if entity == "artist":
        extra_cte = f""", u AS (SELECT artist_name, count(DISTINCT track_name) AS unique_tracks_played
  FROM {src} WHERE artist_name IS NOT NULL GROUP BY artist_name)"""
        extra_col = ", unique_tracks_played"
        extra_join = "LEFT JOIN u ON top.artist_name = u.artist_name"
    return with_plays(f""", top AS ({_top(entity, src)}){extra_cte}
SELECT {ks}, play_count, sum_ms / 3600000 AS hours_played{extra_col},
       row_number() OVER (ORDER BY play_count DESC, {sort}) AS rank
FROM top {extra_join} WHERE play_count > 0""")


def monthly_series_sql(entity: str) -> str:
    keys, _ = _KEYS[entity]
    ks = ", ".join(keys)
    using = ", ".join(keys)
    return with_plays(f""", top AS (SELECT {ks}, row_number() OVER (ORDER BY play_count DESC, {_KEYS[entity][1]}) AS rank
        FROM ({_top(entity)}) WHERE play_count > 0),
cnt AS (SELECT {ks}, month_index, count(*) AS play_count FROM plays JOIN top USING ({using})
        WHERE full_play GROUP BY {ks}, month_index),
st AS (SELECT quantile_cont(play_count, 0.99) AS p99, max(month_index) AS max_index FROM cnt),
sp AS (SELECT {ks}, rank, CAST(unnest(range(0, max_index + 1)) AS INTEGER) AS month_index, p99 FROM top, st)
SELECT {", ".join(f"sp.{k}" for k in keys)}, sp.month_index, coalesce(cnt.play_count, 0) AS play_count,
  CAST(least(round_even(coalesce(cnt.play_count, 0) * (40.0::DOUBLE / p99), 0), 40) AS INTEGER) AS bar_height,
  CAST(floor(40.0::DOUBLE / (40.0::DOUBLE / p99)) AS BIGINT) AS p99_plays, sp.rank
FROM sp LEFT JOIN cnt USING ({using}, month_index)""")


# The registered sample: rows per listener, columns that make up a row, seed.
SAMPLE_ROWS, SAMPLE_SEED = 3, 7
SAMPLE_COLUMNS = ["listener_id", "track_id", "ts", "ms_played", "full_play"]


def report_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["r01_most_played_artists"] = most_played_sql("artist")
    q["r02_most_played_tracks"] = most_played_sql("track")
    q["r03_most_played_albums"] = most_played_sql("album")
    q["r04_most_played_tracks_clickrow"] = most_played_sql("track", clickrow=True)
    q["r05_monthly_play_series_artists"] = monthly_series_sql("artist")
    q["r05_monthly_play_series_tracks"] = monthly_series_sql("track")
    q["r05_monthly_play_series_albums"] = monthly_series_sql("album")

    q["r06_top_songs_of_top_artists"] = with_plays(f""", a AS (
  SELECT artist_name, {FP} AS play_count FROM plays WHERE artist_name IS NOT NULL GROUP BY artist_name
  ORDER BY play_count DESC, artist_name LIMIT {REPORT_K}),
t AS (
  SELECT track_name, artist_name, {FP} AS play_count,
    row_number() OVER (PARTITION BY artist_name ORDER BY {FP} DESC, track_name || '~~sep~~' || artist_name) AS rk
  FROM plays WHERE track_name IS NOT NULL AND artist_name IN (SELECT artist_name FROM a)
  GROUP BY track_name, artist_name)
SELECT a.artist_name || ' (' || CAST(a.play_count AS VARCHAR) || ' plays)' AS artist,
  max(CASE WHEN rk = 1 THEN track_name || ' (' || CAST(t.play_count AS VARCHAR) || ' plays)' END) AS top_1_song,
  max(CASE WHEN rk = 2 THEN track_name || ' (' || CAST(t.play_count AS VARCHAR) || ' plays)' END) AS top_2_song,
  max(CASE WHEN rk = 3 THEN track_name || ' (' || CAST(t.play_count AS VARCHAR) || ' plays)' END) AS top_3_song,
  row_number() OVER (ORDER BY a.play_count DESC, a.artist_name) AS rank
FROM a LEFT JOIN t ON a.artist_name = t.artist_name GROUP BY a.artist_name, a.play_count""")

    def best(entity: str) -> str:
        keys, sort = _KEYS[entity]
        ks = ", ".join(keys)
        if entity == "artist":
            label = "artist_name || ' (' || CAST(n AS VARCHAR) || ' times)'"
        else:
            label = f"{keys[0]} || ' (by ' || artist_name || ', ' || CAST(n AS VARCHAR) || ' times)'"
        return f"""SELECT year_month, {label} AS most_played_{entity} FROM (
    SELECT year_month, {ks}, count(*) AS n FROM plays WHERE {_nn(keys)} GROUP BY year_month, {ks}
    QUALIFY row_number() OVER (PARTITION BY year_month ORDER BY count(*) DESC, {sort}) = 1)"""

    q["r07_most_played_monthly"] = with_plays(f""", m AS (SELECT DISTINCT year_month FROM plays),
ba AS ({best('artist')}), bt AS ({best('track')}), bl AS ({best('album')})
SELECT m.year_month, most_played_artist, most_played_track, most_played_album
FROM m LEFT JOIN ba USING (year_month) LEFT JOIN bt USING (year_month) LEFT JOIN bl USING (year_month)""")

    q["r08_avg_track_length_monthly"] = with_plays(f"""
SELECT year_month, {SUM_MS} / (count(*) * 60000) AS minutes_played FROM plays WHERE full_play GROUP BY year_month""")

    q["r09_avg_play_count_per_song_yearly"] = with_plays("""
SELECT year, CAST(sum(n) AS BIGINT) / count(*) AS avg_play_count FROM (
  SELECT year, track_name, artist_name, count(*) AS n FROM plays
  WHERE full_play AND track_name IS NOT NULL AND artist_name IS NOT NULL GROUP BY year, track_name, artist_name)
GROUP BY year""")

    q["r10_play_count_distribution"] = with_plays("""
SELECT play_count, count(*) AS num_songs FROM (
  SELECT track_name, artist_name, count(*) AS play_count FROM plays
  WHERE full_play AND track_name IS NOT NULL AND artist_name IS NOT NULL GROUP BY track_name, artist_name)
GROUP BY play_count""")

    q["r11_yearly_track_play_count"] = with_plays(""", ty AS (
  SELECT year, track_name, artist_name FROM plays
  WHERE full_play AND track_name IS NOT NULL AND artist_name IS NOT NULL GROUP BY year, track_name, artist_name),
tot AS (SELECT year, count(*) AS total FROM plays WHERE full_play GROUP BY year),
un AS (SELECT year, count(*) AS unique_per_year FROM ty GROUP BY year),
nw AS (SELECT year, count(*) AS new FROM (SELECT min(year) AS year FROM ty GROUP BY track_name, artist_name) GROUP BY year)
SELECT tot.year, total, coalesce(unique_per_year, 0) AS unique_per_year, coalesce(new, 0) AS new
FROM tot LEFT JOIN un USING (year) LEFT JOIN nw USING (year)""")

    q["r12_hour_of_day_share"] = with_plays(f"""
SELECT hour, {pct('sum_ms', 'sum(sum_ms) OVER ()', 2)} AS percent_of_play_time FROM (
  SELECT hour, {SUM_MS} AS sum_ms FROM plays GROUP BY hour)""")

    bounds = "b AS (SELECT min(day) AS first_day, max(day) AS last_day FROM plays)"
    q["r13_avg_hours_per_year_month"] = with_plays(f""", {bounds},
ms AS (SELECT CAST(unnest(generate_series(date_trunc('month', first_day), date_trunc('month', last_day),
                                     INTERVAL 1 MONTH)) AS DATE) AS m, first_day, last_day FROM b),
sp AS (SELECT strftime(m, '%Y-%m') AS year_month,
              CAST(date_diff('day', greatest(first_day, m), least(last_day, last_day(m))) + 1 AS BIGINT) AS days FROM ms),
h AS (SELECT year_month, {SUM_MS} AS sum_ms FROM plays GROUP BY year_month)
SELECT sp.year_month, sum_ms / (days * 3600000) AS avg_hours_played_per_day FROM sp LEFT JOIN h USING (year_month)""")

    q["r14_avg_hours_per_year"] = with_plays(f""", {bounds},
h AS (SELECT year, {SUM_MS} AS sum_ms FROM plays GROUP BY year)
SELECT year, sum_ms / (CAST(CASE
    WHEN year = year(last_day) THEN date_diff('day', make_date(year(last_day), 1, 1), last_day) + 1
    WHEN year = year(first_day) THEN date_diff('day', first_day, make_date(year(first_day), 12, 31)) + 1
    ELSE 365 END AS BIGINT) * 3600000) AS avg_hours_played_per_day
FROM h, b""")

    q["r15_avg_hours_per_month_of_year"] = with_plays(f""", {bounds},
ms AS (SELECT CAST(unnest(generate_series(date_trunc('month', first_day), date_trunc('month', last_day),
                                     INTERVAL 1 MONTH)) AS DATE) AS m, first_day, last_day FROM b),
sp AS (SELECT month(m) AS mo, CAST(sum(date_diff('day', greatest(first_day, m), least(last_day, last_day(m))) + 1)
              AS BIGINT) AS days FROM ms GROUP BY month(m)),
h AS (SELECT month AS mo, {SUM_MS} AS sum_ms FROM plays GROUP BY month)
SELECT monthname(make_date(2000, CAST(sp.mo AS INTEGER), 1)) AS month,
       sum_ms / (days * 3600000) AS avg_hours_played_per_day FROM sp LEFT JOIN h USING (mo)""")

    q["r16_avg_hours_per_weekday"] = with_plays(f""", {bounds},
wk AS (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS weekday, date_diff('day', first_day, last_day) + 1 AS n,
              isodow(first_day) - 1 AS s FROM b),
sp AS (SELECT weekday, CAST(n // 7 + CASE WHEN ((weekday - s) % 7 + 7) % 7 < n % 7 THEN 1 ELSE 0 END AS BIGINT) AS days
       FROM wk),
h AS (SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, {SUM_MS} AS sum_ms FROM plays GROUP BY 1)
SELECT dayname(DATE '2024-01-01' + sp.weekday) AS day_name, sum_ms / (days * 3600000) AS avg_hours_played_per_day
FROM sp LEFT JOIN h USING (weekday) WHERE days > 0""")

    q["r17_plays_per_country"] = with_plays("""
SELECT conn_country AS country, count(*) AS play_count FROM plays
WHERE full_play AND conn_country IS NOT NULL GROUP BY conn_country""")

    for entity in ("track", "artist"):
        keys, _ = _KEYS[entity]
        ks = ", ".join(keys)
        # brute force: a running sum over every entity (the Spark side uses the histogram)
        q[f"r18_cumulative_play_share_{entity}"] = with_plays(f""", e AS (
  SELECT {ks}, count(*) AS plays FROM plays WHERE full_play AND {_nn(keys)} GROUP BY {ks}),
r AS (SELECT row_number() OVER (ORDER BY plays DESC) AS rk,
             sum(plays) OVER (ORDER BY plays DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             (SELECT count(*) FROM plays WHERE full_play) AS total FROM e)
SELECT CAST(0 AS BIGINT) AS number_of_{entity}s, CAST(0 AS DOUBLE) AS percent_of_played_songs
UNION ALL
SELECT rk, CAST(cum AS BIGINT) * 100 / CAST(total AS BIGINT) FROM r""")

    (sy, sm), (ey, em) = FILTER_START, FILTER_END
    q["r21_filter_history"] = with_plays(f"""
SELECT listener_id, track_id, ts, ms_played, full_play, year_month FROM plays
WHERE year * 12 + month BETWEEN {sy * 12 + sm} AND {ey * 12 + em} AND artist_name = '{FILTER_ARTIST}'""")

    q["r22_month_spine"] = with_plays("""
SELECT CAST(s // 12 AS INTEGER) AS year, CAST(s % 12 + 1 AS INTEGER) AS month,
       printf('%04d-%02d', s // 12, s % 12 + 1) AS year_month
FROM (SELECT unnest(range(min(year * 12 + month - 1), max(year * 12 + month - 1) + 1)) AS s FROM plays)""")
    # the sample is random: what is fixed is its size, that its rows are plays, and its columns
    part = lambda c: f"coalesce('=' || CAST({c} AS VARCHAR), '-')"
    key = f"md5(concat_ws(chr(31), '{SAMPLE_SEED}', {', '.join(part(c) for c in SAMPLE_COLUMNS)}))"
    shown = ", ".join(SAMPLE_COLUMNS)
    q["r20_sampled_rows_by_listener"] = with_plays(f"""
SELECT {shown}, sample FROM (
  SELECT {shown}, row_number() OVER (PARTITION BY listener_id ORDER BY {key}) AS sample FROM plays) WHERE sample <= {SAMPLE_ROWS}""")
    q["r20_random_sample"] = with_plays("""
SELECT least(count(*), 3) AS members, 'column,sample_1,sample_2,sample_3' AS columns FROM plays""")
    q["r19_single_values"] = kpi_sql()
    q["r23_report_table_sizes"] = report_sizes_sql(q)
    return q


def kpi_sql() -> str:
    """The 41 indicators in one row (brute-force ranks for the shares)."""

    def p0(part: str, whole: str) -> str:
        return pct(part, whole, 0)

    def rank_share(entity: str, n: int) -> str:
        return (f"(SELECT {p0(f'coalesce(max(CASE WHEN rk = least({n}, uniq - 1) THEN cum END), 0)', 'max(total)')}"
                f" FROM r_{entity}, u_{entity})")

    def name(entity: str, i: int) -> str:
        return f"coalesce((SELECT {_KEYS[entity][0][0]} FROM n_{entity} WHERE rk = {i}), '-')"

    ranks = ""
    for entity in ("artist", "track"):
        keys, sort = _KEYS[entity]
        ks = ", ".join(keys)
        ranks += f""",
e_{entity} AS (SELECT {ks}, count(*) AS plays FROM plays WHERE full_play AND {_nn(keys)} GROUP BY {ks}),
r_{entity} AS (SELECT row_number() OVER (ORDER BY plays DESC) AS rk,
    sum(plays) OVER (ORDER BY plays DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    (SELECT count(*) FROM plays WHERE full_play) AS total FROM e_{entity}),
u_{entity} AS (SELECT count(*) AS uniq FROM e_{entity}),
n_{entity} AS (SELECT {keys[0]}, row_number() OVER (ORDER BY play_count DESC, {sort}) AS rk FROM (
    SELECT {ks}, count_if(full_play) AS play_count FROM plays WHERE {_nn(keys)} GROUP BY {ks})
  WHERE play_count > 0)"""
    x = "(CAST(listening_hours AS DOUBLE) / nullif(number_of_days, 0))"
    per_day = (f"CASE WHEN {x} >= 10 THEN CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) "
               f"ELSE CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) || ':' || "
               f"lpad(CAST(CAST(round_even(({x} - floor({x})) * 60, 0) AS BIGINT) AS VARCHAR), 2, '0') END")
    skip = "reason_end = 'forward button'"
    return with_plays(f""", base AS (
  SELECT min(day) AS _first, max(day) AS _last,
    count(DISTINCT CASE WHEN full_play THEN day END) AS number_of_days_with_tracks_played,
    count(*) AS _n, {FP} AS played_songs,
    CAST(count_if(full_play AND track_name IS NOT NULL AND artist_name IS NOT NULL) AS BIGINT) AS _fp_keyed,
    count(DISTINCT CASE WHEN full_play AND track_name IS NOT NULL AND artist_name IS NOT NULL
                        THEN {{'t': track_name, 'a': artist_name}} END) AS unique_tracks_played,
    count(DISTINCT CASE WHEN full_play THEN artist_name END) AS unique_artists_played,
    count(DISTINCT CASE WHEN full_play AND album_name IS NOT NULL AND artist_name IS NOT NULL
                        THEN {{'t': album_name, 'a': artist_name}} END) AS unique_albums_played,
    {SUM_MS} AS _ms,
    count_if(full_play AND shuffle) AS _fp_shuffle, count_if(shuffle) AS _shuffle,
    CAST(count_if({skip}) AS BIGINT) AS skipped_songs,
    CAST(sum(CASE WHEN {skip} THEN ms_played END) AS BIGINT) AS _skip_ms,
    count_if({skip} AND ms_played < 3000) AS _skip_3s,
    count_if({skip} AND ms_played > 30000) AS _skip_30s,
    count_if({skip} AND ms_played > 120000) AS _skip_120s,
    count_if({skip} AND shuffle) AS _skip_shuffle, count_if({skip} AND NOT shuffle) AS _skip_no_shuffle,
    count_if(reason_start = 'forward button') AS _rs_fwd, count_if(reason_start = 'back button') AS _rs_back,
    count_if(reason_start = 'trackdone') AS _rs_done, count_if(reason_start = 'clickrow') AS _rs_click,
    count_if(full_play AND incognito_mode) AS _fp_incognito,
    count_if(full_play AND reason_start = 'clickrow') AS _fp_click
  FROM plays),
k AS (SELECT *, CAST(date_diff('day', _first, _last) AS BIGINT) AS number_of_days,
             {rr('_ms', '3600000', 0)} AS listening_hours FROM base){ranks}
SELECT strftime(_first, '%Y-%m-%d') AS first_day, strftime(_last, '%Y-%m-%d') AS last_day, number_of_days,
  number_of_days_with_tracks_played,
  {p0('number_of_days_with_tracks_played', 'number_of_days')} AS percent_of_days_with_tracks_played,
  played_songs, {rr('played_songs', 'number_of_days', 0)} AS played_songs_per_day,
  unique_tracks_played, unique_artists_played, unique_albums_played,
  {rr('unique_tracks_played', 'unique_artists_played', 1)} AS unique_tracks_played_per_artist,
  listening_hours, {per_day} AS listening_hours_per_day,
  {p0('_fp_shuffle', 'played_songs')} AS percent_of_played_songs_using_shuffle,
  skipped_songs, {p0('skipped_songs', '_n')} AS percent_of_skipped_songs,
  CASE WHEN skipped_songs = 0 THEN 0 ELSE {rr('_skip_ms', 'skipped_songs * 1000', 0)} END AS avg_seconds_played_before_skipping,
  CASE WHEN skipped_songs = 0 THEN 0 ELSE {p0('_skip_3s', 'skipped_songs')} END AS percent_of_songs_skipped_before_3s,
  CASE WHEN skipped_songs = 0 THEN 0 ELSE {p0('_skip_30s', 'skipped_songs')} END AS percent_of_songs_skipped_after_30s,
  CASE WHEN skipped_songs = 0 THEN 0 ELSE {p0('_skip_120s', 'skipped_songs')} END AS percent_of_songs_skipped_after_120s,
  CASE WHEN _shuffle = 0 THEN 0 ELSE {p0('_skip_shuffle', '_shuffle')} END AS percent_of_skipped_songs_using_shuffle,
  CASE WHEN _shuffle = 0 THEN 0 ELSE {p0('_skip_no_shuffle', '_shuffle')} END AS percent_of_skipped_songs_not_using_shuffle,
  {p0('_rs_fwd', '_n')} AS percent_reason_start_forward_button,
  {p0('_rs_back', '_n')} AS percent_reason_start_back_button,
  {p0('_rs_done', '_n')} AS percent_reason_start_trackdone,
  {p0('_rs_click', '_n')} AS percent_reason_start_clickrow,
  {p0('_fp_incognito', 'played_songs')} AS percent_of_played_songs_using_incognito_mode,
  {rr('_fp_keyed', 'unique_tracks_played', 1)} AS average_play_count_per_song,
  {p0('_fp_click', 'played_songs')} AS percent_played_songs_reason_start_clickrow,
  {rank_share('artist', 10)} AS top_10_artist_play_count_percent,
  {rank_share('artist', 100)} AS top_100_artist_play_count_percent,
  {rank_share('artist', 500)} AS top_500_artist_play_count_percent,
  {rank_share('track', 10)} AS top_10_track_play_count_percent,
  {rank_share('track', 100)} AS top_100_track_play_count_percent,
  {rank_share('track', 500)} AS top_500_track_play_count_percent,
  {name('artist', 1)} AS top_1_artist, {name('track', 1)} AS top_1_track,
  {name('artist', 2)} AS top_2_artist, {name('track', 2)} AS top_2_track,
  {name('artist', 3)} AS top_3_artist, {name('track', 3)} AS top_3_track
FROM k""")


# report table name → registered query key whose SQL computes the same table
REPORT_TABLE_KEYS = {
    "most_played_artists_total": "r01_most_played_artists",
    "most_played_tracks_total": "r02_most_played_tracks",
    "most_played_albums_total": "r03_most_played_albums",
    "most_played_tracks_total_reason_start_clickrow": "r04_most_played_tracks_clickrow",
    "monthly_play_series_artists": "r05_monthly_play_series_artists",
    "monthly_play_series_tracks": "r05_monthly_play_series_tracks",
    "monthly_play_series_albums": "r05_monthly_play_series_albums",
    "top_songs_of_top_artists": "r06_top_songs_of_top_artists",
    "most_played_artists_track_album_monthly": "r07_most_played_monthly",
    "avg_track_length_monthly": "r08_avg_track_length_monthly",
    "avg_play_count_per_song_yearly": "r09_avg_play_count_per_song_yearly",
    "play_count_distribution": "r10_play_count_distribution",
    "yearly_track_play_count": "r11_yearly_track_play_count",
    "hours_played_percent_per_hour_of_the_day": "r12_hour_of_day_share",
    "avg_hours_played_per_year_month": "r13_avg_hours_per_year_month",
    "avg_hours_played_per_year": "r14_avg_hours_per_year",
    "avg_hours_played_per_month": "r15_avg_hours_per_month_of_year",
    "avg_hours_played_per_day_name": "r16_avg_hours_per_weekday",
    "plays_per_county_total": "r17_plays_per_country",
    "cumulative_percent_play_count_track": "r18_cumulative_play_share_track",
    "cumulative_percent_play_count_artist": "r18_cumulative_play_share_artist",
}


def report_sizes_sql(tables_sql: dict[str, str]) -> str:
    """Row count of every report table, from the per-table oracle SQL."""
    parts = [f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM ({tables_sql[key]})"
             for name, key in REPORT_TABLE_KEYS.items()]
    return "\nUNION ALL\n".join(parts)


# display name of each shown column, the columns that hold text, and the order of each table, stated for the check
_SHOWN = {
    "r01": ["artist_name:artist", "play_count:play count", "hours_played:hours played", "unique_tracks_played:# of unique tracks played"],
    "r02": ["track_name:track", "artist_name:artist", "play_count:play count", "hours_played:hours played"],
    "r03": ["album_name:album", "artist_name:artist", "play_count:play count", "hours_played:hours played"],
    "r04": ["track_name:track", "artist_name:artist", "play_count:play count", "hours_played:hours played"],
    "r06": ["artist:artist", "top_1_song:top-1 song", "top_2_song:top-2 song", "top_3_song:top-3 song"],
    "r07": ["year_month:month", "most_played_artist:most played artist", "most_played_track:most played track", "most_played_album:most played album"],
    "r08": ["year_month:month", "minutes_played:minutes played"],
    "r09": ["year:year", "avg_play_count:play count"],
    "r10": ["play_count:play count", "num_songs:num of songs"],
    "r11": ["year:year", "total:total", "unique_per_year:unique per year", "new:new"],
    "r12": ["hour:hour of the day", "percent_of_play_time:percent of play time"],
    "r13": ["year_month:month", "avg_hours_played_per_day:avg hours played per day"],
    "r14": ["year:year", "avg_hours_played_per_day:avg hours played per day"],
    "r15": ["month:month", "avg_hours_played_per_day:avg hours played per day"],
    "r16": ["day_name:day name", "avg_hours_played_per_day:avg hours played per day"],
    "r17": ["country:country", "play_count:play count"],
    "r18_cumulative_play_share_track": ["number_of_tracks:number of tracks", "percent_of_played_songs:percent of played songs"],
    "r18_cumulative_play_share_artist": ["number_of_artists:number of artists", "percent_of_played_songs:percent of played songs"],
    "r05": ["month_index:month_index", "play_count:play count", "bar_height:bar_height", "p99_plays:p99_plays"],
}
_ORDER = {
    "r01": "rank", "r02": "rank", "r03": "rank", "r04": "rank", "r05": "rank, month_index", "r06": "rank", "r07": "year_month DESC",
    "r08": "year_month", "r09": "year", "r10": "play_count DESC", "r11": "year", "r12": "hour", "r13": "year_month", "r14": "year",
    "r15": "strptime(month || ' 2000', '%B %Y')", "r16": "list_position(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], day_name)",
    "r17": "play_count DESC, country", "r18_cumulative_play_share_track": "number_of_tracks", "r18_cumulative_play_share_artist": "number_of_artists",
}
TEXT_COLUMNS = ["artist", "track", "album", "top-1 song", "top-2 song", "top-3 song", "month", "most played artist", "most played track",
                "most played album", "day name", "country"]


def report_documents_sql(tables_sql: dict[str, str]) -> str:
    """Every cell of every report document, numbers rounded half-even to 2 digits, by place and display name."""
    parts = []
    for name, key in REPORT_TABLE_KEYS.items():
        short = key if key in _SHOWN else key[:3]
        shown = list(_SHOWN[short])
        if short == "r05":
            entity = key.rsplit("_", 1)[-1][:-1]
            shown = [f"{k}:{k[:-5]}" for k in _KEYS[entity][0]] + shown
        for column in shown:
            own, display = column.split(":", 1)
            number = "NULL::DOUBLE" if display in TEXT_COLUMNS else f"round_even({own}::DOUBLE * 100, 0) / 100"
            text = f"{own}::VARCHAR" if display in TEXT_COLUMNS else "NULL::VARCHAR"
            parts.append(f"""SELECT '{name}' AS table_name, row_number() OVER (ORDER BY {_ORDER[short]}) - 1 AS position,
  '{display}' AS column_name, {number} AS number, {text} AS text FROM t_{key}""")
    views = ",\n".join(f"t_{key} AS MATERIALIZED ({tables_sql[key]})" for key in dict.fromkeys(REPORT_TABLE_KEYS.values()))
    return f"WITH {views}\n" + "\nUNION ALL\n".join(parts)


def by_listener_sql() -> dict[str, str]:
    """Per-listener forms (``by=["listener_id"]``) of a representative set, brute force."""
    from encore.checks.sqltext import SKIP, hours2, with_wide

    q: dict[str, str] = {}
    q["r01_most_played_artists_by_listener"] = with_plays(f""", c AS (
  SELECT listener_id, artist_name, {FP} AS play_count, {SUM_MS} AS sum_ms FROM plays
  WHERE artist_name IS NOT NULL GROUP BY listener_id, artist_name
  QUALIFY row_number() OVER (PARTITION BY listener_id ORDER BY play_count DESC, artist_name) <= {REPORT_K}),
u AS (SELECT listener_id, artist_name, count(DISTINCT track_name) AS unique_tracks_played FROM plays
      WHERE artist_name IS NOT NULL GROUP BY listener_id, artist_name)
SELECT c.listener_id, c.artist_name, play_count, sum_ms / 3600000 AS hours_played, unique_tracks_played,
       row_number() OVER (PARTITION BY c.listener_id ORDER BY play_count DESC, c.artist_name) AS rank
FROM c LEFT JOIN u ON c.listener_id = u.listener_id AND c.artist_name = u.artist_name WHERE play_count > 0""")
    q["r12_hour_of_day_share_by_listener"] = with_plays(f"""
SELECT listener_id, hour, {pct('sum_ms', 'sum(sum_ms) OVER (PARTITION BY listener_id)', 2)} AS percent_of_play_time
FROM (SELECT listener_id, hour, {SUM_MS} AS sum_ms FROM plays GROUP BY listener_id, hour)""")
    q["r18_cumulative_play_share_artist_by_listener"] = with_plays(f""", e AS (
  SELECT listener_id, artist_name, count(*) AS plays FROM plays WHERE full_play AND artist_name IS NOT NULL
  GROUP BY listener_id, artist_name),
r AS (SELECT listener_id, row_number() OVER (PARTITION BY listener_id ORDER BY plays DESC) AS rk,
        sum(plays) OVER (PARTITION BY listener_id ORDER BY plays DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
        (SELECT count(*) FROM plays p WHERE p.full_play AND p.listener_id = e.listener_id) AS total FROM e)
SELECT DISTINCT listener_id, CAST(0 AS BIGINT) AS number_of_artists, CAST(0 AS DOUBLE) AS percent_of_played_songs FROM plays
UNION ALL
SELECT listener_id, rk, CAST(cum AS BIGINT) * 100 / CAST(total AS BIGINT) FROM r""")
    q["r13_avg_hours_per_year_month_by_listener"] = with_plays(f""", b AS (
  SELECT listener_id, min(day) AS first_day, max(day) AS last_day FROM plays GROUP BY listener_id),
ms AS (SELECT listener_id, CAST(unnest(generate_series(date_trunc('month', first_day), date_trunc('month', last_day),
                                     INTERVAL 1 MONTH)) AS DATE) AS m, first_day, last_day FROM b),
sp AS (SELECT listener_id, strftime(m, '%Y-%m') AS year_month,
              CAST(date_diff('day', greatest(first_day, m), least(last_day, last_day(m))) + 1 AS BIGINT) AS days FROM ms),
h AS (SELECT listener_id, year_month, {SUM_MS} AS sum_ms FROM plays GROUP BY listener_id, year_month)
SELECT sp.listener_id, sp.year_month, sum_ms / (days * 3600000) AS avg_hours_played_per_day
FROM sp LEFT JOIN h ON sp.listener_id = h.listener_id AND sp.year_month = h.year_month""")
    q["q01_top_artists_by_hours_by_listener"] = with_wide(f"""
SELECT listener_id, artist_name, {hours2('sum_ms')} AS hours_played, full_play_count, skip_count FROM (
  SELECT listener_id, artist_name, {SUM_MS} AS sum_ms, {FP} AS full_play_count, {SKIP} AS skip_count
  FROM wide WHERE artist_name IS NOT NULL GROUP BY listener_id, artist_name)
QUALIFY row_number() OVER (PARTITION BY listener_id ORDER BY hours_played DESC, artist_name) <= 10""")
    return q


def kpi_by_listener_sql() -> str:
    """R19 per listener: the same indicators grouped by listener_id (brute-force ranks)."""
    G = "listener_id"

    def p0(part: str, whole: str) -> str:
        return pct(part, whole, 0)

    ranks = ""
    for entity in ("artist", "track"):
        keys, sort = _KEYS[entity]
        ks = ", ".join(keys)
        shares = ", ".join(
            f"{p0(f'coalesce(max(CASE WHEN rk = least({n}, uniq - 1) THEN cum END), 0)', 'max(total)')} "
            f"AS top_{n}_{entity}_play_count_percent" for n in (10, 100, 500))
        names = ", ".join(f"max(CASE WHEN rk = {i} THEN {keys[0]} END) AS top_{i}_{entity}" for i in (1, 2, 3))
        ranks += f""",
e_{entity} AS (SELECT {G}, {ks}, count(*) AS plays FROM plays WHERE full_play AND {_nn(keys)} GROUP BY {G}, {ks}),
r_{entity} AS (SELECT {G}, row_number() OVER (PARTITION BY {G} ORDER BY plays DESC) AS rk,
    sum(plays) OVER (PARTITION BY {G} ORDER BY plays DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    (SELECT count(*) FROM plays p WHERE p.full_play AND p.{G} = e_{entity}.{G}) AS total FROM e_{entity}),
u_{entity} AS (SELECT {G}, count(*) AS uniq FROM e_{entity} GROUP BY {G}),
s_{entity} AS (SELECT {G}, {shares} FROM r_{entity} JOIN u_{entity} USING ({G}) GROUP BY {G}),
n_{entity} AS (SELECT {G}, {names} FROM (
    SELECT {G}, {keys[0]}, row_number() OVER (PARTITION BY {G} ORDER BY play_count DESC, {sort}) AS rk FROM (
      SELECT {G}, {ks}, count_if(full_play) AS play_count FROM plays WHERE {_nn(keys)} GROUP BY {G}, {ks})
    WHERE play_count > 0) GROUP BY {G})"""
    x = "(CAST(listening_hours AS DOUBLE) / nullif(number_of_days, 0))"
    per_day = (f"CASE WHEN {x} >= 10 THEN CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) "
               f"ELSE CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) || ':' || "
               f"lpad(CAST(CAST(round_even(({x} - floor({x})) * 60, 0) AS BIGINT) AS VARCHAR), 2, '0') END")
    skip = "reason_end = 'forward button'"
    share_cols = ", ".join(f"coalesce(top_{n}_{e}_play_count_percent, 0) AS top_{n}_{e}_play_count_percent"
                           for e in ("artist", "track") for n in (10, 100, 500))
    name_cols = ", ".join(f"coalesce(top_{i}_{e}, '-') AS top_{i}_{e}" for i in (1, 2, 3) for e in ("artist", "track"))
    return with_plays(f""", base AS (
  SELECT {G}, min(day) AS _first, max(day) AS _last,
    count(DISTINCT CASE WHEN full_play THEN day END) AS number_of_days_with_tracks_played,
    count(*) AS _n, {FP} AS played_songs,
    CAST(count_if(full_play AND track_name IS NOT NULL AND artist_name IS NOT NULL) AS BIGINT) AS _fp_keyed,
    count(DISTINCT CASE WHEN full_play AND track_name IS NOT NULL AND artist_name IS NOT NULL
                        THEN {{'t': track_name, 'a': artist_name}} END) AS unique_tracks_played,
    count(DISTINCT CASE WHEN full_play THEN artist_name END) AS unique_artists_played,
    count(DISTINCT CASE WHEN full_play AND album_name IS NOT NULL AND artist_name IS NOT NULL
                        THEN {{'t': album_name, 'a': artist_name}} END) AS unique_albums_played,
    {SUM_MS} AS _ms,
    count_if(full_play AND shuffle) AS _fp_shuffle, count_if(shuffle) AS _shuffle,
    CAST(count_if({skip}) AS BIGINT) AS skipped_songs,
    CAST(sum(CASE WHEN {skip} THEN ms_played END) AS BIGINT) AS _skip_ms,
    count_if({skip} AND ms_played < 3000) AS _skip_3s,
    count_if({skip} AND ms_played > 30000) AS _skip_30s,
    count_if({skip} AND ms_played > 120000) AS _skip_120s,
    count_if({skip} AND shuffle) AS _skip_shuffle, count_if({skip} AND NOT shuffle) AS _skip_no_shuffle,
    count_if(reason_start = 'forward button') AS _rs_fwd, count_if(reason_start = 'back button') AS _rs_back,
    count_if(reason_start = 'trackdone') AS _rs_done, count_if(reason_start = 'clickrow') AS _rs_click,
    count_if(full_play AND incognito_mode) AS _fp_incognito,
    count_if(full_play AND reason_start = 'clickrow') AS _fp_click
  FROM plays GROUP BY {G}),
k AS (SELECT *, CAST(date_diff('day', _first, _last) AS BIGINT) AS number_of_days,
             {rr('_ms', '3600000', 0)} AS listening_hours FROM base){ranks}
SELECT k.{G}, strftime(_first, '%Y-%m-%d') AS first_day, strftime(_last, '%Y-%m-%d') AS last_day, number_of_days,
  number_of_days_with_tracks_played,
  {p0('number_of_days_with_tracks_played', 'number_of_days')} AS percent_of_days_with_tracks_played,
  played_songs, {rr('played_songs', 'number_of_days', 0)} AS played_songs_per_day,
  unique_tracks_played, unique_artists_played, unique_albums_played,
  {rr('unique_tracks_played', 'unique_artists_played', 1)} AS unique_tracks_played_per_artist,
  listening_hours, {per_day} AS listening_hours_per_day,
  {p0('_fp_shuffle', 'played_songs')} AS percent_of_played_songs_using_shuffle,
  skipped_songs, {p0('skipped_songs', '_n')} AS percent_of_skipped_songs,
  CASE WHEN skipped_songs = 0 THEN 0 ELSE {rr('_skip_ms', 'skipped_songs * 1000', 0)} END AS avg_seconds_played_before_skipping,
  CASE WHEN skipped_songs = 0 THEN 0 ELSE {p0('_skip_3s', 'skipped_songs')} END AS percent_of_songs_skipped_before_3s,
  CASE WHEN skipped_songs = 0 THEN 0 ELSE {p0('_skip_30s', 'skipped_songs')} END AS percent_of_songs_skipped_after_30s,
  CASE WHEN skipped_songs = 0 THEN 0 ELSE {p0('_skip_120s', 'skipped_songs')} END AS percent_of_songs_skipped_after_120s,
  CASE WHEN _shuffle = 0 THEN 0 ELSE {p0('_skip_shuffle', '_shuffle')} END AS percent_of_skipped_songs_using_shuffle,
  CASE WHEN _shuffle = 0 THEN 0 ELSE {p0('_skip_no_shuffle', '_shuffle')} END AS percent_of_skipped_songs_not_using_shuffle,
  {p0('_rs_fwd', '_n')} AS percent_reason_start_forward_button,
  {p0('_rs_back', '_n')} AS percent_reason_start_back_button,
  {p0('_rs_done', '_n')} AS percent_reason_start_trackdone,
  {p0('_rs_click', '_n')} AS percent_reason_start_clickrow,
  {p0('_fp_incognito', 'played_songs')} AS percent_of_played_songs_using_incognito_mode,
  {rr('_fp_keyed', 'unique_tracks_played', 1)} AS average_play_count_per_song,
  {p0('_fp_click', 'played_songs')} AS percent_played_songs_reason_start_clickrow,
  {share_cols}, {name_cols}
FROM k LEFT JOIN s_artist USING ({G}) LEFT JOIN s_track USING ({G})
LEFT JOIN n_artist USING ({G}) LEFT JOIN n_track USING ({G})""")
