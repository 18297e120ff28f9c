"""DuckDB SQL text for the oracle side of the correctness check.

These strings are the independent statement of each operator's semantics:
the driver runs them with DuckDB on the same parquet tables and compares
row count, schema and values with the Spark result. Types are cast to the
types Spark produces (INTEGER for calendar parts, BIGINT for counts and sums,
DOUBLE for ratios) so schemas agree too.
"""

from __future__ import annotations

# Binding of the driver tables (FIXTURES §3.1, plus track_duration_ms and website).
RAW_WIDE = """
SELECT
  c.c_custkey % 50                                                        AS listener_id,
  p.p_name || '|' || CAST(s.s_suppkey AS VARCHAR)                         AS track_id,
  p.p_name                                                                AS track_name,
  s.s_suppkey                                                             AS artist_id,
  s.s_name                                                                AS artist_name,
  split_part(p.p_name, ' ', 1) || '|' || CAST(s.s_suppkey AS VARCHAR)     AS album_id,
  split_part(p.p_name, ' ', 1)                                            AS album_name,
  1940 + (s.s_suppkey * 7) % 85                                           AS album_release_year,
  CASE WHEN s.s_suppkey % 5 = 0 THEN NULL ELSE 'Q' || CAST(s.s_suppkey AS VARCHAR) END AS wikidata_entity_id,
  CASE s.s_suppkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END        AS gender,
  CASE WHEN s.s_suppkey % 4 = 3 THEN NULL ELSE s.s_suppkey % 2 = 0 END    AS is_band,
  CASE WHEN s.s_suppkey % 5 = 0 THEN NULL ELSE sn.n_name END              AS country,
  CASE WHEN s.s_suppkey % 10 = 0 THEN ''
       ELSE (CASE s.s_suppkey % 4 WHEN 0 THEN 'art rock' WHEN 1 THEN 'Hip-Hop' WHEN 2 THEN 'dream pop' ELSE 'classical' END)
            || ';' || lower(sr.r_name) END                                AS artist_genres,
  abs(CAST(floor(s.s_acctbal) AS BIGINT)) % 101                           AS artist_popularity,
  CAST(p.p_size AS BIGINT) * 6000                                         AS track_duration_ms,
  CASE WHEN s.s_suppkey % 5 = 0 THEN NULL
       ELSE 'https://artist' || CAST(s.s_suppkey AS VARCHAR) || '.example.org' END AS website,
  l.l_shipdate + to_hours(CAST((l.l_orderkey * 37 + l.l_linenumber * 3) % 24 AS INT)) AS ts,
  CAST(l.l_quantity AS BIGINT) * 6000                                     AS ms_played,
  CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'clickrow' WHEN '2' THEN 'fwdbtn' WHEN '3' THEN 'trackdone' WHEN '4' THEN 'backbtn' ELSE 'playbtn' END AS reason_start,
  CASE l.l_returnflag WHEN 'N' THEN 'trackdone' WHEN 'A' THEN 'fwdbtn' ELSE 'endplay' END AS reason_end,
  cn.n_name                                                               AS conn_country,
  c.c_mktsegment                                                          AS platform,
  l.l_linestatus = 'F'                                                    AS shuffle,
  o.o_orderstatus = 'P'                                                   AS offline,
  l.l_discount = 0.0                                                      AS incognito_mode
FROM lineitem l
JOIN orders o    ON l.l_orderkey = o.o_orderkey
JOIN customer c  ON o.o_custkey = c.c_custkey
JOIN nation cn   ON c.c_nationkey = cn.n_nationkey
JOIN part p      ON l.l_partkey = p.p_partkey
JOIN supplier s  ON l.l_suppkey = s.s_suppkey
JOIN nation sn   ON s.s_nationkey = sn.n_nationkey
JOIN region sr   ON sn.n_regionkey = sr.r_regionkey
"""

# P7 + P8 + P10 on top of the binding; plays of three lengths have no artist, track or album name.
WIDE = """
SELECT * REPLACE (
    CASE reason_start WHEN 'backbtn' THEN 'back button' WHEN 'fwdbtn' THEN 'forward button'
                      WHEN 'playbtn' THEN 'play button' ELSE reason_start END AS reason_start,
    CASE reason_end WHEN 'backbtn' THEN 'back button' WHEN 'endplay' THEN 'end play'
                    WHEN 'fwdbtn' THEN 'forward button' ELSE reason_end END AS reason_end,
    CASE WHEN ms_played <> 102000 THEN artist_name END AS artist_name,
    CASE WHEN ms_played <> 138000 THEN track_name END AS track_name,
    CASE WHEN ms_played <> 174000 THEN album_name END AS album_name),
  coalesce(reason_end = 'trackdone', false) AS full_play,
  ms_played / 3600000 AS hours_played
FROM raw
"""

# P11 + P12 (website report fact).
PLAYS = """
SELECT *,
  CAST(year(ts) AS INTEGER) AS year,
  CAST(month(ts) AS INTEGER) AS month,
  strftime(ts, '%Y-%m') AS year_month,
  CAST(ts AS DATE) AS day,
  dayname(ts) AS day_name,
  CAST(hour(ts) AS INTEGER) AS hour,
  CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS month_seq,
  CAST(year(ts) * 12 + month(ts) - 1 - min(year(ts) * 12 + month(ts) - 1) OVER ({part}) AS INTEGER) AS month_index
FROM wide
"""


def with_wide(body: str) -> str:
    return f"WITH raw AS ({RAW_WIDE}), wide AS ({WIDE})\n{body}"


def with_plays(body: str, by: tuple[str, ...] = ()) -> str:
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    return f"WITH raw AS ({RAW_WIDE}), wide AS ({WIDE}), plays AS ({PLAYS.format(part=part)})\n{body}"


def rr(num: str, den: str, digits: int = 2, mult: int = 1) -> str:
    """Exact half-even rounding of num/den (non-negative integers); mirrors ``exprs.round_ratio``."""
    scale = 10**digits
    n = f"(CAST({num} AS HUGEINT) * {scale * mult})"
    d = f"nullif(CAST({den} AS HUGEINT), 0)"
    q = f"({n} // {d})"
    r = f"({n} % {d})"
    rounded = f"CAST({q} + CASE WHEN 2 * {r} > {d} THEN 1 WHEN 2 * {r} = {d} THEN {q} % 2 ELSE 0 END AS BIGINT)"
    return f"({rounded} / {scale})" if digits else f"CAST({rounded} AS BIGINT)"


def pct(part: str, whole: str, digits: int = 0) -> str:
    return rr(part, whole, digits, 100)


def hours2(sum_ms: str, digits: int = 2) -> str:
    return rr(sum_ms, "3600000", digits)


def first(c: str) -> str:
    """First non-null value in time order, the smallest of one time; mirrors ``common.first_value``."""
    return f"first({c} ORDER BY ts, {c}) FILTER ({c} IS NOT NULL)"


SUM_MS = "CAST(sum(ms_played) AS BIGINT)"
FP = "CAST(count_if(full_play) AS BIGINT)"
SKIP = "CAST(count_if(NOT full_play) AS BIGINT)"
