"""Cleaning and derived columns of the play fact (row-level, no shuffle
except the P3 dedup and the P12 one-row bound)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore import schemas
from encore.functions import exprs as X

# Raw export field → short name (P1); the script variant
RENAME_SCRIPT = {
    "ip_addr_decrypted": "ip_addr",
    "master_metadata_track_name": "track_name",
    "master_metadata_album_artist_name": "artist_name",
    "master_metadata_album_album_name": "album_name",
}

# columns of the cleaned play fact, in order (P14, script variant + names kept
# for the website-style report which keys tracks by (name, artist))
PLAY_COLUMNS = [
    "track_id", "track_name", "artist_name", "album_name", "ts", "ms_played", "reason_start",
    "reason_end", "full_play", "conn_country", "platform", "shuffle", "offline", "incognito_mode",
]


def rename_fields(df: DataFrame) -> DataFrame:
    """P1."""
    present = {k: v for k, v in RENAME_SCRIPT.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def drop_non_music(df: DataFrame, track_col: str = "track_name") -> DataFrame:
    """Keep rows with a track name; the literal text ``None`` counts as missing."""
    c = F.col(track_col)
    return df.filter(c.isNotNull() & (c != "None"))


def fill_flags(df: DataFrame) -> DataFrame:
    """A null flag is false (before the dedup, so that copies that differ in null and false are one play)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in schemas.PLAY_FLAGS if c in df.columns})


def dedup_plays(df: DataFrame) -> DataFrame:
    """Remove exact full-row duplicates (over all raw columns, before pruning). The texts of a row go as one."""
    texts = X.text_columns(df)
    return X.unpack_texts(X.pack_texts(df, texts).dropDuplicates(), texts, df.columns) if texts else df.dropDuplicates()


def parse_ts(df: DataFrame, col: str = "ts") -> DataFrame:
    """``yyyy-MM-ddTHH:mm:ssZ`` text → timestamp_ntz (UTC wall time)."""
    return df.withColumn(col, F.to_timestamp_ntz(F.col(col), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def offline_epoch_seconds(o) -> F.Column:
    """P5: epochs above 2e9 are milliseconds → seconds (fraction kept)."""
    o = X.col(o)
    return F.when(o > X.OFFLINE_MS_THRESHOLD, o / 1000.0).otherwise(o.cast("double"))


def effective_ts(df: DataFrame, ts_col: str = "ts", offline_col: str = "offline_timestamp") -> DataFrame:
    """P5+P6: use the offline epoch when it is a valid time (> 100 s), else ``ts``."""
    secs = offline_epoch_seconds(offline_col)
    offline_ts = F.timestamp_micros(F.round(secs * 1_000_000).cast("long")).cast("timestamp_ntz")
    return df.withColumn(
        ts_col, F.when(secs > X.OFFLINE_MIN_VALID, offline_ts).otherwise(F.col(ts_col))
    )


def map_reasons(df: DataFrame) -> DataFrame:
    """Raw reason codes → labels."""
    return df.withColumns({
        "reason_start": X.map_values("reason_start", X.REASON_START_LABELS),
        "reason_end": X.map_values("reason_end", X.REASON_END_LABELS),
    })


def mark_full_play(df: DataFrame) -> DataFrame:
    """A play is full when it ended with ``trackdone`` (null → false)."""
    return df.withColumn("full_play", F.coalesce(F.col("reason_end") == X.FULL_PLAY_REASON, F.lit(False)))


def track_id_from_uri(df: DataFrame, uri_col: str = "spotify_track_uri") -> DataFrame:
    """Last ``:`` segment of the track URI."""
    return df.withColumn("track_id", F.element_at(F.split(F.col(uri_col), ":"), -1))


def with_hours(df: DataFrame) -> DataFrame:
    """P10: hours_played = ms / 3,600,000 (aggregates sum ms and divide once)."""
    return df.withColumn("hours_played", X.hours(F.col("ms_played")))


def with_calendar(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Year, month, year_month, day, weekday name/number, hour."""
    ts = F.col(ts_col)
    return df.withColumns({
        "year": F.year(ts),
        "month": F.month(ts),
        "year_month": F.date_format(ts, "yyyy-MM"),
        "day": F.to_date(ts),
        "day_name": F.date_format(ts, "EEEE"),
        "hour": F.hour(ts),
        "month_seq": F.year(ts) * 12 + F.month(ts) - 1,
    })


def with_month_index(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whole months since the earliest month (per ``by`` group).

    The minimum is a partial+final aggregate joined back on ``by`` (a one-row
    broadcast when ``by`` is empty), never a window over the whole fact.
    """
    by = list(by)
    if "month_seq" not in df.columns:
        df = with_calendar(df)
    first = df.groupBy(*by).agg(F.min("month_seq").alias("_first_seq"))
    if by:
        out = df.join(first, by)
    else:
        out = df.crossJoin(F.broadcast(first))  # exactly one row
    return out.withColumn("month_index", F.col("month_seq") - F.col("_first_seq")).drop("_first_seq")


def sort_by_ts(df: DataFrame, total: bool = False) -> DataFrame:
    """Order plays by time. Operators never rely on row order; this is for
    sinks. ``total=False`` sorts within partitions (no shuffle, e.g. before a
    partitioned write); ``total=True`` is a global range-partitioned sort."""
    return df.orderBy("ts") if total else df.sortWithinPartitions("ts")


def country_name(df: DataFrame, names: DataFrame, col: str = "conn_country", default: str = "unknown") -> DataFrame:
    """ISO alpha-2 code → country name, ``default`` when the code is unknown.

    The code → name table is data supplied by the caller (``names`` with
    columns ``code``, ``name``), joined left on the code; the planner
    broadcasts it when its runtime size is small. (The reference's own mapping
    never fires — its column is renamed before the check — so report tables
    keep codes unless this is applied.)
    """
    lookup = names.select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    joined = df.join(lookup, F.col(col) == F.col("_code"), "left")
    return joined.withColumn(col, F.coalesce(F.col("_name"), F.lit(default))).drop("_code", "_name")


def split_composite(df: DataFrame, col: str, into: tuple[str, str]) -> DataFrame:
    """``name~~sep~~artist`` back to two columns (for composite-key inputs)."""
    parts = F.split(F.col(col), X.COMPOSITE_SEP, 2)
    return df.withColumns({into[0]: parts.getItem(0), into[1]: F.element_at(parts, 2)})


def round_numeric(df: DataFrame, digits: int = 2) -> DataFrame:
    """Every double column rounded for display (sinks only), the way the
    reference's frame rounding does it: scale, round half-even on the binary
    value (``rint``), unscale — so 2.675 (stored as 2.67499…) shows as 2.67."""
    scale = float(10**digits)
    return df.withColumns({
        f.name: F.rint(F.col(f.name) * scale) / scale
        for f in df.schema.fields
        if f.dataType.typeName() in ("double", "float")
    })


def wide_fact(raw: DataFrame) -> DataFrame:
    """Cleaned wide fact (E14 shape) from a raw-reason wide binding: P7, P8, P10."""
    return with_hours(mark_full_play(map_reasons(raw)))


def report_plays(raw: DataFrame) -> DataFrame:
    """Website-style fact: wide fact + calendar columns.

    The month index (P12) needs a minimum over the whole fact, so it is added
    only by the operator that reads it (R5), not carried by every report table.
    """
    return with_calendar(wide_fact(raw))


def clean_history(raw: DataFrame) -> DataFrame:
    """P1–P15 on a raw export frame: rename, drop non-music, dedup, timestamps,
    reasons, full_play, track id, projection. Order matters: dedup runs over
    all raw columns before any is dropped (T13). A ``listener_id`` column, if
    the source has one, is part of a play: the same play of two listeners stays
    two plays."""
    df = fill_flags(rename_fields(raw))
    df = drop_non_music(df)
    df = dedup_plays(df)
    df = parse_ts(df)
    df = effective_ts(df)
    df = map_reasons(df)
    df = mark_full_play(df)
    df = track_id_from_uri(df)
    extra = [c for c in ("listener_id",) if c in df.columns]
    return df.select(*extra, *PLAY_COLUMNS)


def clean_rows(raw: DataFrame) -> DataFrame:
    """The row-wise part of :func:`clean_history`, without the dedup; raw columns are kept beside the cleaned ones."""
    df = drop_non_music(fill_flags(rename_fields(raw)))
    df = effective_ts(parse_ts(df))
    return track_id_from_uri(mark_full_play(map_reasons(df)))
