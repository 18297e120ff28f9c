"""Sinks.

* ``write_parquet`` (S6): table sink, optionally partitioned (e.g. by year) and
  clustered (e.g. by time).
* ``write_csv`` (S7): the cleaned fact with ``ts`` as ``yyyy-MM-dd HH:mm:ss``.
* ``write_report`` (S8): every report table in one format, lines of
  ``{"first": n, "columns": [...], "data": [[...], ...]}`` (with the group's
  keys, where there are groups). ``data`` holds at most ``DOCUMENT_ROWS`` rows
  in the table's order, typed, rounded to 2 digits half-even, under display
  names; ``first`` is the place of its first row. A table of fewer rows is one
  such document; a long one is several, so no task holds a whole table. The
  KPIs are one JSON object per group.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encore.functions import exprs as X
from encore.operators.clean import round_numeric
from encore.sources.history import CSV_OPTIONS

DOCUMENT_ROWS = 1000

# Display names of report columns (P20); internal names stay snake_case.
DISPLAY_NAMES = {
    "artist_name": "artist", "track_name": "track", "album_name": "album", "play_count": "play count",
    "hours_played": "hours played", "unique_tracks_played": "# of unique tracks played", "year_month": "month",
    "top_1_song": "top-1 song", "top_2_song": "top-2 song", "top_3_song": "top-3 song",
    "most_played_artist": "most played artist", "most_played_track": "most played track",
    "most_played_album": "most played album", "minutes_played": "minutes played", "avg_play_count": "play count",
    "num_songs": "num of songs", "unique_per_year": "unique per year", "hour": "hour of the day",
    "percent_of_play_time": "percent of play time", "avg_hours_played_per_day": "avg hours played per day",
    "day_name": "day name", "number_of_tracks": "number of tracks", "number_of_artists": "number of artists",
    "percent_of_played_songs": "percent of played songs",
}

# The order of each report table: columns (a leading "-" is descending), or the place itself as SQL where a table is
# long. ``rank`` is only an order and is not shown.
TABLE_ORDER: dict[str, list[str] | str] = {
    "most_played_artists_total": ["rank"], "most_played_tracks_total": ["rank"], "most_played_albums_total": ["rank"],
    "most_played_tracks_total_reason_start_clickrow": ["rank"], "top_songs_of_top_artists": ["rank"],
    "monthly_play_series_artists": ["rank", "month_index"], "monthly_play_series_tracks": ["rank", "month_index"],
    "monthly_play_series_albums": ["rank", "month_index"],
    "most_played_artists_track_album_monthly": ["-year_month"], "avg_track_length_monthly": ["year_month"],
    "avg_play_count_per_song_yearly": ["year"], "play_count_distribution": ["-play_count"], "yearly_track_play_count": ["year"],
    "hours_played_percent_per_hour_of_the_day": ["hour"], "avg_hours_played_per_year_month": ["year_month"],
    "avg_hours_played_per_year": ["year"], "avg_hours_played_per_month": ["month"], "avg_hours_played_per_day_name": ["day_name"],
    "plays_per_county_total": ["-play_count", "country"],
    "cumulative_percent_play_count_track": "number_of_tracks", "cumulative_percent_play_count_artist": "number_of_artists",
}


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
                  cluster_by: Sequence[str] = (), files: int | None = None) -> None:
    """S6. With ``cluster_by`` the rows are range-partitioned by the partition columns and these, and sorted by them.

    Ranges are cut from a sample of the keys. A range of rows is one file, two where it crosses a partition value, so that
    there are at most ``files`` (default: the shuffle partitions) plus one per partition value, however many tasks the
    input has; and a filter on ``cluster_by`` skips the files and row groups of other ranges by their minima and maxima.
    """
    if cluster_by:
        keys = [*partition_by, *cluster_by]
        ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
        df = ranged.sortWithinPartitions(*keys)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lossless CSV (``sources.history.CSV_OPTIONS``): spaces, quotes, line breaks, empty and null text come back."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def rename_for_display(df: DataFrame) -> DataFrame:
    """P20."""
    return df.withColumnsRenamed({k: v for k, v in DISPLAY_NAMES.items() if k in df.columns})


def _place(name: str, df: DataFrame, by: Sequence[str]) -> Column:
    """The place of each row in its table, from 0."""
    order = TABLE_ORDER[name]
    if isinstance(order, str):
        return F.expr(order).cast("bigint")
    if order == ["rank", "month_index"]:  # every entity has the same months
        months = F.max("month_index").over(Window.partitionBy(*by)) if by else None
        if months is None:
            last = df.agg(F.max("month_index").alias("m")).first()["m"] or 0  # one number
            months = F.lit(int(last))
        return ((F.col("rank") - 1) * (months + 1) + F.col("month_index")).cast("bigint")
    calendar = {"month": X.MONTH_NAMES, "day_name": X.WEEKDAYS}
    keys = []
    for column in order:
        plain = column.lstrip("-")
        key = F.array_position(F.array(*[F.lit(v) for v in calendar[plain]]), F.col(plain)) if plain in calendar else F.col(plain)
        keys.append(key.desc() if column.startswith("-") else key.asc())
    # these tables have at most k rows, or one per period, in a group
    return (F.row_number().over(Window.partitionBy(*by).orderBy(*keys)) - 1).cast("bigint")


def split_documents(name: str, df: DataFrame, by: Sequence[str] = (), rows: int = DOCUMENT_ROWS) -> DataFrame:
    """The documents of report table ``name`` as lines ``value`` (with ``by`` and ``first``, by which they are ordered)."""
    by = list(by)
    placed = round_numeric(df).withColumn("_place", _place(name, df, by))
    shown = [c for c in df.columns if c not in by and c != "rank"]
    # one cell as JSON: an array of one value without its brackets
    cell = "substring(to_json(array(`{0}`)), 2, length(to_json(array(`{0}`))) - 2)"
    row = F.concat(F.lit("["), F.concat_ws(",", *[F.expr(cell.format(c)) for c in shown]), F.lit("]"))
    chunks = placed.groupBy(*by, F.floor(F.col("_place") / rows).alias("_chunk")).agg(
        F.min("_place").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("_place", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    head = F.to_json(F.struct(*by, "first", F.array(*[F.lit(DISPLAY_NAMES.get(c, c)) for c in shown]).alias("columns")))
    value = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"data":['), F.concat_ws(",", "rows"), F.lit("]}"))
    return chunks.withColumn("_head", head).select(*by, "first", value.alias("value")).orderBy(*by, "first")


def write_report(tables: dict[str, DataFrame], single_values: DataFrame, path: str,
                 by: Sequence[str] = (), mode: str = "overwrite", at_once: int = 4) -> None:
    """``path/<table>/`` holds the table's documents as lines, ``path/single_values/`` the KPIs; ``at_once`` jobs at a time."""
    def one(name: str, df: DataFrame) -> None:
        split_documents(name, df, by).select("value").write.mode(mode).text(f"{path}/{name}")

    with ThreadPoolExecutor(at_once) as pool:
        jobs = [pool.submit(one, name, df) for name, df in tables.items()]
        jobs.append(pool.submit(lambda: single_values.write.mode(mode).json(f"{path}/single_values")))
        for job in jobs:
            job.result()


def read_report_values(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Every cell of written report tables: ``table_name, position, column_name, value`` (the cell's JSON text)."""
    cells = None
    for name in names:
        doc = "struct<first:bigint,columns:array<string>,data:array<string>>"
        lines = spark.read.text(f"{path}/{name}").select(F.from_json("value", doc).alias("d"))
        rows = lines.select("d.first", "d.columns", F.posexplode("d.data").alias("i", "row")).select(
            "columns", (F.col("first") + F.col("i")).alias("position"), F.from_json("row", "array<string>").alias("row"))
        own = rows.select(F.lit(name).alias("table_name"), "position", F.posexplode(F.arrays_zip("columns", "row")).alias("j", "c")).select(
            "table_name", "position", F.col("c.columns").alias("column_name"), F.col("c.row").alias("value"))
        cells = own if cells is None else cells.unionByName(own)
    return cells
