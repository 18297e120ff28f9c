"""The report's aggregate lattice: three mergeable cuboids of the play fact, and measures that read either.

* entity months: a row per (track name, artist name, album name, month), and its roll-up without the month;
* days: a row per day, with the counters of the KPIs;
* places: a row per (hour of day, connection country).

Every measure is a count or an integer sum, so that cuboids of parts of a fact add up to the cuboid of the whole, and
every report table is an aggregate of the smallest cuboid that has its columns. The report operators take a fact or a
cuboid: they name their measures by the functions below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions import exprs as X

N, FULL, MS, FULL_MS = "_plays", "_full_plays", "_ms", "_full_ms"
CLICK = {N: "_click_plays", FULL: "_click_full_plays", MS: "_click_ms"}


def is_cuboid(df: DataFrame) -> bool:
    return FULL in df.columns


def plays(df: DataFrame) -> Column:
    """Aggregate: number of plays."""
    return F.sum(N) if is_cuboid(df) else F.count(F.lit(1))


def full_plays(df: DataFrame) -> Column:
    """Aggregate: number of full plays."""
    return F.sum(FULL) if is_cuboid(df) else F.count_if("full_play")


def ms(df: DataFrame) -> Column:
    """Aggregate: milliseconds played."""
    return F.sum(MS) if is_cuboid(df) else F.sum("ms_played")


def full_ms(df: DataFrame) -> Column:
    """Aggregate: milliseconds of full plays."""
    return F.sum(FULL_MS) if is_cuboid(df) else F.sum(F.when(F.col("full_play"), F.col("ms_played")))


def with_full_plays(df: DataFrame) -> DataFrame:
    """The rows that stand for a full play; of a cuboid's other plays only the full ones may be counted then."""
    return df.filter(F.col(FULL) > 0) if is_cuboid(df) else df.filter("full_play")


def clicked(df: DataFrame) -> DataFrame:
    """The plays started by clicking a row."""
    if not is_cuboid(df):
        return df.filter(F.col("reason_start") == "clickrow")
    rest = [c for c in df.columns if c not in (*CLICK, *CLICK.values())]
    return df.filter(F.col(CLICK[N]) > 0).select(*rest, *[F.col(c).alias(name) for name, c in CLICK.items()])


def _sums() -> list[Column]:
    full = F.col("full_play")
    return [F.count(F.lit(1)).alias(N), F.count_if(full).alias(FULL), F.sum("ms_played").alias(MS),
            F.sum(F.when(full, F.col("ms_played")).otherwise(0)).alias(FULL_MS)]


def entity_months(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row per (names, month), with the calendar columns of the month; ``month_index`` is kept if the fact has it."""
    click = F.col("reason_start") == "clickrow"
    month = ["month_seq", *[c for c in ("month_index",) if c in fact.columns]]
    return fact.groupBy(*by, "track_name", "artist_name", "album_name", *month).agg(
        *_sums(), F.count_if(click).alias(CLICK[N]), F.count_if(click & F.col("full_play")).alias(CLICK[FULL]),
        F.sum(F.when(click, F.col("ms_played")).otherwise(0)).alias(CLICK[MS]))


def with_month_columns(cuboid: DataFrame) -> DataFrame:
    """``year``, ``month`` and ``year_month`` of an entity-month cuboid."""
    year = F.floor(F.col("month_seq") / 12).cast("int")
    month = (F.col("month_seq") % 12 + 1).cast("int")
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))
    return cuboid.withColumns({"year": year, "month": month, "year_month": text})


def rolls_up(cuboid: DataFrame, by: Sequence[str] = (), least: float = 2.0) -> bool:
    """Whether the roll-up has at most one ``least``-th of the rows of the entity months, by an estimate in one pass."""
    found = cuboid.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(
        F.xxhash64(*by, "track_name", "artist_name", "album_name")).alias("names")).first()
    return found["names"] * least <= found["rows"]


def without_months(cuboid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The roll-up of entity months to a row per names."""
    measures = [c for c in cuboid.columns if c.startswith("_")]
    return cuboid.groupBy(*by, "track_name", "artist_name", "album_name").agg(*[F.sum(c).alias(c) for c in measures])


# Counters of the KPIs, by name; each is a count or an integer sum over plays.
def kpi_counters() -> dict[str, Column]:
    fp, shuffle, rs = F.col("full_play"), F.col("shuffle"), F.col("reason_start")
    skip, length = F.col("reason_end") == X.SKIP_REASON, F.col("ms_played")
    return {
        "_fp_shuffle": F.count_if(fp & shuffle), "_shuffle": F.count_if(shuffle), "_skips": F.count_if(skip),
        "_skip_ms": F.sum(F.when(skip, length)), "_skip_3s": F.count_if(skip & (length < 3000)),
        "_skip_30s": F.count_if(skip & (length > 30000)), "_skip_120s": F.count_if(skip & (length > 120000)),
        "_skip_shuffle": F.count_if(skip & shuffle), "_skip_no_shuffle": F.count_if(skip & ~shuffle),
        "_no_shuffle": F.count_if(~shuffle), "_rs_fwd": F.count_if(rs == "forward button"),
        "_rs_back": F.count_if(rs == "back button"), "_rs_done": F.count_if(rs == "trackdone"),
        "_rs_click": F.count_if(rs == "clickrow"), "_fp_incognito": F.count_if(fp & F.col("incognito_mode")),
        "_fp_click": F.count_if(fp & (rs == "clickrow")),
    }


def days(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row per day with the KPI counters."""
    return fact.groupBy(*by, "day").agg(*_sums(), *[e.alias(n) for n, e in kpi_counters().items()])


def with_day_columns(cuboid: DataFrame) -> DataFrame:
    day = F.col("day")
    return cuboid.withColumns({"year": F.year(day), "month": F.month(day), "year_month": F.date_format(day, "yyyy-MM")})


def places(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row per (hour of day, connection country)."""
    return fact.groupBy(*by, "hour", "conn_country").agg(*_sums())


def names(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Full plays per (artist, track, album) of a fact or an entity cuboid: what the KPIs need of the names."""
    return df.groupBy(*by, "artist_name", "track_name", "album_name").agg(full_plays(df).alias(FULL))


def merged(parts: DataFrame) -> DataFrame:
    """Cuboid rows of several parts of a fact → the cuboid of the whole."""
    measures = [c for c in parts.columns if c.startswith("_")]
    return parts.groupBy(*[c for c in parts.columns if c not in measures]).agg(*[F.sum(c).alias(c) for c in measures])
