"""Helpers shared by the report and recipe operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Largest row count a side may have to be broadcast by an explicit hint: with keys of at most about 200 bytes a row
# that is 20 MB, twice Spark's own threshold for a side whose size it knows.
MAX_BROADCAST_ROWS = 100_000


def bounded_broadcast(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Hint a broadcast only for a side whose row count is bounded by ``max_rows``
    (e.g. a top-k table without grouping) and the bound is small; otherwise the
    plain side is returned and AQE chooses by the runtime size."""
    if max_rows is not None and max_rows <= MAX_BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def top_k(df: DataFrame, order: Sequence[Column], k: int | None, by: Sequence[str] = (), rank: str | None = None) -> DataFrame:
    """Top ``k`` rows by ``order`` (overall, or per ``by`` group), in that order; ``rank`` names a column for the place.

    Without ``by`` this is ``orderBy().limit()`` → TakeOrderedAndProject: each
    partition keeps its own top k and only those are merged. With ``by`` it is
    ``row_number() <= k``, which Spark plans as a partial WindowGroupLimit
    before the shuffle, so a hot group ships at most k rows per map partition.
    ``k=None`` keeps every row (ordering only).
    """
    by = list(by)
    if k is None:
        return df.orderBy(*[F.col(b) for b in by], *order)
    if not by:
        top = df.orderBy(*order).limit(k)
        # k rows
        return top if rank is None else top.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    place = rank or "_rn"
    ranked = df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).filter(F.col(place) <= k)
    return ranked if rank else ranked.drop(place)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Whole row that sorts first per ``keys`` (idxmax / groupby.first after a sort).

    ``order`` is ``[(column, descending), ...]``; descending columns must be
    numeric. Implemented as ``min_by(row, ordering struct)`` — an aggregate
    with map-side partial aggregation — so a hot group (one month, country or
    artist holding a large share of rows) is reduced inside every map task
    instead of being sorted whole in one task as a window would.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[(-F.col(c) if desc else F.col(c)).alias(f"_o{i}") for i, (c, desc) in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def first_value(c: str, ts: str = "ts") -> Column:
    """First non-null value in time order (pandas ``groupby.first`` on a ts-sorted fact); the smallest of one time."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(ts, c)))


def grouped_firsts(
    df: DataFrame, keys: Sequence[str], firsts: Sequence[str], sums: dict[str, Column],
    mins: dict[str, Column] | None = None, maxs: dict[str, Column] | None = None, ts: str = "ts",
) -> DataFrame:
    """Per ``keys``: the first non-null value in time of each of ``firsts``, sums, minima and maxima.

    Text cannot sit in a hash aggregate's buffer, so a plain ``min_by`` would sort the fact. Here the fact is
    hash-aggregated by the keys and the values together (few combinations per key) with the first time of each; the
    first values are then picked from those rows.
    """
    mins, maxs, keys = mins or {}, maxs or {}, list(keys)
    fine = df.groupBy(*keys, *firsts).agg(
        F.min(ts).alias("_t"), *[e.alias(n) for n, e in sums.items()],
        *[F.min(e).alias(n) for n, e in mins.items()], *[F.max(e).alias(n) for n, e in maxs.items()])
    return fine.groupBy(*keys).agg(
        *[first_value(c, "_t").alias(c) for c in firsts], *[F.sum(n).alias(n) for n in sums],
        *[F.min(n).alias(n) for n in mins], *[F.max(n).alias(n) for n in maxs])


def full_plays() -> Column:
    return F.count_if(F.col("full_play"))


def skips() -> Column:
    return F.count_if(~F.col("full_play"))


def sum_ms() -> Column:
    return F.sum("ms_played").alias("sum_ms")
