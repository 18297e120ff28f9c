"""The website report over the cleaned play fact.

Input is the website-style fact of ``clean.report_plays`` (wide fact +
calendar columns + month index), or a cuboid of it (``operators.cuboids``)
that has the columns a table needs: R5, R7, R9 and R11 take entity months, R8 and
R13–R16 days, R12 and R17 places, the others a row per names. Entities are keyed the website way:
artist by name, track by (track name, artist name), album by (album name,
artist name); ties sort by the reference's composite text key.

Scale notes
* every table is an aggregate first; windows and explodes only ever run on
  aggregated rows (≤ entities, ≤ months, ≤ distinct play counts);
* calendar denominators are computed arithmetically from the first/last day
  per group (a month spine of ≤ a few hundred rows, or 7 weekdays), never a
  per-day spine joined to the fact;
* the cumulative share (R18) is built from the play-count histogram and its
  ranks are generated in bounded chunks spread over tasks.
"""

from __future__ import annotations

import secrets
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions import exprs as X
from encore.operators import cuboids as C
from encore.operators.common import bounded_broadcast, first_row, top_k

# entity → key columns; ties sort by the keys joined with the composite separator
ENTITIES = {
    "artist": ["artist_name"],
    "track": ["track_name", "artist_name"],
    "album": ["album_name", "artist_name"],
}

# Bars of the monthly play images are this many pixels high (fixed value).
BAR_HEIGHT = 40
# Ranks of one histogram bucket are generated in chunks of this size.
RANK_CHUNK = 100_000


def _keys(entity: str) -> list[str]:
    return ENTITIES[entity]


def sort_key(entity: str) -> Column:
    keys = ENTITIES[entity]
    return F.col(keys[0]) if len(keys) == 1 else F.concat_ws(X.COMPOSITE_SEP, *keys)


def _non_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.filter(cond) if cond is not None else df


def _one_row_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group frames on ``by``; with no ``by`` both sides have one row."""
    by = list(by)
    if by:
        return left.join(right, by, how)
    return left.crossJoin(F.broadcast(right))


# ---------------------------------------------------------------------------
# Most played entities


def entity_play_counts(plays: DataFrame, entity: str, by: Sequence[str] = ()) -> DataFrame:
    """Σ full plays and Σ ms per entity (all rows, zero-full-play entities kept)."""
    by = list(by)
    keys = _keys(entity)
    return (
        _non_null(plays, keys).groupBy(*by, *keys)
        .agg(C.full_plays(plays).alias("play_count"), C.ms(plays).alias("sum_ms"))
        .withColumn("_sort", sort_key(entity))
    )


def most_played(plays: DataFrame, entity: str, k: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """Top k entities by full plays (ties by key), with hours and their ``rank``, in that order.

    Entities with no full play drop out after the top-k (the reference merges
    with the monthly images, which only exist for full plays). Artists also get
    the number of distinct tracks over *all* rows: counts, hours and distinct
    tracks all come from one aggregate per (artist, track), one scan of the fact.
    """
    by = list(by)
    keys = _keys(entity)
    extra = []
    if entity == "artist":
        extra = ["unique_tracks_played"]
        counts = (
            _non_null(plays, keys).groupBy(*by, "artist_name", "track_name")
            .agg(C.full_plays(plays).alias("play_count"), C.ms(plays).alias("sum_ms"))
            .groupBy(*by, "artist_name")
            .agg(F.sum("play_count").alias("play_count"), F.sum("sum_ms").alias("sum_ms"),
                 F.count("track_name").alias("unique_tracks_played"))
            .withColumn("_sort", sort_key(entity))
        )
    else:
        counts = entity_play_counts(plays, entity, by)
    top = top_k(counts, [F.desc("play_count"), F.asc("_sort")], k, by, "rank").filter(F.col("play_count") > 0)
    return top.select(*by, *keys, "play_count", X.hours(F.col("sum_ms")).alias("hours_played"), *extra, "rank").orderBy(*by, "rank")


def most_played_artists(plays: DataFrame, k: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """R1."""
    return most_played(plays, "artist", k, by)


def most_played_tracks(plays: DataFrame, k: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """R2."""
    return most_played(plays, "track", k, by)


def most_played_albums(plays: DataFrame, k: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """R3."""
    return most_played(plays, "album", k, by)


def most_played_tracks_clickrow(plays: DataFrame, k: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """R2 over plays started by clicking a row."""
    return most_played(C.clicked(plays), "track", k, by)


# ---------------------------------------------------------------------------
# Monthly play series of the top entities


def monthly_play_series(plays: DataFrame, entity: str, k: int = 100, by: Sequence[str] = (),
                        month_index_ready: bool = False, totals: DataFrame | None = None) -> DataFrame:
    """For each top-k entity, full plays per month index, dense from 0 to the
    last month with a full play of any top entity, with bar heights
    ``min(round(count·40/p99), 40)``; p99 = linear 99th percentile of the
    non-zero monthly counts. ``p99_plays`` is the label value int(p99).
    ``month_index_ready``: ``plays`` already carries the month index for this ``by``. ``totals``: a cuboid of the same
    plays without months; the top entities then come from it, and only their rows of ``plays`` are aggregated."""
    by = list(by)
    keys = _keys(entity)
    # one row per entity and month; everything but the first month of all comes from it
    month = "month_index" if month_index_ready else "month_seq"
    months = F.collect_list(F.when(F.col("n") > 0, F.struct(F.col(month).alias("m"), "n")))  # at most the history's months
    order = [F.desc("play_count"), F.asc("_sort")]
    first = None
    if totals is None:
        # plays without a name count for the first month only. The condition on the names stays above the counts, so that
        # the top entities and the first month read one shuffle of the plays
        named = F.lit(True)
        for key in keys:
            named = named & F.col(key).isNotNull()
        monthly = plays.groupBy(*by, *keys, month).agg(C.full_plays(plays).alias("n"))
        entities = monthly.filter(F.when(named, F.col("n")) >= 0).groupBy(*by, *keys).agg(
            F.sum("n").alias("play_count"), months.alias("months")).withColumn("_sort", sort_key(entity))
        top = top_k(entities, order, k, by, "rank").filter(F.col("play_count") > 0)
        first = monthly.groupBy(*by).agg(F.min(F.when(F.col("n") >= 0, F.col(month))).alias("first"))
    else:
        ranked = top_k(entity_play_counts(totals, entity, by), order, k, by, "rank").filter(F.col("play_count") > 0)
        ranked = bounded_broadcast(ranked.select(*by, *keys, "rank"), None if by else k)
        monthly = plays.join(ranked, [*by, *keys]).groupBy(*by, *keys, "rank", month).agg(C.full_plays(plays).alias("n"))
        top = monthly.groupBy(*by, *keys, "rank").agg(months.alias("months"))
    if month_index_ready:
        top = top.withColumn("first", F.lit(0))
    else:
        first = plays.groupBy(*by).agg(F.min("month_seq").alias("first")) if first is None else first
        top = _one_row_join(top, first, by)
    series = top.select(*by, *keys, "rank", F.transform("months", lambda x: F.struct(
        (x["m"] - F.col("first")).alias("m"), x["n"].alias("n"))).alias("months"))
    points = series.select(*by, F.explode("months").alias("x")).select(*by, "x.m", "x.n")
    stats = points.groupBy(*by).agg(F.percentile("n", F.lit(0.99)).alias("p99"), F.max("m").alias("max_index"))
    counts = F.map_from_entries(F.transform("months", lambda x: F.struct(x["m"], x["n"])))
    dense = _one_row_join(series, stats, by).withColumn("counts", counts).select(
        *by, *keys, "rank", "p99", "counts", F.explode(F.sequence(F.lit(0), F.col("max_index"))).alias("month_index")).withColumn(
        "play_count", F.coalesce(F.try_element_at("counts", "month_index"), F.lit(0).cast("long")))
    # same double operations as the reference: multiplier = 40 / p99, height =
    # round-half-even(count * multiplier) capped at 40, label = int(40 / multiplier)
    mult = F.lit(float(BAR_HEIGHT)) / F.col("p99")
    height = F.least(F.rint(F.col("play_count") * mult), F.lit(float(BAR_HEIGHT)))
    return dense.select(
        *by, *keys, "month_index", "play_count", height.cast("int").alias("bar_height"),
        F.floor(F.lit(float(BAR_HEIGHT)) / mult).cast("long").alias("p99_plays"), "rank",
    )


# ---------------------------------------------------------------------------
# Top songs of top artists


def top_songs_of_top_artists(plays: DataFrame, k: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """Top k artists by full plays, each with its 3 most played tracks as
    ``name (n plays)`` (tracks with zero full plays count; missing → null)."""
    by = list(by)
    # one aggregate per (artist, track), missing track names included, gives the artists' totals and their songs
    tracks = (
        _non_null(plays, ["artist_name"]).groupBy(*by, "artist_name", "track_name")
        .agg(C.full_plays(plays).alias("play_count"))
    )
    n = F.col("play_count").cast("string")
    song = F.struct((-F.col("play_count")).alias("n"), F.concat_ws(X.COMPOSITE_SEP, "track_name", "artist_name").alias("s"),
                    F.concat(F.col("track_name"), F.lit(" ("), n, F.lit(" plays)")).alias("label"))
    named = tracks.withColumn("_song", F.when(F.col("track_name").isNotNull(), song))
    best = Window.partitionBy(*by, "artist_name").orderBy(F.asc_nulls_last("_song"))
    ranked = named.withColumn("_place", F.row_number().over(best))
    artists = ranked.groupBy(*by, "artist_name").agg(
        F.sum("play_count").alias("artist_plays"),
        *[F.max(F.when(F.col("_place") == i, F.col("_song.label"))).alias(f"top_{i}_song") for i in (1, 2, 3)])
    top = top_k(artists, [F.desc("artist_plays"), F.asc("artist_name")], k, by, "rank")
    label = F.concat(F.col("artist_name"), F.lit(" ("), F.col("artist_plays").cast("string"), F.lit(" plays)"))
    return top.select(*by, label.alias("artist"), "top_1_song", "top_2_song", "top_3_song", "rank").orderBy(*by, "rank")


# ---------------------------------------------------------------------------
# Per-period tables


def most_played_monthly(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per month the artist / track / album with most plays (all rows), newest first.

    Every play becomes three keys in one scan; they are counted in one
    aggregate, the winner per month and kind is a ``min_by`` aggregate over
    the counts, and the three winners are folded into one row per month. A key
    with a missing name is counted, so that its month is there, and never wins.
    """
    by = list(by)
    kinds = ("artist", "track", "album")
    measure = [C.N] if C.is_cuboid(plays) else []
    keyed = plays.select(*by, "year_month", *measure, F.explode(F.array(*[
        F.struct(F.lit(e).alias("kind"), F.when(F.col("artist_name").isNotNull(), F.col(_keys(e)[0])).alias("name"),
                 F.col("artist_name").alias("artist")) for e in kinds])).alias("x")).select(*by, "year_month", *measure, "x.*")
    counts = keyed.groupBy(*by, "year_month", "kind", "name", "artist").agg(F.sum(C.N).alias("n") if measure else F.count("*").alias("n"))
    counts = counts.withColumn("_missing", F.col("name").isNull().cast("int")).withColumn(
        "_sort", F.when(F.col("kind") == "artist", F.col("name"))
        .otherwise(F.concat_ws(X.COMPOSITE_SEP, "name", "artist")))
    best = first_row(counts, [*by, "year_month", "kind"], [("_missing", False), ("n", True), ("_sort", False)])
    n = F.col("n").cast("string")
    label = (F.when(F.col("kind") == "artist", F.concat(F.col("name"), F.lit(" ("), n, F.lit(" times)")))
             .otherwise(F.concat(F.col("name"), F.lit(" (by "), F.col("artist"), F.lit(", "), n, F.lit(" times)"))))
    winners = best.groupBy(*by, "year_month").agg(
        *[F.max(F.when(F.col("kind") == e, label)).alias(f"most_played_{e}") for e in kinds])
    return winners.orderBy(*by, F.desc("year_month"))


def avg_track_length_monthly(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean minutes of full plays per month."""
    by = list(by)
    return (
        C.with_full_plays(plays).groupBy(*by, "year_month")
        .agg((C.full_ms(plays) / (C.full_plays(plays) * X.MS_PER_MINUTE)).alias("minutes_played"))
    )


def avg_play_count_per_song_yearly(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean full plays per distinct track, per year (two-level aggregate)."""
    by = list(by)
    per_track = (
        _non_null(C.with_full_plays(plays), ["track_name", "artist_name"])
        .groupBy(*by, "year", "track_name", "artist_name").agg(C.full_plays(plays).alias("n"))
    )
    return per_track.groupBy(*by, "year").agg((F.sum("n") / F.count("*")).alias("avg_play_count"))


def play_count_distribution(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many tracks have each full-play count, count descending."""
    by = list(by)
    per_track = (
        _non_null(C.with_full_plays(plays), ["track_name", "artist_name"])
        .groupBy(*by, "track_name", "artist_name").agg(C.full_plays(plays).alias("play_count"))
    )
    return (per_track.groupBy(*by, "play_count").agg(F.count("*").alias("num_songs"))
            .orderBy(*by, F.desc("play_count")))


def yearly_track_play_count(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Full plays per year, distinct tracks, and tracks first played that year."""
    by = list(by)
    fp = C.with_full_plays(plays)
    totals = fp.groupBy(*by, "year").agg(C.full_plays(plays).alias("total"))
    per_track_year = (
        _non_null(fp, ["track_name", "artist_name"])
        .groupBy(*by, "year", "track_name", "artist_name").agg(C.full_plays(plays).alias("n"))
    )
    unique = per_track_year.groupBy(*by, "year").agg(F.count("*").alias("unique_per_year"))
    new = (
        per_track_year.groupBy(*by, "track_name", "artist_name").agg(F.min("year").alias("year"))
        .groupBy(*by, "year").agg(F.count("*").alias("new"))
    )
    out = totals.join(unique, [*by, "year"], "left").join(new, [*by, "year"], "left")
    return out.select(*by, "year", "total", F.coalesce("unique_per_year", F.lit(0).cast("long")).alias("unique_per_year"),
                      F.coalesce("new", F.lit(0).cast("long")).alias("new"))


def hour_of_day_share(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of play time per hour of day, percent with 2 digits (half-even).

    The total is a window over the ≤ 24 aggregated rows of each group.
    """
    by = list(by)
    per_hour = plays.groupBy(*by, "hour").agg(C.ms(plays).alias("sum_ms"))
    total = F.sum("sum_ms").over(Window.partitionBy(*by))
    return per_hour.select(
        *by, "hour", X.percent("sum_ms", total, 2).alias("percent_of_play_time"))


def plays_per_country(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Full plays per connection country, descending."""
    by = list(by)
    return (
        C.with_full_plays(plays).filter(F.col("conn_country").isNotNull())
        .groupBy(*by, F.col("conn_country").alias("country")).agg(C.full_plays(plays).alias("play_count"))
        .orderBy(*by, F.desc("play_count"), "country")
    )


# ---------------------------------------------------------------------------
# Average hours per calendar period over calendar denominators


def day_bounds(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last logged day per group (one partial+final aggregate)."""
    return plays.groupBy(*by).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def _month_spine(bounds: DataFrame, by: Sequence[str], *keep: str) -> DataFrame:
    """Every month between first and last day with the number of its days in range, and the columns ``keep``."""
    m = F.explode(F.sequence(F.trunc("first_day", "month"), F.trunc("last_day", "month"),
                             F.expr("INTERVAL 1 MONTH")))
    spine = bounds.select(*by, *keep, "first_day", "last_day", m.alias("month_start"))
    days = F.datediff(F.least(F.col("last_day"), F.last_day("month_start")),
                      F.greatest(F.col("first_day"), F.col("month_start"))) + 1
    return spine.withColumn("days", days.cast("long"))


def _avg(sum_ms: Column, days: Column) -> Column:
    """hours / days as one division of exact integers (null when no plays)."""
    return sum_ms / (days * X.MS_PER_HOUR)


def _period_hours(plays: DataFrame, period: Column, by: Sequence[str]) -> DataFrame:
    """Per group the first and last day and Σ ms of every period, ``hours``: one aggregate of the plays, folded to a row.

    The list has at most the history's periods.
    """
    by = list(by)
    periods = plays.groupBy(*by, period.alias("period")).agg(
        C.ms(plays).alias("sum_ms"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return periods.groupBy(*by).agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
                                    F.collect_list(F.struct("period", "sum_ms")).alias("hours"))


def _hours_of(period: Column, by: Sequence[str]) -> Column:
    """Σ ms of one period in ``hours``; null without plays, and for a group without a key, as a join would give."""
    known = F.lit(True)
    for b in by:
        known = known & F.col(b).isNotNull()
    found = F.filter("hours", lambda h: h["period"] == period)
    return F.when(known, F.try_element_at(found, F.lit(1))["sum_ms"])


def avg_hours_per_year_month(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Σ hours per month / days of the month inside [first, last] day; months
    without plays appear with a null average."""
    by = list(by)
    folded = _period_hours(plays, F.col("year_month"), by)
    spine = _month_spine(folded, by, "hours").withColumn("year_month", F.date_format("month_start", "yyyy-MM"))
    return spine.select(*by, "year_month", _avg(_hours_of(F.col("year_month"), by), F.col("days")).alias("avg_hours_played_per_day"))


def avg_hours_per_year(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Σ hours per year / 365, except the first year (first day → Dec 31) and
    the last year (Jan 1 → last day; wins when both are the same year)."""
    by = list(by)
    folded = _period_hours(plays, F.col("year"), by)
    out = _non_null(folded, by).select(*by, "first_day", "last_day", F.explode("hours").alias("h")).select(
        *by, "first_day", "last_day", F.col("h.period").alias("year"), "h.sum_ms")
    first_year_days = F.datediff(F.make_date(F.year("first_day"), F.lit(12), F.lit(31)), F.col("first_day")) + 1
    last_year_days = F.datediff(F.col("last_day"), F.make_date(F.year("last_day"), F.lit(1), F.lit(1))) + 1
    days = (F.when(F.col("year") == F.year("last_day"), last_year_days)
            .when(F.col("year") == F.year("first_day"), first_year_days).otherwise(F.lit(365)))
    return out.select(*by, "year", _avg(F.col("sum_ms"), days.cast("long")).alias("avg_hours_played_per_day"))


def avg_hours_per_month_of_year(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Σ hours per month name / number of days with that month in range; Jan..Dec."""
    by = list(by)
    folded = _period_hours(plays, F.col("month"), by)
    month = F.month("month_start")
    spine = (
        _month_spine(folded, by, "hours").select(*by, month.alias("month"), "days", _hours_of(month, by).alias("sum_ms"))
        .groupBy(*by, "month").agg(F.sum("days").alias("days"), F.max("sum_ms").alias("sum_ms"))
    )
    names = F.element_at(F.array(*[F.lit(m) for m in X.MONTH_NAMES]), F.col("month"))
    return spine.orderBy(*by, "month").select(
        *by, names.alias("month"), _avg(F.col("sum_ms"), F.col("days")).alias("avg_hours_played_per_day"))


def avg_hours_per_weekday(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Σ hours per weekday / number of such weekdays in range; Monday..Sunday.

    The count of weekday w in a range of n days starting on weekday s is
    n div 7 plus one when (w − s) mod 7 < n mod 7 — no day spine needed.
    """
    by = list(by)
    b = _period_hours(plays, F.weekday("day"), by)
    n = F.datediff("last_day", "first_day") + 1
    s = F.weekday("first_day")  # 0 = Monday
    wk = b.select(*by, "hours", n.alias("n"), s.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    days = (F.floor(F.col("n") / 7) + F.when(F.pmod(F.col("weekday") - F.col("s"), F.lit(7)) < F.col("n") % 7, 1)
            .otherwise(0)).cast("long")
    out = wk.select(*by, "weekday", days.alias("days"), _hours_of(F.col("weekday"), by).alias("sum_ms")).filter(F.col("days") > 0)
    names = F.element_at(F.array(*[F.lit(d) for d in X.WEEKDAYS]), F.col("weekday") + 1)
    return out.orderBy(*by, "weekday").select(
        *by, names.alias("day_name"), _avg(F.col("sum_ms"), F.col("days")).alias("avg_hours_played_per_day"))


# ---------------------------------------------------------------------------
# Cumulative share of full plays by entity rank


def play_count_histogram(plays: DataFrame, entity: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group and full-play count: how many entities have it, with the running
    totals in descending count order (windows over the small histogram only).

    ``total_plays`` counts every full play, those without a name included, as
    the reference divides by all full plays; ``keyed_plays`` only those with one.
    """
    by = list(by)
    keys = _keys(entity)
    per_entity = C.with_full_plays(plays).groupBy(*by, *keys).agg(C.full_plays(plays).alias("plays"))
    keyed = F.lit(True)
    for key in keys:
        keyed = keyed & F.col(key).isNotNull()
    hist = per_entity.groupBy(*by, "plays").agg(
        F.count_if(keyed).alias("entities"), F.sum("plays").alias("all_plays"))
    w = Window.partitionBy(*by).orderBy(F.desc("plays")).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(*by)
    mass = F.col("plays") * F.col("entities")
    return hist.select(
        *by, "plays", "entities",
        (F.sum("entities").over(w) - F.col("entities") + 1).alias("first_rank"),
        F.sum("entities").over(w).alias("last_rank"),
        (F.sum(mass).over(w) - mass).alias("plays_before"),
        F.sum("all_plays").over(tot).alias("total_plays"),
        F.sum(mass).over(tot).alias("keyed_plays"),
        F.sum("entities").over(tot).alias("unique"),
    ).filter(F.col("entities") > 0)


def cumulative_play_share(plays: DataFrame, entity: str, by: Sequence[str] = ()) -> DataFrame:
    """Entities by full plays descending; rank n → % of all full plays
    covered by the top n; a leading (0, 0) row.

    Ranks inside one histogram bucket are consecutive and add the same count,
    so each bucket expands to its ranks arithmetically. A large bucket is first
    split into chunks of ``RANK_CHUNK`` ranks which are redistributed before
    being expanded, so no single task generates an unbounded run of rows.
    """
    by = list(by)
    hist = play_count_histogram(plays, entity, by)
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("entities") - 1) / RANK_CHUNK).cast("long")))
    chunks = hist.select(*by, "plays", "first_rank", "last_rank", "plays_before", "total_plays",
                         chunk.alias("chunk"))
    lo = F.col("first_rank") + F.col("chunk") * RANK_CHUNK
    hi = F.least(F.col("last_rank"), lo + RANK_CHUNK - 1)
    ranks = (
        chunks.repartition(*[F.col(b) for b in by], "plays", "chunk")
        .select(*by, "plays", "first_rank", "plays_before", "total_plays",
                F.explode(F.sequence(lo, hi)).alias("rank"))
    )
    covered = F.col("plays_before") + (F.col("rank") - F.col("first_rank") + 1) * F.col("plays")
    share = ranks.select(*by, F.col("rank").alias(f"number_of_{entity}s"),
                         (covered * 100 / F.col("total_plays")).alias("percent_of_played_songs"))
    zero_groups = plays.select(*by).distinct() if by else plays.sparkSession.range(1).select()
    zero = zero_groups.select(*by, F.lit(0).cast("long").alias(f"number_of_{entity}s"),
                              F.lit(0.0).alias("percent_of_played_songs"))
    return zero.unionByName(share)


def share_at_rank(plays: DataFrame, entity: str, ranks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """R18 looked up at rank min(N, unique − 1) for each N (as the KPIs do),
    rounded to a whole percent; one row per group, columns ``top_<N>``, plus
    ``unique`` (entities with a full play) and ``keyed`` (their full plays)."""
    by = list(by)
    hist = play_count_histogram(plays, entity, by)
    cols = []
    for n in ranks:
        r = F.least(F.lit(n).cast("long"), F.col("unique") - 1)
        inside = (F.col("first_rank") <= r) & (r <= F.col("last_rank"))
        cum = F.col("plays_before") + (r - F.col("first_rank") + 1) * F.col("plays")
        cols.append(F.max(F.when(inside, cum)).alias(f"_cum{n}"))
    picked = hist.groupBy(*by).agg(*cols, F.max("total_plays").alias("total"), F.max("keyed_plays").alias("keyed"),
                                   F.max("unique").alias("unique"))
    return picked.select(*by, *[
        X.percent(F.coalesce(f"_cum{n}", F.lit(0)), "total").alias(f"top_{n}")
        for n in ranks
    ], "unique", "keyed")


# ---------------------------------------------------------------------------
# R20–R22


def sample_key(columns: Sequence[str], seed: int) -> Column:
    """A row's place in the sample's order: MD5 of the seed and its columns as text. Nulls are told from empty text."""
    text = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *text))


def sampled_rows(plays: DataFrame, n: int = 1, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows that come first by :func:`sample_key` (per ``by`` group), with their place ``sample`` from 1.

    The key depends on the row alone, so the rows are the same for any partitioning and on every run, and the sample of
    a union is taken from the samples of its parts. Rows that repeat have one key and are drawn as often as they are
    there. A distributed top-n: only ``n`` rows of each task move.
    """
    columns = plays.columns
    keyed = plays.withColumn("_key", sample_key(columns, seed))
    return top_k(keyed, [F.asc("_key")], n, by, "sample").select(*columns, "sample")


def random_sample(plays: DataFrame, n: int = 1, seed: int | None = None) -> DataFrame:
    """N random rows, transposed to (column, sample 1..n) as text; without a seed a new sample on every call."""
    cols = plays.columns
    picked = sampled_rows(plays, n, secrets.randbits(63) if seed is None else seed)
    text = picked.select("sample", *[F.col(c).cast("string").alias(c) for c in cols])
    long = text.unpivot("sample", cols, "column", "value")
    pos = F.element_at(F.map_from_arrays(F.array(*[F.lit(c) for c in cols]),
                                         F.array(*[F.lit(i) for i in range(len(cols))])), F.col("column"))
    wide = (long.groupBy("column").pivot("sample", list(range(1, n + 1))).agg(F.first("value"))
            .withColumn("_pos", pos).orderBy("_pos").drop("_pos"))
    return wide.toDF("column", *[f"sample_{i}" for i in range(1, n + 1)])


def filter_history(
    plays: DataFrame, start: tuple[int, int], end: tuple[int, int], artist_name: str | None = None
) -> DataFrame:
    """Months start..end inclusive (year, month), optionally one artist."""
    seq = F.col("year") * 12 + F.col("month")
    out = plays.filter(seq.between(start[0] * 12 + start[1], end[0] * 12 + end[1]))
    if artist_name:
        out = out.filter(F.col("artist_name") == artist_name)
    return out


def has_full_plays(plays: DataFrame) -> bool:
    """R21's guard: is there any full play left? (reads at most one row)."""
    return len(plays.filter(F.col("full_play")).limit(1).take(1)) > 0


def month_spine(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every (year, month) from the first to the last month with plays."""
    by = list(by)
    seq = F.col("year") * 12 + F.col("month") - 1
    bounds = plays.groupBy(*by).agg(F.min(seq).alias("lo"), F.max(seq).alias("hi"))
    s = bounds.select(*by, F.explode(F.sequence("lo", "hi")).alias("s"))
    return s.select(*by, (F.floor(F.col("s") / 12)).cast("int").alias("year"),
                    (F.col("s") % 12 + 1).cast("int").alias("month"),
                    F.format_string("%04d-%02d", F.floor(F.col("s") / 12).cast("int"),
                                    (F.col("s") % 12 + 1).cast("int")).alias("year_month"))
