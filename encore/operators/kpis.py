"""The 41 scalar indicators of the report, one row per ``by`` group.

Two aggregates of the fact give everything: counters per day (``cuboids.days``)
and full plays per artist, track and album (``cuboids.names``). A distinct count
is then a count of rows, with no Expand copy of the fact. From the names come the
top-3 names of R1/R2, the distinct counts, and the R18 shares looked up at fixed
ranks (from the play-count histogram, no global window over entities); they read
the same shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions import exprs as X
from encore.operators import cuboids as C
from encore.operators import report
from encore.operators.common import top_k

SHARE_RANKS = (10, 100, 500)

# KPI names in the reference's order (fixed values).
KPI_COLUMNS = [
    "first_day", "last_day", "number_of_days", "number_of_days_with_tracks_played",
    "percent_of_days_with_tracks_played", "played_songs", "played_songs_per_day", "unique_tracks_played",
    "unique_artists_played", "unique_albums_played", "unique_tracks_played_per_artist", "listening_hours",
    "listening_hours_per_day", "percent_of_played_songs_using_shuffle", "skipped_songs",
    "percent_of_skipped_songs", "avg_seconds_played_before_skipping", "percent_of_songs_skipped_before_3s",
    "percent_of_songs_skipped_after_30s", "percent_of_songs_skipped_after_120s",
    "percent_of_skipped_songs_using_shuffle", "percent_of_skipped_songs_not_using_shuffle",
    "percent_reason_start_forward_button", "percent_reason_start_back_button",
    "percent_reason_start_trackdone", "percent_reason_start_clickrow",
    "percent_of_played_songs_using_incognito_mode", "average_play_count_per_song",
    "percent_played_songs_reason_start_clickrow",
    "top_10_artist_play_count_percent", "top_100_artist_play_count_percent", "top_500_artist_play_count_percent",
    "top_10_track_play_count_percent", "top_100_track_play_count_percent", "top_500_track_play_count_percent",
    "top_1_artist", "top_1_track", "top_2_artist", "top_2_track", "top_3_artist", "top_3_track",
]


def _join(frames: list[DataFrame], by: Sequence[str]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(by), "left") if by else out.crossJoin(F.broadcast(f))
    return out


def _named(names: DataFrame, entity: str) -> DataFrame:
    """The rows with a full play and the entity's name. One condition over the sum, so that it stays above the aggregate
    of the names and all that read them share its shuffle."""
    has_name = F.lit(True)
    for key in report.ENTITIES[entity]:
        has_name = has_name & F.col(key).isNotNull()
    return names.filter(F.when(has_name, F.col(C.FULL)) > 0)


def _top_names(names: DataFrame, entity: str, by: Sequence[str]) -> DataFrame:
    """Names ranked 1–3 of R1 (artists) / R2 (tracks); ``-`` when missing."""
    by = list(by)
    name = report.ENTITIES[entity][0]
    counts = _named(names, entity).groupBy(*by, *report.ENTITIES[entity]).agg(F.sum(C.FULL).alias("play_count")).filter(
        F.col("play_count") > 0).withColumn("_sort", report.sort_key(entity))
    order = [F.desc("play_count"), F.asc("_sort")]
    top3 = top_k(counts, order, 3, by)
    ranked = top3.withColumn("_rk", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    # without ``by`` this is one row also where no play is left; a listener without one gets ``-`` after the join
    out = ranked.groupBy(*by).agg(*[F.max(F.when(F.col("_rk") == i, F.col(name))).alias(f"top_{i}_{entity}")
                                    for i in (1, 2, 3)])
    return out.select(*by, *[F.coalesce(F.col(f"top_{i}_{entity}"), F.lit("-")).alias(f"top_{i}_{entity}")
                             for i in (1, 2, 3)])


def single_values(plays: DataFrame, by: Sequence[str] = (), with_fixed: bool = False, days: DataFrame | None = None,
                  names: DataFrame | None = None) -> DataFrame:
    """R19 over the website-style fact, or over its cuboids ``days`` and ``names`` where they are at hand.

    ``with_fixed`` appends ``percent_of_skipped_songs_not_using_shuffle_fixed``,
    which divides by the non-shuffle rows (the reference divides by the shuffle
    rows, trap T6, reproduced in the main column).
    """
    by = list(by)
    days = C.days(plays, by) if days is None else days
    names = C.names(plays, by) if names is None else names
    base = days.groupBy(*by).agg(
        F.min("day").alias("_first"), F.max("day").alias("_last"),
        F.count_if(F.col(C.FULL) > 0).alias("number_of_days_with_tracks_played"),
        F.coalesce(F.sum(C.N), F.lit(0).cast("long")).alias("_n"),
        F.coalesce(F.sum(C.FULL), F.lit(0).cast("long")).alias("played_songs"),
        F.sum(C.MS).alias("_ms"),
        *[(F.sum(c) if c == "_skip_ms" else F.coalesce(F.sum(c), F.lit(0).cast("long"))).alias(c) for c in C.kpi_counters()],
    ).withColumnRenamed("_skips", "skipped_songs")
    base = base.withColumns({
        "number_of_days": F.datediff("_last", "_first").cast("long"),
        "_skips_ms": F.col("skipped_songs") * 1000,
    })
    base = base.withColumn("listening_hours", X.round_int_ratio("_ms", X.MS_PER_HOUR))
    per_day = F.col("listening_hours") / F.nullif(F.col("number_of_days"), F.lit(0))
    skips = F.col("skipped_songs")

    def if_skips(c: Column) -> Column:
        return F.when(skips == 0, F.lit(0).cast("long")).otherwise(c)

    def if_shuffle(c: Column) -> Column:
        return F.when(F.col("_shuffle") == 0, F.lit(0).cast("long")).otherwise(c)

    P = X.percent
    fixed = []
    if with_fixed:
        fixed = [F.when(F.col("_no_shuffle") == 0, F.lit(0).cast("long"))
                 .otherwise(P("_skip_no_shuffle", "_no_shuffle"))
                 .alias("percent_of_skipped_songs_not_using_shuffle_fixed")]
    kpi = base.select(
        *fixed,
        *by,
        F.date_format("_first", "yyyy-MM-dd").alias("first_day"),
        F.date_format("_last", "yyyy-MM-dd").alias("last_day"),
        "number_of_days", "number_of_days_with_tracks_played",
        P("number_of_days_with_tracks_played", "number_of_days").alias("percent_of_days_with_tracks_played"),
        "played_songs",
        X.round_int_ratio("played_songs", "number_of_days").alias("played_songs_per_day"),
        "listening_hours",
        F.regexp_replace(X.format_hours(per_day), "h$", "").alias("listening_hours_per_day"),
        P("_fp_shuffle", "played_songs").alias("percent_of_played_songs_using_shuffle"),
        "skipped_songs",
        P("skipped_songs", "_n").alias("percent_of_skipped_songs"),
        if_skips(X.round_int_ratio("_skip_ms", "_skips_ms")).alias("avg_seconds_played_before_skipping"),
        if_skips(P("_skip_3s", "skipped_songs")).alias("percent_of_songs_skipped_before_3s"),
        if_skips(P("_skip_30s", "skipped_songs")).alias("percent_of_songs_skipped_after_30s"),
        if_skips(P("_skip_120s", "skipped_songs")).alias("percent_of_songs_skipped_after_120s"),
        if_shuffle(P("_skip_shuffle", "_shuffle")).alias("percent_of_skipped_songs_using_shuffle"),
        # divides by shuffle rows, as the reference does (trap T6)
        if_shuffle(P("_skip_no_shuffle", "_shuffle")).alias("percent_of_skipped_songs_not_using_shuffle"),
        P("_rs_fwd", "_n").alias("percent_reason_start_forward_button"),
        P("_rs_back", "_n").alias("percent_reason_start_back_button"),
        P("_rs_done", "_n").alias("percent_reason_start_trackdone"),
        P("_rs_click", "_n").alias("percent_reason_start_clickrow"),
        P("_fp_incognito", "played_songs").alias("percent_of_played_songs_using_incognito_mode"),
        P("_fp_click", "played_songs").alias("percent_played_songs_reason_start_clickrow"),
    )
    # The per-entity histograms of the share KPIs also give the distinct track and
    # artist counts and the keyed full-play total, so those need no distinct
    # aggregate (and no Expand copy of every row) of their own.
    shares = []
    for entity in ("artist", "track"):
        s = report.share_at_rank(names, entity, SHARE_RANKS, by)
        shares.append(s.select(*by, *[F.col(f"top_{n}").alias(f"top_{n}_{entity}_play_count_percent")
                                      for n in SHARE_RANKS],
                               F.col("unique").alias(f"_unique_{entity}"), F.col("keyed").alias(f"_total_{entity}")))
    tops = [_top_names(names, "artist", by), _top_names(names, "track", by)]
    albums = _named(names, "album").groupBy(*by, *report.ENTITIES["album"]).agg(
        F.sum(C.FULL)).groupBy(*by).agg(F.count(F.lit(1)).alias("unique_albums_played"))
    out = _join([kpi, *shares, *tops, albums], by)
    # groups without full plays have no histogram rows: their shares and counts are 0
    out = out.fillna(0, subset=[f"top_{n}_{e}_play_count_percent" for e in ("artist", "track") for n in SHARE_RANKS]
                     + ["_unique_artist", "_unique_track", "_total_track", "unique_albums_played"])
    out = out.fillna("-", subset=[f"top_{i}_{e}" for e in ("artist", "track") for i in (1, 2, 3)])
    out = out.withColumnsRenamed({"_unique_track": "unique_tracks_played", "_unique_artist": "unique_artists_played"})
    out = out.withColumns({
        "unique_tracks_played_per_artist": X.round_ratio("unique_tracks_played", "unique_artists_played", 1),
        "average_play_count_per_song": X.round_ratio("_total_track", "unique_tracks_played", 1),
    })
    extra = ["percent_of_skipped_songs_not_using_shuffle_fixed"] if with_fixed else []
    return out.select(*by, *KPI_COLUMNS, *extra)
