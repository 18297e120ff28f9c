"""Q1–Q19: the ad-hoc recipes over the wide fact (E14 shape).

Every recipe is a lazy DataFrame → DataFrame function. ``by`` adds grouping
keys (e.g. ``["listener_id"]``) so the same recipe runs for every listener in
one distributed pass; top-k then becomes a per-group limit.

Conventions that make results deterministic (SURVEY §7.3):
* hours are summed as integer ms and divided once; rounding is exact half-even;
* ties in every top-k are broken by the grouping key ascending;
* ``first`` is the first non-null value in time order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.functions import exprs as X
from encore.operators.common import first_row, full_plays, grouped_firsts, skips, sum_ms, top_k


def _ts_lit(value: str | dt.datetime) -> F.Column:
    return F.lit(value).cast("timestamp_ntz")


def _minus_days(as_of: str | dt.datetime, days: int) -> F.Column:
    return _ts_lit(as_of) - F.make_interval(days=F.lit(days))


def top_artists_by_hours(wide: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Q1: per artist hours (2 digits), full plays, skips; top k by hours."""
    by = list(by)
    agg = (
        wide.filter(F.col("artist_name").isNotNull())
        .groupBy(*by, "artist_name")
        .agg(sum_ms(), full_plays().alias("full_play_count"), skips().alias("skip_count"))
        .select(*by, "artist_name", X.hours_rounded("sum_ms").alias("hours_played"),
                "full_play_count", "skip_count")
    )
    return top_k(agg, [F.desc("hours_played"), F.asc("artist_name")], k, by)


def top_tracks_of_artist(wide: DataFrame, artist_name: str, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Q2: one artist's tracks by hours; names are the first seen per track id."""
    by = list(by)
    agg = grouped_firsts(
        wide.filter(F.col("artist_name") == artist_name), [*by, "track_id"], ["track_name", "album_name"],
        {"sum_ms": sum_ms(), "full_play_count": full_plays(), "skip_count": skips()},
    ).withColumn("hours_played", X.hours_rounded("sum_ms"))
    out = top_k(agg, [F.desc("hours_played"), F.asc("track_id")], k, by)
    return out.select(*by, "track_name", "album_name", "hours_played", "full_play_count", "skip_count")


FIRST_PLAY_COLUMNS = [
    "ts", "track_name", "artist_name", "reason_start", "ms_played", "track_duration_ms", "reason_end",
    "platform", "conn_country", "website",
]


def first_plays(wide: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Q3: the n earliest plays (ties: track id, then every shown column)."""
    by = list(by)
    order = [F.asc("ts"), F.asc("track_id")] + [F.asc_nulls_first(c) for c in FIRST_PLAY_COLUMNS[1:]]
    return top_k(wide.select(*by, "track_id", *FIRST_PLAY_COLUMNS), order, n, by).select(*by, *FIRST_PLAY_COLUMNS)


def hours_by_gender(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Q4: hours and full plays per gender; the null gender is its own group."""
    by = list(by)
    agg = (
        wide.groupBy(*by, "gender")
        .agg(sum_ms(), full_plays().alias("full_play"))
        .select(*by, "gender", X.hours_rounded("sum_ms").alias("hours_played"), "full_play")
    )
    return top_k(agg, [F.desc("full_play"), F.asc_nulls_first("gender")], None, by)


def top_track_per_female_artist(
    wide: DataFrame, as_of: str | dt.datetime, k: int = 20, days: int = 1095, gender: str = "female",
    by: Sequence[str] = (),
) -> DataFrame:
    """Q5: per artist of the gender, their best track by hours in the last ``days``; top k."""
    by = list(by)
    tracks = grouped_firsts(
        wide.filter((F.col("gender") == gender) & (F.col("ts") >= _minus_days(as_of, days))), [*by, "track_id"],
        ["track_name", "artist_name", "album_name", "album_release_year", "country", "gender"],
        {"sum_ms": sum_ms(), "full_play": full_plays()},
    ).withColumn("hours_played", X.hours_rounded("sum_ms")).filter(F.col("artist_name").isNotNull())
    best = first_row(tracks, [*by, "artist_name"], [("hours_played", True), ("track_id", False)])
    out = top_k(best, [F.desc("hours_played"), F.asc("artist_name")], k, by)
    return out.select(*by, "artist_name", "track_name", "album_name", "album_release_year", "country", "gender",
                      "hours_played", "full_play", "track_id")


def artists_without_kg_by_hours(wide: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Q6: artists with no knowledge-graph id, by (unrounded) hours."""
    by = list(by)
    agg = grouped_firsts(
        wide.filter(F.col("wikidata_entity_id").isNull() & F.col("artist_id").isNotNull()), [*by, "artist_id"],
        ["artist_name", "artist_popularity", "wikidata_entity_id"], {"sum_ms": sum_ms()},
    ).withColumn("hours_played", X.hours(F.col("sum_ms")))
    out = top_k(agg, [F.desc("sum_ms"), F.asc("artist_id")], k, by)
    return out.select(*by, "artist_id", "artist_name", "hours_played", "artist_popularity", "wikidata_entity_id")


def artists_without_kg_by_popularity(wide: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Q7: artists with no knowledge-graph id, by popularity."""
    by = list(by)
    agg = grouped_firsts(
        wide.filter(F.col("wikidata_entity_id").isNull() & F.col("artist_id").isNotNull()), [*by, "artist_id"],
        ["artist_name", "artist_popularity", "wikidata_entity_id"], {})
    return top_k(agg, [F.desc_nulls_last("artist_popularity"), F.asc("artist_id")], k, by)


def top_countries(wide: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Q8: artist countries (nulls dropped) by full plays."""
    by = list(by)
    agg = (
        wide.filter(F.col("country").isNotNull())
        .groupBy(*by, "country")
        .agg(sum_ms(), full_plays().alias("full_play"))
        .select(*by, "country", X.hours_rounded("sum_ms").alias("hours_played"), "full_play")
    )
    return top_k(agg, [F.desc("full_play"), F.asc("country")], k, by)


def top_solo_tracks_by_release_era(
    wide: DataFrame, start_year: int = 1950, end_year: int = 1970, k: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Q9: tracks of solo artists released in [start_year, end_year], by hours."""
    by = list(by)
    agg = grouped_firsts(
        wide.filter((F.col("is_band") == F.lit(False)) & F.col("album_release_year").between(start_year, end_year)),
        [*by, "track_id"], ["track_name", "artist_name", "album_name", "album_release_year", "country"],
        {"sum_ms": sum_ms(), "full_play": full_plays()},
    ).withColumn("hours_played", X.hours_rounded("sum_ms"))
    out = top_k(agg, [F.desc("hours_played"), F.asc("track_id")], k, by)
    return out.select(*by, "track_name", "artist_name", "album_name", "album_release_year", "country",
                      "hours_played", "full_play")


def top_genres(wide: DataFrame, k: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Q10: hours per genre (whole hours, half-even); ``''`` is a bucket.

    Pre-aggregates ms per genre *string* first (map-side combine on a low-
    cardinality key), so only the distinct genre strings are exploded.
    """
    by = list(by)
    per_string = (
        wide.filter(F.col("artist_genres").isNotNull())
        .groupBy(*by, "artist_genres").agg(sum_ms())
    )
    agg = (
        per_string.withColumn("genres", F.explode(F.split(F.col("artist_genres"), ";")))
        .groupBy(*by, "genres").agg(F.sum("sum_ms").alias("sum_ms"))
        .select(*by, "genres", X.round_int_ratio("sum_ms", X.MS_PER_HOUR).alias("hours_played"))
    )
    return top_k(agg, [F.desc("hours_played"), F.asc("genres")], k, by)


def top_tracks_in_genre(wide: DataFrame, genre: str = "classical", k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Q11: tracks whose artist genres contain ``genre`` (case-insensitive), by full plays."""
    by = list(by)
    match = F.coalesce(F.lower(F.col("artist_genres")).contains(genre.lower()), F.lit(False))
    agg = grouped_firsts(
        wide.filter(match), [*by, "track_id"], ["track_name", "artist_name"],
        {"sum_ms": sum_ms(), "full_play": full_plays()},
    ).withColumn("hours_played", X.hours_rounded("sum_ms"))
    out = top_k(agg, [F.desc("full_play"), F.asc("track_id")], k, by)
    return out.select(*by, "track_name", "artist_name", "hours_played", "full_play")


# Genre patterns of the share report (case-insensitive regexes).
GENRE_PATTERNS = {"rock": "rock", "hiphop": "hip.?hop", "pop": "pop"}


def genre_share_by_year(
    wide: DataFrame, since: str | dt.datetime | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Per year, full plays matching rock / hip-hop / pop and their shares."""
    by = list(by)
    fp = wide.filter(F.col("full_play"))
    if since is not None:
        fp = fp.filter(F.col("ts") >= _ts_lit(since))
    g = F.col("artist_genres")
    counts = [F.count_if(F.coalesce(g.rlike(f"(?i){p}"), F.lit(False))).alias(f"{name}_full_play")
              for name, p in GENRE_PATTERNS.items()]
    agg = fp.groupBy(*by, F.year("ts").alias("year")).agg(*counts, F.count("*").alias("total_full_play"))
    shares = {f"{name}_percent": X.percent(f"{name}_full_play", "total_full_play", 2)
              for name in GENRE_PATTERNS}
    return agg.withColumns(shares).orderBy(*by, "year")


def top_bands_and_solo(wide: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Q13: top k solo artists then top k bands by hours (unknown ``is_band`` excluded)."""
    by = list(by)
    agg = (
        wide.filter(F.col("is_band").isNotNull())
        .groupBy(*by, "is_band", "artist_name")
        .agg(sum_ms(), full_plays().alias("full_play_count"))
        .filter(F.col("artist_name").isNotNull())
        .withColumn("hours_played", X.hours_rounded("sum_ms"))
    )
    out = top_k(agg, [F.desc("hours_played"), F.asc("artist_name")], k, [*by, "is_band"], "rank")
    return out.select(*by, "artist_name", "hours_played", "full_play_count", "is_band", "rank").orderBy(*by, "is_band", "rank")


def top_artist_per_top_country(wide: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Q14: the k countries with most (whole) hours, each with its top artist.

    One aggregate per (country, artist), missing artists included, rolls up to the country's total (exact integer ms)
    and its best artist, so the fact is scanned once.
    """
    by = list(by)
    per_artist = (
        wide.filter(F.col("country").isNotNull())
        .groupBy(*by, "country", "artist_name")
        .agg(sum_ms(), full_plays().alias("full_play_count_artist"))
        .withColumn("hours_played_artist", X.round_int_ratio("sum_ms", X.MS_PER_HOUR))
    )
    named = F.col("artist_name").isNotNull()
    best = F.min_by(F.struct("artist_name", "hours_played_artist", "full_play_count_artist"),
                    F.when(named, F.struct((-F.col("hours_played_artist")).alias("h"), F.col("artist_name").alias("a"))))
    countries = per_artist.groupBy(*by, "country").agg(F.sum("sum_ms").alias("total_ms"), best.alias("best")).withColumn(
        "total_hours", X.round_int_ratio("total_ms", X.MS_PER_HOUR))
    top = top_k(countries, [F.desc("total_hours"), F.asc("country")], k, by, "rank").filter(F.col("best.artist_name").isNotNull())
    return top.select(*by, "country", "total_hours", "best.artist_name", "best.hours_played_artist",
                      "best.full_play_count_artist", "rank").orderBy(*by, "rank")


def discovered_in_year(wide: DataFrame, year: int, k: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Q15: tracks first played in ``year`` (over all time), with all their plays; top k by full plays."""
    by = list(by)
    agg = (
        grouped_firsts(wide, [*by, "track_id"], ["track_name", "artist_name", "album_name", "album_release_year"],
                       {"full_play": full_plays(), "sum_ms": sum_ms()}, mins={"first_play": F.col("ts")})
        .filter(F.year("first_play") == year)
        .withColumn("hours_played", X.hours_rounded("sum_ms"))
    )
    out = top_k(agg, [F.desc("full_play"), F.asc("track_id")], k, by)
    return out.select(*by, "track_name", "artist_name", "album_name", "album_release_year", "full_play",
                      "hours_played", "first_play")


def never_finished(wide: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Q16: tracks never fully played, by attempts then hours."""
    by = list(by)
    agg = (
        grouped_firsts(wide, [*by, "track_id"], ["track_name", "artist_name", "album_name"],
                       {"sum_ms": sum_ms(), "partial_play_count": F.count("ms_played")},
                       maxs={"any_full": F.col("full_play")})
        .filter(~F.col("any_full"))
        .withColumn("hours_played", X.hours_rounded("sum_ms"))
    )
    out = top_k(agg, [F.desc("partial_play_count"), F.desc("hours_played"), F.asc("track_id")], k, by)
    return out.select(*by, "track_name", "artist_name", "album_name", "hours_played", "partial_play_count")


def least_played_of_top_albums(wide: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Q17: for the k albums with most hours, the track with fewest full plays.

    One pass over the fact: per-track stats, from which album totals (exact,
    integer ms) and the per-album mean of full plays are derived.
    """
    by = list(by)
    keys = [*by, "artist_name", "album_name"]
    tracks = (
        wide.filter(F.col("artist_name").isNotNull() & F.col("album_name").isNotNull()
                    & F.col("track_name").isNotNull())
        .groupBy(*keys, "track_name")
        .agg(sum_ms(), full_plays().alias("full_play"))
    )
    least = F.min_by(F.struct("track_name", "sum_ms", "full_play"), F.struct("full_play", "track_name"))
    albums = (
        tracks.groupBy(*keys)
        .agg(F.sum("sum_ms").alias("album_ms"), F.sum("full_play").alias("album_fp"),
             F.count("*").alias("n_tracks"), least.alias("least"))
        .select(*keys, X.hours_rounded("album_ms", 1).alias("total_album_hours"),
                X.round_ratio("album_fp", "n_tracks", 1).alias("avg_full_play"), "least.*")
    )
    top = top_k(albums, [F.desc("total_album_hours"), F.asc("artist_name"), F.asc("album_name")], k, by, "rank")
    return top.select(*keys, "total_album_hours", "track_name", X.hours_rounded("sum_ms", 1).alias("hours_played"),
                      "full_play", "avg_full_play", "rank").orderBy(*by, "rank")


def one_hit_wonders(
    wide: DataFrame, min_top_plays: int = 20, max_other_plays: int = 10, k: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Q18: artists with one much-played track and few plays of the rest.

    ``top_track`` is the alphabetically first track name: the reference takes
    ``first`` after a key-sorted group-by (trap T7), reproduced as is.
    """
    by = list(by)
    tracks = (
        wide.filter(F.col("artist_name").isNotNull() & F.col("track_name").isNotNull())
        .groupBy(*by, "artist_name", "track_name")
        .agg(full_plays().alias("full_play"), sum_ms())
        # per-track hours rounded to 2 digits, kept as an integer count of 1/100 h
        .withColumn("centi_hours", X.round_int_ratio("sum_ms", X.MS_PER_HOUR // 100))
    )
    artists = (
        tracks.groupBy(*by, "artist_name")
        .agg(F.min("track_name").alias("top_track"),
             F.max("full_play").alias("top_track_plays"),
             F.sum("full_play").alias("total_plays"),
             (F.sum("centi_hours") / 100).alias("hours_played"))
        .withColumn("other_tracks_plays", F.col("total_plays") - F.col("top_track_plays"))
        .filter((F.col("top_track_plays") > min_top_plays) & (F.col("other_tracks_plays") < max_other_plays))
    )
    out = top_k(artists, [F.desc("top_track_plays"), F.asc("artist_name")], k, by)
    return out.select(*by, "artist_name", "top_track", "top_track_plays", "hours_played", "other_tracks_plays")


def not_played_since(
    wide: DataFrame, as_of: str | dt.datetime, days: int = 1095, k: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Q19: tracks whose last play is before ``as_of - days``, by full plays."""
    by = list(by)
    agg = (
        grouped_firsts(wide, [*by, "track_id"], ["track_name", "artist_name", "album_name"],
                       {"full_play": full_plays(), "sum_ms": sum_ms()}, maxs={"last_play": F.col("ts")})
        .filter(F.col("last_play") < _minus_days(as_of, days))
        .withColumn("hours_played", X.hours_rounded("sum_ms"))
    )
    out = top_k(agg, [F.desc("full_play"), F.asc("track_id")], k, by)
    return out.select(*by, "track_name", "artist_name", "album_name", "last_play", "full_play", "hours_played")
