"""Enrichment from nested entity documents and the star join.

Documents (track / artist / album JSON and knowledge-graph bindings) are
DataFrames with nested structs and arrays; flattening is pure column
expressions (``transform``, ``array_join``, ``posexplode``, ``max_by``), so
every step is a distributed projection or aggregate keyed by entity id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Knowledge-graph property labels (lower-cased) and the
# "instance of" labels that decide solo artist vs band.
PROP_INSTANCE_OF = "instance of"
PROP_GENDER = "sex or gender"
PROP_COUNTRY = ["country of citizenship", "country of origin"]
PROP_BIRTH_DATE = "date of birth"
PROP_WEBSITE = "official website"
PROP_GENRE = "genre"
SOLO_LABELS = ["human", "solo musical project"]
BAND_LABELS = [
    "musical group", "musical duo", "rock band", "orchestra", "symphony orchestra", "sibling duo",
    "musical trio", "girl group", "musical ensemble", "rap group",
]
# release date that stands for "unknown" and the year it maps to
UNKNOWN_RELEASE_DATE = "1900-01-01"
# ---------------------------------------------------------------------------


def _ids_joined(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda x: x["id"]), ";")


def pending_ids(ids: DataFrame, cached: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct ids that have no cached document (anti join, no collect)."""
    return ids.select(id_col).filter(F.col(id_col).isNotNull()).distinct().join(
        cached.select(id_col), id_col, "left_anti")


def batch_ids(ids: DataFrame, size: int, id_col: str = "id", bucket_batches: int = 1000) -> DataFrame:
    """Request batches of ``size`` ids, the same on every run.

    The ids fall into hash buckets of about ``bucket_batches`` batches (their number follows from the count) and are
    numbered inside each, so only the last batch of a bucket is short.
    """
    n = ids.select(id_col).count()
    buckets = max(1, -(-n // (size * bucket_batches)))
    bucketed = ids.select(id_col, F.pmod(F.xxhash64(id_col), F.lit(buckets)).alias("_bucket"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(id_col)) - 1
    keyed = bucketed.withColumn("_chunk", F.floor(place / size))
    return keyed.groupBy("_bucket", "_chunk").agg(F.array_sort(F.collect_list(id_col)).alias("ids")).select(
        F.concat_ws("-", "_bucket", "_chunk").alias("batch"), "ids")


def image_worklist(docs: DataFrame, cached_ids: DataFrame) -> DataFrame:
    """(id, first image url) of entities with a usable first image and no local copy."""
    first_url = F.try_element_at(F.col("images"), F.lit(1))["url"]
    has = (F.size(F.coalesce(F.col("images"), F.array())) > 0) & first_url.isNotNull() & (first_url != "")
    return docs.filter(has).select("id", first_url.alias("url")).join(cached_ids.select("id"), "id", "left_anti")


def flatten_tracks(track_docs: DataFrame) -> DataFrame:
    """Nested track documents → one row per track (primary artist kept for E6)."""
    flat = track_docs.select(
        F.col("id").alias("track_id"),
        F.col("name").alias("track_name"),
        F.col("duration_ms").cast("long").alias("track_duration_ms"),
        F.col("explicit").cast("boolean").alias("track_explicit"),
        F.col("popularity").cast("short").alias("track_popularity"),
        F.col("track_number").cast("short").alias("track_number"),
        F.col("disc_number").cast("short").alias("disc_number"),
        F.col("album.id").alias("album_id"),
        F.try_element_at(F.col("artists"), F.lit(1))["id"].alias("artist_id"),
        _ids_joined(F.col("artists")).alias("artist_ids"),
    )
    return flat.dropDuplicates()


def referenced_ids(track_docs: DataFrame) -> DataFrame:
    """E5: distinct album ids and artist ids (track artists ∪ album artists) as (kind, id)."""
    albums = track_docs.select(F.lit("album").alias("kind"), F.col("album.id").alias("id"))
    a1 = track_docs.select(F.lit("artist").alias("kind"), F.explode("artists.id").alias("id"))
    a2 = track_docs.select(F.lit("artist").alias("kind"), F.explode("album.artists.id").alias("id"))
    return albums.unionByName(a1).unionByName(a2).filter(F.col("id").isNotNull()).distinct()


def attach_primary_artist(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Plays ⟕ tracks(track_id, artist_id); ``artist_id`` placed second."""
    joined = plays.join(tracks.select("track_id", "artist_id"), "track_id", "left")
    rest = [c for c in plays.columns if c not in ("track_id", "artist_id")]
    return joined.select("track_id", "artist_id", *rest)


def kg_facts(kg_docs: DataFrame) -> DataFrame:
    """Knowledge-graph bindings, one row each with its position (order = fold order)."""
    return kg_docs.select(
        "artist_id", F.posexplode(F.col("results.bindings")).alias("pos", "b")
    ).select(
        "artist_id", "pos",
        F.col("b.item.value").alias("item"),
        F.lower(F.col("b.propLabel.value")).alias("prop"),
        F.col("b.valueLabel.value").alias("value"),
    )


def kg_properties(kg_docs: DataFrame) -> DataFrame:
    """E7–E10 (graph side): per artist the folded properties, last binding wins.

    ``max_by(value, pos)`` over the bindings of one property reproduces the
    sequential fold; bindings of other properties carry a null position and
    are ignored. ``is_band`` only moves on known labels (E9).
    """
    f = kg_facts(kg_docs)
    prop, value, pos = F.col("prop"), F.col("value"), F.col("pos")

    def last(cond: Column, v: Column = value) -> Column:
        return F.max_by(v, F.when(cond, pos))

    known = (prop == PROP_INSTANCE_OF) & (value.isin(SOLO_LABELS) | value.isin(BAND_LABELS))
    props = f.groupBy("artist_id").agg(
        last(prop == PROP_GENDER).alias("gender"),
        last(prop.isin(PROP_COUNTRY)).alias("country"),
        last(prop == PROP_BIRTH_DATE).alias("birth_date_text"),
        last(prop == PROP_WEBSITE).alias("website"),
        last(known, value.isin(BAND_LABELS)).alias("is_band"),
        F.collect_set(F.when(prop == PROP_GENRE, value)).alias("kg_genres"),
    )
    # Entity id = last path segment of the first binding's item
    ent = kg_docs.select(
        "artist_id",
        F.element_at(F.split(F.try_element_at(F.col("results.bindings"), F.lit(1))["item"]["value"], "/"), -1)
        .alias("wikidata_entity_id"),
    )
    return ent.join(props, "artist_id", "left")


def merge_genres(api_genres: Column, kg_genres: Column) -> Column:
    """API genres ∪ graph genres, sorted, ``;``-joined; none → ``''``."""
    empty = F.array().cast("array<string>")
    merged = F.array_sort(F.array_union(F.coalesce(api_genres, empty), F.coalesce(kg_genres, empty)))
    return F.array_join(merged, ";")


def flatten_artists(artist_docs: DataFrame, kg_docs: DataFrame | None = None) -> DataFrame:
    """Artist documents ⟕ graph properties → 11 columns, deduplicated and typed."""
    a = artist_docs.select(
        F.col("id").alias("artist_id"), F.col("name").alias("artist_name"),
        F.col("followers.total").alias("artist_followers"), F.col("genres").alias("api_genres"),
        F.col("popularity").alias("artist_popularity"),
    )
    if kg_docs is not None:
        a = a.join(kg_properties(kg_docs), "artist_id", "left")
    else:
        a = a.select("*", *[F.lit(None).cast(t).alias(c) for c, t in [
            ("wikidata_entity_id", "string"), ("gender", "string"), ("country", "string"),
            ("birth_date_text", "string"), ("website", "string"), ("is_band", "boolean"),
            ("kg_genres", "array<string>")]])
    out = a.select(
        "artist_id", "artist_name",
        F.col("artist_followers").cast("int").alias("artist_followers"),
        merge_genres(F.col("api_genres"), F.col("kg_genres")).alias("artist_genres"),
        F.col("artist_popularity").cast("long").alias("artist_popularity"),
        "wikidata_entity_id", F.col("is_band").cast("boolean").alias("is_band"), "gender", "country",
        "birth_date_text", "website",
    ).dropDuplicates()
    birth = F.try_to_timestamp(F.col("birth_date_text")).cast("timestamp_ntz")
    return out.select(
        "artist_id", "artist_name", "artist_followers", "artist_genres", "artist_popularity",
        "wikidata_entity_id", "is_band", "gender", "country", birth.alias("birth_date"), "website",
    )


def release_year(date_text: Column) -> Column:
    """``1900-01-01`` → 0 (unknown); else the first 4 characters as a number; bad → null."""
    return (F.when(date_text == UNKNOWN_RELEASE_DATE, F.lit(0).cast("short"))
            .otherwise(F.substring(date_text, 1, 4).try_cast("short")))


def flatten_albums(album_docs: DataFrame) -> DataFrame:
    """Album documents → 9 columns (artist / track ids ``;``-joined), typed."""
    flat = album_docs.select(
        F.col("id").alias("album_id"), F.col("name").alias("album_name"), "album_type",
        F.col("total_tracks").alias("album_total_tracks"),
        F.col("release_date").alias("album_release_date"),
        F.col("release_date_precision").alias("album_release_date_precision"),
        F.col("label").alias("album_label"), F.col("popularity").alias("album_popularity"),
        _ids_joined(F.col("artists")).alias("album_artist_ids"),
        _ids_joined(F.col("tracks.items")).alias("album_track_ids"),
    ).dropDuplicates()
    return flat.select(
        "album_id", "album_name", "album_type",
        F.col("album_total_tracks").cast("short").alias("album_total_tracks"),
        "album_label", F.col("album_popularity").cast("short").alias("album_popularity"),
        "album_artist_ids", "album_track_ids",
        release_year(F.col("album_release_date")).alias("album_release_year"),
    )


def track_dimension(tracks: DataFrame, albums: DataFrame, artists: DataFrame) -> DataFrame:
    """One row per track with the columns of its album and its primary artist (E6): tracks ⟕ albums ⟕ artists.

    The three tables are joined among themselves, so that the fact meets one join and one key.
    """
    return tracks.join(albums, "album_id", "left").join(artists, "artist_id", "left")


def wide_fact(plays: DataFrame, tracks: DataFrame, albums: DataFrame, artists: DataFrame) -> DataFrame:
    """E6 + E14: plays ⟕ (tracks ⟕ albums ⟕ artists) + hours_played.

    One left equi-join of the fact, on the track: the planner broadcasts the dimension when its runtime size is under
    the broadcast threshold (AQE) and sort-merges otherwise, splitting a very popular track by AQE skew join. A fact
    that is enriched more than once is better stored by track (``sinks.bucketed``): then it is not shuffled at all.
    """
    dimension = track_dimension(tracks, albums, artists)
    # the plays' own copies of what the dimension provides (e.g. names) give way to it
    own = plays.drop(*[c for c in plays.columns if c in dimension.columns and c != "track_id"])
    out = own.join(dimension, "track_id", "left")
    return out.withColumn("hours_played", F.col("ms_played") / 3_600_000)
