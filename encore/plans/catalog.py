"""Registered queries: name → (spark, sf_dir) → DataFrame over the driver tables.

Every entry reads the whole driver tables through the binding of
``sources.tables`` (nothing is sampled, capped or filtered to keep the check
cheap); parameters are the fixture literals shared with the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore import schemas
from encore.checks import ingest_sql as IS
from encore.checks import recipes_sql as P
from encore.checks import report_sql as RS
from encore.functions import exprs as X
from encore.operators import clean, enrich, kpis, recipes, report
from encore.plans import report as report_plan
from encore.sources import derived, tables

Query = Callable[[SparkSession, str], DataFrame]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned wide fact (E14 shape) bound from the driver tables."""
    return clean.wide_fact(tables.with_missing_names(tables.plays_raw_wide(spark, sf_dir)))


def _recipe(fn, **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(wide(spark, sf_dir), **params)

    run.__name__ = fn.__name__
    return run


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Website-style report fact (wide fact + calendar columns)."""
    return clean.report_plays(tables.with_missing_names(tables.plays_raw_wide(spark, sf_dir)))


def _report(fn, **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(plays(spark, sf_dir), **params)

    run.__name__ = fn.__name__
    return run


def report_queries() -> dict[str, Query]:
    R, k = report, RS.REPORT_K
    out = {
        "r01_most_played_artists": _report(R.most_played_artists, k=k),
        "r02_most_played_tracks": _report(R.most_played_tracks, k=k),
        "r03_most_played_albums": _report(R.most_played_albums, k=k),
        "r04_most_played_tracks_clickrow": _report(R.most_played_tracks_clickrow, k=k),
        "r05_monthly_play_series_artists": _report(R.monthly_play_series, entity="artist", k=k),
        "r05_monthly_play_series_tracks": _report(R.monthly_play_series, entity="track", k=k),
        "r05_monthly_play_series_albums": _report(R.monthly_play_series, entity="album", k=k),
        "r06_top_songs_of_top_artists": _report(R.top_songs_of_top_artists, k=k),
        "r07_most_played_monthly": _report(R.most_played_monthly),
        "r08_avg_track_length_monthly": _report(R.avg_track_length_monthly),
        "r09_avg_play_count_per_song_yearly": _report(R.avg_play_count_per_song_yearly),
        "r10_play_count_distribution": _report(R.play_count_distribution),
        "r11_yearly_track_play_count": _report(R.yearly_track_play_count),
        "r12_hour_of_day_share": _report(R.hour_of_day_share),
        "r13_avg_hours_per_year_month": _report(R.avg_hours_per_year_month),
        "r14_avg_hours_per_year": _report(R.avg_hours_per_year),
        "r15_avg_hours_per_month_of_year": _report(R.avg_hours_per_month_of_year),
        "r16_avg_hours_per_weekday": _report(R.avg_hours_per_weekday),
        "r17_plays_per_country": _report(R.plays_per_country),
        "r18_cumulative_play_share_track": _report(R.cumulative_play_share, entity="track"),
        "r18_cumulative_play_share_artist": _report(R.cumulative_play_share, entity="artist"),
        "r22_month_spine": _report(R.month_spine),
    }

    def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = R.filter_history(plays(spark, sf_dir), RS.FILTER_START, RS.FILTER_END, RS.FILTER_ARTIST)
        return f.select("listener_id", "track_id", "ts", "ms_played", "full_play", "year_month")

    out["r21_filter_history"] = filtered

    def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The sampled rows turned back: how many there are and which are rows of the history."""
        p = plays(spark, sf_dir)
        columns = ["listener_id", "track_id", "ts", "ms_played"]
        drawn = R.random_sample(p.select(*columns), n=3, seed=7)
        rows = drawn.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), "column", F.col(f"sample_{i}").alias("value")) for i in (1, 2, 3)])).alias("x")).select("x.*")
        back = rows.groupBy("i").pivot("column", columns).agg(F.first("value"))
        text = p.select(*[F.col(c).cast("string").alias(c) for c in columns])
        found = back.join(text, columns, "left_semi")
        return found.agg(F.count(F.lit(1)).alias("members")).select(
            "members", F.lit(",".join(drawn.columns)).alias("columns"))

    def kpis_(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kpis.single_values(plays(spark, sf_dir))

    def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
        # written once: counted from the plays themselves, every table would bind all of them again
        rep = report_plan.Report(plays(spark, sf_dir), k=k)
        return report_plan.table_sizes(rep)

    def sample_by_listener(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.sampled_rows(plays(spark, sf_dir).select(*RS.SAMPLE_COLUMNS), RS.SAMPLE_ROWS, RS.SAMPLE_SEED, by=["listener_id"])

    out["r20_sampled_rows_by_listener"] = sample_by_listener
    out["r19_single_values"] = kpis_
    out["r20_random_sample"] = sample
    out["r23_report_table_sizes"] = sizes
    return out


def recipe_queries() -> dict[str, Query]:
    R = recipes
    return {
        "q01_top_artists_by_hours": _recipe(R.top_artists_by_hours),
        "q02_top_tracks_of_artist": _recipe(R.top_tracks_of_artist, artist_name=P.ARTIST),
        "q03_first_plays": _recipe(R.first_plays),
        "q04_hours_by_gender": _recipe(R.hours_by_gender),
        "q05_top_track_per_female_artist": _recipe(R.top_track_per_female_artist, as_of=P.AS_OF),
        "q06_artists_without_kg_by_hours": _recipe(R.artists_without_kg_by_hours),
        "q07_artists_without_kg_by_popularity": _recipe(R.artists_without_kg_by_popularity),
        "q08_top_countries": _recipe(R.top_countries),
        "q09_top_solo_tracks_by_release_era": _recipe(R.top_solo_tracks_by_release_era),
        "q10_top_genres": _recipe(R.top_genres),
        "q11_top_tracks_in_genre": _recipe(R.top_tracks_in_genre),
        "q12_genre_share_by_year": _recipe(R.genre_share_by_year),
        "q12b_genre_share_since": _recipe(R.genre_share_by_year, since=P.GENRE_SINCE),
        "q13_top_bands_and_solo": _recipe(R.top_bands_and_solo),
        "q14_top_artist_per_top_country": _recipe(R.top_artist_per_top_country),
        "q15_discovered_in_year": _recipe(R.discovered_in_year, year=P.DISCOVERY_YEAR),
        "q16_never_finished": _recipe(R.never_finished),
        "q17_least_played_of_top_albums": _recipe(R.least_played_of_top_albums),
        "q18_one_hit_wonders": _recipe(R.one_hit_wonders, min_top_plays=P.ONE_HIT_MIN_TOP,
                                       max_other_plays=P.ONE_HIT_MAX_OTHER),
        "q19_not_played_since": _recipe(R.not_played_since, as_of=P.AS_OF),
    }


def ingest_queries() -> dict[str, Query]:
    """Cleaning and enrichment chains over raw exports / documents derived from the tables."""
    def raw(spark, sf_dir):
        return tables.plays_raw_wide(spark, sf_dir)

    def clean_history(spark, sf_dir):
        return clean.clean_history(derived.parse_export(derived.raw_export(raw(spark, sf_dir))))

    def history_files(spark, sf_dir):
        from encore.session import scratch_path
        from encore.sources import history

        path = scratch_path(spark, "s1-export")
        derived.export_files(derived.raw_records(raw(spark, sf_dir)), path)
        read = history.read_history(spark, path, listener=r"listener_id=(\d+)/", glob="*.txt.gz")
        return clean.clean_history(read.withColumn("listener_id", F.col("listener_id").cast("bigint")))

    def zips(spark, sf_dir):
        from encore.session import scratch_path
        from encore.sources import history

        path = scratch_path(spark, "s3-zips")
        derived.export_zips(derived.raw_records(raw(spark, sf_dir)), path, history.HISTORY_FOLDER)
        return path

    def history_zips(spark, sf_dir):
        from encore.sources import history

        read = history.ingest_archives(spark, zips(spark, sf_dir), listener=r"/(\d+)--?\d+\.zip$", malformed="skip")
        return clean.clean_history(read.drop("archive", "member").withColumn("listener_id", F.col("listener_id").cast("bigint")))

    def zip_kinds(spark, sf_dir):
        from encore.sources import history

        kinds = history.classify_archives(history.archive_manifest(spark, zips(spark, sf_dir)))
        listener = F.regexp_extract("archive", r"/(\d+)--?\d+\.zip$", 1).cast("bigint")
        return kinds.select(listener.alias("listener_id"), "kind").distinct()

    def entity_documents(spark, sf_dir):
        from encore.session import freed_shuffles, scratch_path
        from encore.sources import entities

        src, out, rows = (scratch_path(spark, f"s9-{n}") for n in ("documents", "table", "artists"))
        # the plays are bound once; documents derive from a row per artist
        with freed_shuffles(spark):
            raw(spark, sf_dir).select(*derived.ARTIST_COLUMNS).distinct().write.parquet(rows)
        artist_rows = spark.read.parquet(rows)
        docs = derived.artist_docs(artist_rows)
        # first versions of every second artist, one of three of them cut off; then all as they are
        old = docs.where("cast(id as bigint) % 2 = 0").withColumn("name", F.lit("an older name"))
        text = F.to_json(F.struct(*docs.columns))
        cut = F.when(F.col("id").cast("bigint") % 3 == 0, F.substring(text, 1, 20)).otherwise(text)
        derived.document_files(old.withColumn("shown", cut), src, shown="shown")
        entities.update(spark, src, out, schemas.ARTIST_DOC, malformed="skip")
        derived.document_files(docs, src)
        entities.update(spark, src, out, schemas.ARTIST_DOC, malformed="skip")
        return enrich.flatten_artists(entities.documents(spark, out), derived.kg_docs(artist_rows))

    def composite(spark, sf_dir):
        keyed = tables.with_missing_names(raw(spark, sf_dir)).select(
            F.concat("track_name", F.lit(X.COMPOSITE_SEP), "artist_name").alias("key")).where("key is not null").distinct()
        return clean.split_composite(keyed, "key", ("track_name", "artist_name")).select("track_name", "artist_name")

    def country_names(spark, sf_dir):
        # the names of two regions are unknown
        names = tables.scan(spark, sf_dir, "nation").where("n_regionkey > 1").select(
            F.col("n_name").alias("code"), F.initcap(F.translate("n_name", "_", " ")).alias("name"))
        named = clean.country_name(raw(spark, sf_dir), names)
        return named.groupBy("conn_country").agg(F.count(F.lit(1)).alias("plays"))

    def tracks(spark, sf_dir):
        return enrich.flatten_tracks(derived.track_docs(raw(spark, sf_dir)))

    def referenced(spark, sf_dir):
        return enrich.referenced_ids(derived.track_docs(raw(spark, sf_dir)))

    def artists(spark, sf_dir):
        r = raw(spark, sf_dir)
        return enrich.flatten_artists(derived.artist_docs(r), derived.kg_docs(r))

    def albums(spark, sf_dir):
        return enrich.flatten_albums(derived.album_docs(raw(spark, sf_dir)))

    def pending(spark, sf_dir):
        r = raw(spark, sf_dir)
        cached = derived.track_docs(r.filter(F.col("artist_id") % 2 == 0)).select("id")
        return enrich.pending_ids(r.select(F.col("track_id").alias("id")), cached)

    def batches(spark, sf_dir):
        # every pending id is in exactly one batch of at most 50 ids
        ids = enrich.pending_ids(raw(spark, sf_dir).select(F.col("track_id").alias("id")),
                                 spark.createDataFrame([], "id string"))
        b = enrich.batch_ids(ids, 50)
        return b.select(F.explode("ids").alias("id"), (F.size("ids") <= 50).alias("within_limit"))

    def images(spark, sf_dir):
        docs = derived.artist_docs(raw(spark, sf_dir))
        cached = docs.filter(F.col("id").cast("long") % 3 == 0).select("id")
        return enrich.image_worklist(docs, cached)

    def wide_from_docs(spark, sf_dir):
        from encore.plans import ingest
        from encore.session import scratch_path
        from encore.sinks import bucketed

        # the plays are bound and written once, with the keys and names of their track; what the documents are derived from
        # is a row per track, to which the artist's attributes are joined afterwards
        track = ["track_id", "track_name", "album_id", "album_name", "artist_id"]
        play = ["listener_id", "ts", "ms_played", "reason_start", "reason_end"]
        bound, entities = scratch_path(spark, "e14-bound"), scratch_path(spark, "e14-entities")
        raw(spark, sf_dir).select(*track, "track_duration_ms", *play).write.parquet(bound)
        stored = spark.read.parquet(bound)
        # names as keys and numbers as measures: the aggregate stays a hash aggregate
        per_track = stored.groupBy(*track).agg(F.max("track_duration_ms").alias("track_duration_ms"), F.count(F.lit(1)).alias("n"))
        tables.with_artist_columns(spark, sf_dir, per_track).write.parquet(entities)
        r = spark.read.parquet(entities)
        plays_ = clean.mark_full_play(clean.map_reasons(stored.select("track_id", *play)))
        plays_ = plays_.select("listener_id", "track_id", "ts", "ms_played", "reason_start", "reason_end", "full_play")
        # an artist that the suppliers list twice has its tracks twice in the entities, but not in its plays' counts
        once = r.select(*track, "n").distinct().groupBy("track_id").agg(F.sum("n").alias("n"))
        fact = bucketed.write_bucketed(plays_, scratch_path(spark, "e14-fact"), counts=once)
        w = ingest.enrich_stored_fact(
            fact, enrich.flatten_tracks(derived.track_docs(r)), enrich.flatten_albums(derived.album_docs(r)),
            enrich.flatten_artists(derived.artist_docs(r), derived.kg_docs(r)))
        return w.select(*IS.WIDE_FROM_DOCS_COLUMNS)

    return {
        "p_clean_history": clean_history,
        "s1_read_history_files": history_files,
        "p16_split_composite": composite,
        "p18_country_names": country_names,
        "s3_ingest_archives": history_zips,
        "s4_classify_archives": zip_kinds,
        "s9_entity_documents": entity_documents,
        "e01_pending_track_ids": pending,
        "e02_id_batches": batches,
        "e03_image_worklist": images,
        "e04_flatten_tracks": tracks,
        "e05_referenced_ids": referenced,
        "e11_flatten_artists": artists,
        "e12_flatten_albums": albums,
        "e14_wide_fact_from_documents": wide_from_docs,
    }


def by_listener_queries() -> dict[str, Query]:
    """The same operators computed for every listener in one pass (``by=["listener_id"]``)."""
    R, k, by = report, RS.REPORT_K, ["listener_id"]
    return {
        "r01_most_played_artists_by_listener": _report(R.most_played_artists, k=k, by=by),
        "r12_hour_of_day_share_by_listener": _report(R.hour_of_day_share, by=by),
        "r13_avg_hours_per_year_month_by_listener": _report(R.avg_hours_per_year_month, by=by),
        "r18_cumulative_play_share_artist_by_listener": _report(R.cumulative_play_share, entity="artist", by=by),
        "r19_single_values_by_listener": _report(kpis.single_values, by=by),
        "q01_top_artists_by_hours_by_listener": _recipe(recipes.top_artists_by_hours, by=by),
    }


def sink_queries() -> dict[str, Query]:
    """Sinks exercised as written tables in the shared checkpoint folder, read back."""
    from encore.session import scratch_path
    from encore.sinks import writers
    from encore.sources import history

    def parquet_round_trip(spark, sf_dir):
        path = scratch_path(spark, "s6-plays")
        writers.write_parquet(plays(spark, sf_dir).select(*S6_COLUMNS), path, partition_by=["year"], cluster_by=["ts"])
        return spark.read.parquet(path).select(*S6_COLUMNS)

    def csv_round_trip(spark, sf_dir):
        path = scratch_path(spark, "s7-plays")
        writers.write_csv(wide(spark, sf_dir).select(*clean.PLAY_COLUMNS), path)
        return history.read_csv(spark, path)

    def report_documents(spark, sf_dir):
        path = scratch_path(spark, "s8-report")
        rep = report_plan.Report(plays(spark, sf_dir), k=RS.REPORT_K)
        try:
            writers.write_report(rep.tables, rep.single_values, path)
        finally:
            rep.close()
        cells = writers.read_report_values(spark, path, list(rep.tables))
        # numbers as numbers: 2 and 2.0 are the same cell
        number = F.when(~F.col("column_name").isin(RS.TEXT_COLUMNS), F.col("value").cast("double"))
        return cells.select("table_name", "position", "column_name", number.alias("number"),
                            F.when(F.col("column_name").isin(RS.TEXT_COLUMNS), F.col("value")).alias("text"))

    def streaming_ingest(spark, sf_dir):
        from encore.streaming import ingest

        src, out, ckpt = (scratch_path(spark, f"st-{n}") for n in ("src", "fact", "ckpt"))
        # one play object per line; there are several batches of files
        derived.export_lines(derived.raw_records(tables.plays_raw_wide(spark, sf_dir)), src)
        q = ingest.start_ingest(spark, src, out, checkpoint=ckpt, multi_line=False, listener=r"listener_id=(\d+)/", glob="*.txt.gz")
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
        return ingest.stored(spark, out).select(F.col("listener_id").cast("bigint").alias("listener_id"), *clean.PLAY_COLUMNS)

    def yearly_stream(spark, sf_dir):
        from encore.streaming import yearly

        src, state, ckpt = (scratch_path(spark, f"st-yearly-{n}") for n in ("src", "state", "ckpt"))
        columns = ["track_name", "artist_name", "year", "full_play"]
        # seven batches, each a random part of the history, so that older plays keep arriving late
        dealt = plays(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("track_id", "ts", "listener_id"), F.lit(7)))
        dealt.select(*columns, "part").repartition(7, "part").select(*columns).write.parquet(src)
        q = yearly.start(spark, src, state, ckpt, max_files_per_trigger=1, compact_every=3)
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
        return yearly.current(spark, state)

    return {
        "st_incremental_ingest": streaming_ingest,
        "st_yearly_track_play_count": yearly_stream,
        "s6_parquet_round_trip": parquet_round_trip,
        "s7_csv_round_trip": csv_round_trip,
        "s8_report_documents": report_documents,
    }


S6_COLUMNS = ["listener_id", "track_id", "ts", "ms_played", "full_play", "year", "month"]


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(by_listener_queries())
    out.update(sink_queries())
    out.update(ingest_queries())
    out.update(recipe_queries())
    out.update(report_queries())
    return out


def all_oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(P.recipe_sql())
    out.update(RS.report_sql())
    out.update(RS.by_listener_sql())
    out["r19_single_values_by_listener"] = RS.kpi_by_listener_sql()
    out["s6_parquet_round_trip"] = IS.parquet_sql()
    out["s7_csv_round_trip"] = IS.csv_sql()
    out["s8_report_documents"] = RS.report_documents_sql(out)
    out["p_clean_history"] = IS.clean_history_sql()
    out["s1_read_history_files"] = IS.clean_history_sql()
    out["st_incremental_ingest"] = IS.clean_history_sql()
    out["st_yearly_track_play_count"] = out["r11_yearly_track_play_count"]
    out["s3_ingest_archives"] = IS.clean_history_sql()
    out["s4_classify_archives"] = IS.archive_kinds_sql()
    out["e02_id_batches"] = IS.batches_sql()
    out["p16_split_composite"] = IS.composite_sql()
    out["p18_country_names"] = IS.country_names_sql()
    out.update(IS.enrich_sql())
    out["s9_entity_documents"] = out["e11_flatten_artists"]
    return out
