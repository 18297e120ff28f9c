"""Benchmark: headline operators at $BENCH_SF_DIR on local[$BENCH_CPUS].

Mirrors how the engine is used: the star-schema binding is ingested once into
a parquet fact (written under the session's checkpoint folder, which cuts the
lineage), then every report table and recipe runs over that fact. Each query
is forced with a ``noop`` write (full execution, nothing collected) and timed
total is reported too). The same holds for all recipes per listener and for the
whole report bundle with and without ``by=["listener_id"]``. The ingest is a
single cold run. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from encore.checks import recipes_sql as P  # noqa: E402
from encore.operators import clean, kpis, recipes, report  # noqa: E402
from encore.plans import catalog  # noqa: E402
from encore.plans import report as report_plan  # noqa: E402
from encore.session import build_session, scratch_path  # noqa: E402
from encore.sinks import writers  # noqa: E402
from encore.sources import derived, history, tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
K = 20
MANY_LISTENERS = 15_000


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return round(time.perf_counter() - t, 3)


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]", app_name="encore-bench", shuffle_partitions=max(8, CPUS),
        extra_conf={"spark.driver.memory": "16g", "spark.sql.files.maxPartitionBytes": str(64 << 20)},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    # ingest: binding → cleaned wide fact with calendar columns, written once
    fact_path = scratch_path(spark, "fact")
    raw = tables.plays_raw_wide(spark, SF_DIR)
    times["ingest_fact"] = timed(lambda: clean.report_plays(raw).write.mode("overwrite").parquet(fact_path))
    fact = spark.read.parquet(fact_path)

    # warm-up (JIT, codegen caches) — not timed
    force(recipes.top_artists_by_hours(fact))

    q = {
        "q01_top_artists_by_hours": lambda: recipes.top_artists_by_hours(fact),
        "q02_top_tracks_of_artist": lambda: recipes.top_tracks_of_artist(fact, P.ARTIST),
        "q03_first_plays": lambda: recipes.first_plays(fact),
        "q04_hours_by_gender": lambda: recipes.hours_by_gender(fact),
        "q05_top_track_per_female_artist": lambda: recipes.top_track_per_female_artist(fact, P.AS_OF),
        "q06_artists_without_kg_by_hours": lambda: recipes.artists_without_kg_by_hours(fact),
        "q07_artists_without_kg_by_popularity": lambda: recipes.artists_without_kg_by_popularity(fact),
        "q08_top_countries": lambda: recipes.top_countries(fact),
        "q09_top_solo_tracks_by_release_era": lambda: recipes.top_solo_tracks_by_release_era(fact),
        "q10_top_genres": lambda: recipes.top_genres(fact),
        "q11_top_tracks_in_genre": lambda: recipes.top_tracks_in_genre(fact),
        "q12_genre_share_by_year": lambda: recipes.genre_share_by_year(fact),
        "q13_top_bands_and_solo": lambda: recipes.top_bands_and_solo(fact),
        "q14_top_artist_per_top_country": lambda: recipes.top_artist_per_top_country(fact),
        "q15_discovered_in_year": lambda: recipes.discovered_in_year(fact, P.DISCOVERY_YEAR),
        "q16_never_finished": lambda: recipes.never_finished(fact),
        "q17_least_played_of_top_albums": lambda: recipes.least_played_of_top_albums(fact),
        "q18_one_hit_wonders": lambda: recipes.one_hit_wonders(fact, P.ONE_HIT_MIN_TOP, P.ONE_HIT_MAX_OTHER),
        "q19_not_played_since": lambda: recipes.not_played_since(fact, P.AS_OF),
        "r01_most_played_artists": lambda: report.most_played_artists(fact, K),
        "r02_most_played_tracks": lambda: report.most_played_tracks(fact, K),
        "r05_monthly_play_series_artists": lambda: report.monthly_play_series(fact, "artist", K),
        "r06_top_songs_of_top_artists": lambda: report.top_songs_of_top_artists(fact, K),
        "r07_most_played_monthly": lambda: report.most_played_monthly(fact),
        "r11_yearly_track_play_count": lambda: report.yearly_track_play_count(fact),
        "r13_avg_hours_per_year_month": lambda: report.avg_hours_per_year_month(fact),
        "r16_avg_hours_per_weekday": lambda: report.avg_hours_per_weekday(fact),
        "r18_cumulative_play_share_track": lambda: report.cumulative_play_share(fact, "track"),
        "r19_single_values": lambda: kpis.single_values(fact),
    }
    # (warm: JIT and codegen caches filled) run is reported, the first is kept as cold.
    cold: dict[str, float] = {}
    for name, build in q.items():
        cold[name] = timed(lambda: force(build()))
        times[name] = timed(lambda: force(build()))

    def whole_report(by):
        # the bundle writes the cuboids of the fact, a written table already, then every table reads them
        with report_plan.Report(fact, k=K, by=by, materialize="cuboids") as rep:
            rep.for_each(lambda name, df: force(df))

    by = ["listener_id"]

    def recipes_by_listener():
        for build in (
            lambda: recipes.top_artists_by_hours(fact, by=by),
            lambda: recipes.top_tracks_of_artist(fact, P.ARTIST, by=by),
            lambda: recipes.first_plays(fact, by=by),
            lambda: recipes.hours_by_gender(fact, by=by),
            lambda: recipes.top_track_per_female_artist(fact, P.AS_OF, by=by),
            lambda: recipes.artists_without_kg_by_hours(fact, by=by),
            lambda: recipes.artists_without_kg_by_popularity(fact, by=by),
            lambda: recipes.top_countries(fact, by=by),
            lambda: recipes.top_solo_tracks_by_release_era(fact, by=by),
            lambda: recipes.top_genres(fact, by=by),
            lambda: recipes.top_tracks_in_genre(fact, by=by),
            lambda: recipes.genre_share_by_year(fact, by=by),
            lambda: recipes.top_bands_and_solo(fact, by=by),
            lambda: recipes.top_artist_per_top_country(fact, by=by),
            lambda: recipes.discovered_in_year(fact, P.DISCOVERY_YEAR, by=by),
            lambda: recipes.never_finished(fact, by=by),
            lambda: recipes.least_played_of_top_albums(fact, by=by),
            lambda: recipes.one_hit_wonders(fact, P.ONE_HIT_MIN_TOP, P.ONE_HIT_MAX_OTHER, by=by),
            lambda: recipes.not_played_since(fact, P.AS_OF, by=by),
        ):
            force(build())

    # the ingest from JSON-array files, the star join from documents, and the written report
    export = scratch_path(spark, "bench-export")
    derived.export_files(derived.raw_export(raw), export)

    def json_ingest():
        plays = history.read_history(spark, export, listener=r"listener_id=(\d+)/", glob="*.txt.gz")
        force(clean.clean_history(plays))

    def report_documents():
        with report_plan.Report(fact, k=K, materialize="cuboids") as rep:
            writers.write_report(rep.tables, rep.single_values, scratch_path(spark, "bench-report"))

    # thousands of listeners instead of fifty
    many = fact.withColumn("listener_id", F.pmod(F.xxhash64("track_id", "ts"), F.lit(MANY_LISTENERS)))

    for name, fn in (("s1_read_history_files", json_ingest),
                     ("e14_wide_fact_from_documents", lambda: force(catalog.ingest_queries()["e14_wide_fact_from_documents"](spark, SF_DIR))),
                     ("s8_report_documents", report_documents),
                     ("r01_many_listeners", lambda: force(report.most_played_artists(many, K, by=by))),
                     ("r18_many_listeners", lambda: force(report.cumulative_play_share(many, "artist", by=by))),
                     ("q_all_recipes_by_listener", recipes_by_listener),
                     ("r23_report_all", lambda: whole_report(())),
                     ("r23_report_all_by_listener", lambda: whole_report(("listener_id",)))):
        cold[name] = timed(fn)
        times[name] = timed(fn)
    n_rows = fact.count()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_sec", "value": total, "unit": "sec", "queries": times,
        "cold_total_sec": round(sum(cold.values()), 3),
        "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""), "fact_rows": n_rows, "cpus": CPUS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
