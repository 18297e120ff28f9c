"""The whole website report as a dict of lazy DataFrames over a few cuboids of one fact.

The fact is pruned to the columns the report reads and aggregated to the cuboids of ``operators.cuboids``: entity
months (and from them a row per names), days, and places. Every table and the KPIs are then derived from one of them:

* ``materialize="table"`` (default): the pruned fact is written once as parquet under the session's shared
  ``spark.checkpoint.dir``, each cuboid is aggregated from it by one scan and written, and the tables read the cuboids.
  Written tables cut the lineage: nothing upstream runs again for a table or when an executor is lost.
* ``materialize="cuboids"``: the input is a written table already, so only the cuboids are written.
* ``materialize="persist"``: the pruned fact is kept by ``persist(MEMORY_AND_DISK)``, the cuboids are written from it;
  lost blocks are recomputed from lineage. ``close()`` releases it.
* ``materialize=None``: nothing is written; the tables are aggregated from the fact as given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from encore.operators import cuboids as C
from encore.operators import kpis
from encore.operators import report as R
from encore.operators.clean import with_month_index
from encore.session import scratch_path

REPORT_COLUMNS = [
    "track_name", "artist_name", "album_name", "ts", "ms_played", "reason_start", "reason_end", "full_play",
    "conn_country", "shuffle", "incognito_mode", "year", "month", "year_month", "day", "hour", "month_seq",
]


class Report:
    """Named report tables; ``tables`` holds lazy frames. With ``materialize="table"`` the shared fact is written at once."""

    def __init__(self, plays: DataFrame, k: int = 100, only_top_k: bool = False, by: Sequence[str] = (),
                 materialize: str | None = "table"):
        by = list(by)
        fact = plays.select(*[c for c in [*by, *REPORT_COLUMNS, "month_index"] if c in plays.columns])
        self._cached = None
        self._spark = plays.sparkSession
        self._written: list[str] = []
        if materialize == "table":
            fact = self._store(fact, "report-fact")
        elif materialize == "persist":
            self._cached = fact = fact.persist(StorageLevel.MEMORY_AND_DISK)
        days = names = totals = None
        entities = months = calendar = places = fact
        # a month index that the plays bring along (a filtered history keeps the whole one's) is not computed again
        ready = "month_index" in plays.columns
        if materialize is not None:
            with ThreadPoolExecutor(3) as pool:  # three scans of the fact, beside each other
                months, days, places = (job.result() for job in [
                    pool.submit(self._store, make(fact, by), name) for make, name in (
                        (C.entity_months, "report-entity-months"), (C.days, "report-days"), (C.places, "report-places"))])
            names = entities = months
            if C.rolls_up(months, by):  # most tables then take the smaller one
                names = entities = totals = self._store(C.without_months(months, by), "report-entities")
            months, calendar = C.with_month_columns(months), C.with_day_columns(days)
        t: dict[str, DataFrame] = {
            "most_played_artists_total": R.most_played_artists(entities, k, by),
            "most_played_tracks_total": R.most_played_tracks(entities, k, by),
            "most_played_albums_total": R.most_played_albums(entities, k, by),
            "most_played_tracks_total_reason_start_clickrow": R.most_played_tracks_clickrow(entities, k, by),
            "monthly_play_series_artists": R.monthly_play_series(months, "artist", k, by, month_index_ready=ready, totals=totals),
            "monthly_play_series_tracks": R.monthly_play_series(months, "track", k, by, month_index_ready=ready, totals=totals),
            "monthly_play_series_albums": R.monthly_play_series(months, "album", k, by, month_index_ready=ready, totals=totals),
            "top_songs_of_top_artists": R.top_songs_of_top_artists(entities, k, by),
        }
        if not only_top_k:
            t.update({
                "most_played_artists_track_album_monthly": R.most_played_monthly(months, by),
                "avg_track_length_monthly": R.avg_track_length_monthly(calendar, by),
                "avg_play_count_per_song_yearly": R.avg_play_count_per_song_yearly(months, by),
                "play_count_distribution": R.play_count_distribution(entities, by),
                "yearly_track_play_count": R.yearly_track_play_count(months, by),
                "hours_played_percent_per_hour_of_the_day": R.hour_of_day_share(places, by),
                "avg_hours_played_per_year_month": R.avg_hours_per_year_month(calendar, by),
                "avg_hours_played_per_year": R.avg_hours_per_year(calendar, by),
                "avg_hours_played_per_month": R.avg_hours_per_month_of_year(calendar, by),
                "avg_hours_played_per_day_name": R.avg_hours_per_weekday(calendar, by),
                "plays_per_county_total": R.plays_per_country(places, by),
                "cumulative_percent_play_count_track": R.cumulative_play_share(entities, "track", by),
                "cumulative_percent_play_count_artist": R.cumulative_play_share(entities, "artist", by),
            })
        self.tables = t
        self.single_values = kpis.single_values(fact, by, days=days, names=names)

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self._spark, name)
        df.write.parquet(path)
        self._written.append(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def for_each(self, action: Callable[[str, DataFrame], None], at_once: int = 4) -> None:
        """Run ``action(name, table)`` for every table and the KPIs, ``at_once`` jobs at a time.

        The tables are separate small jobs over one written fact; run one by one they leave most of a cluster idle.
        """
        frames = {**self.tables, "single_values": self.single_values}
        with ThreadPoolExecutor(at_once) as pool:
            for done in [pool.submit(action, name, df) for name, df in frames.items()]:
                done.result()

    def close(self) -> None:
        """Release the shared fact and the cuboids: unpersist, and overwrite what was written by tables without rows."""
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None
        for path in self._written:
            self._spark.range(0).write.mode("overwrite").parquet(path)
        self._written = []

    def __enter__(self) -> Report:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def build_report(plays: DataFrame, k: int = 100, only_top_k: bool = False, by: Sequence[str] = (),
                 materialize: str | None = "table") -> Report:
    return Report(plays, k, only_top_k, by, materialize)


def table_sizes(rep: Report) -> DataFrame:
    """One row per report table: (table_name, n_rows); each is a one-row count."""
    from pyspark.sql import functions as F

    frames = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
              for name, df in rep.tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class NoPlays(ValueError):
    """A filter left no full play, so there is no report."""


def filtered_report(plays: DataFrame, start: tuple[int, int], end: tuple[int, int], artist_name: str | None = None,
                    k: int = 100, by: Sequence[str] = (), materialize: str | None = "table") -> Report:
    """R21 → R23: the report over a month range (and optionally one artist). Months are numbered from the first month
    of the whole history. Raises :class:`NoPlays` when no full play remains (checked by reading one row)."""
    subset = R.filter_history(with_month_index(plays, by), start, end, artist_name)
    if not R.has_full_plays(subset):
        raise NoPlays(f"no full play between {start} and {end}" + (f" by {artist_name}" if artist_name else ""))
    return Report(subset, k=k, by=by, materialize=materialize)
