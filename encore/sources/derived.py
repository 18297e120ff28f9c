"""Raw play-log records and nested entity documents derived from the driver tables.

The driver's parquet tables carry no raw exports or API documents, so these
builders re-express the bound plays in those input formats with Spark
(deterministic column rules, no sampling): every cleaning and enrichment
operator then runs over inputs that grow with the tables. The rules also
plant the edge cases the operators must handle — non-music rows, the text
``None``, exact duplicates, offline epochs in s and ms, featured artists,
empty graph documents, superseded graph bindings, unknown and malformed
release dates, missing images.
"""

from __future__ import annotations

import gzip
import itertools
import operator
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore import schemas
from encore.functions import exprs as X
from encore.session import freed_shuffles
from encore.sources import archives

GRAPH_ENTITY_PREFIX = "http://www.wikidata.org/entity/"


def _ids(*cols: Column) -> Column:
    return F.array(*[F.struct(c.cast("string").alias("id")) for c in cols])


# ---------------------------------------------------------------------------
# raw play-log export


# What a raw export record is made of.
RECORD_COLUMNS = [
    "listener_id", "track_id", "track_name", "artist_name", "album_name", "ts", "ms_played", "reason_start", "reason_end",
    "conn_country", "platform", "shuffle", "offline", "incognito_mode",
]


def raw_records(raw: DataFrame) -> DataFrame:
    """One row per raw export record, with the columns that :func:`record_json` takes: one record per bound play, plus a
    duplicate of every play at 03:xx, in which a false ``skipped`` is null."""
    skipped = F.col("reason_end") == "fwdbtn"
    # one pass: a play at 03:xx stands for two records
    flags = F.when(F.hour("ts") == 3, F.array(skipped, F.when(skipped, True))).otherwise(F.array(skipped))
    return raw.select(*RECORD_COLUMNS, F.explode(flags).alias("_skipped"))


def record_json() -> Column:
    """The JSON text of a row of :func:`raw_records`. It is several times as long as the row, so make it after sorts and shuffles."""
    q = F.col("ms_played") / 6000
    podcast = q == 1
    epoch = F.unix_timestamp(F.col("ts").cast("timestamp")) - 3600
    offline_ts = (F.when(~F.col("offline"), F.when(F.col("listener_id") % 3 == 0, F.lit(0)))
                  .when(F.col("listener_id") % 2 == 0, epoch * 1000 + 500)
                  .otherwise(epoch))
    return F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.col("platform"),
        F.col("ms_played"),
        F.col("conn_country"),
        F.concat(F.lit("10."), F.col("listener_id").cast("string"), F.lit(".0.1")).alias("ip_addr_decrypted"),
        F.when(podcast, F.lit(None)).when(q == 2, F.lit("None")).otherwise(F.col("track_name"))
        .alias("master_metadata_track_name"),
        F.col("artist_name").alias("master_metadata_album_artist_name"),
        F.col("album_name").alias("master_metadata_album_album_name"),
        F.concat(F.lit("media:track:"), F.col("track_id")).alias("spotify_track_uri"),
        F.when(podcast, F.concat(F.lit("episode "), F.col("track_name"))).alias("episode_name"),
        F.when(podcast, F.col("artist_name")).alias("episode_show_name"),
        F.when(podcast, F.concat(F.lit("media:episode:"), F.col("track_id"))).alias("spotify_episode_uri"),
        F.col("reason_start"), F.col("reason_end"), F.col("shuffle"),
        F.col("_skipped").alias("skipped"),
        F.col("offline"),
        offline_ts.cast("long").alias("offline_timestamp"),
        F.col("incognito_mode"),
    ))


def raw_export(raw: DataFrame) -> DataFrame:
    """(listener_id, json) rows: the records of :func:`raw_records` as text."""
    return raw_records(raw).select("listener_id", record_json().alias("json"))


def _listener_order(records: DataFrame) -> DataFrame:
    """(listener_id, json) of :func:`raw_records` or of :func:`raw_export`, a listener's records of a task one after another.

    Their order follows from the records, so that a task that runs again makes the same files.
    """
    known = records.where("listener_id is not null")
    rows = known.withColumn("_order", F.xxhash64(*records.columns)).sortWithinPartitions("listener_id", "_order")
    return rows.select("listener_id", F.col("json") if "json" in records.columns else record_json().alias("json"))


def _runs(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[str]]]:
    """A listener and at most ``most`` of its texts at a time, from batches in listener order."""
    who, texts = None, []
    for part in parts:
        for listener, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if texts and (listener != who or len(texts) >= most):
                yield who, texts
                texts = []
            who = listener
            texts.append(text)
    if texts:
        yield who, texts


def export_lines(records: DataFrame, path: str, parts: int = 8) -> None:
    """Write the export records as gzipped files of one play a line, ``listener_id=<id>/part=<n>/*.txt.gz`` under ``path``.

    A listener's records are dealt over ``parts`` folders by their hash, so that the number of files follows from the
    plays and not from the tasks that had them. ``records`` are those of :func:`raw_records`, which become JSON where
    they are written.
    """
    texts = X.text_columns(records)
    dealt = X.pack_texts(records.withColumn("part", F.pmod(F.xxhash64(*records.columns), F.lit(parts))), texts)
    # sorted while they are short, as the writer wants them
    sorted_ = dealt.hint("rebalance", "listener_id", "part").sortWithinPartitions("listener_id", "part")
    rows = X.unpack_texts(sorted_, texts, [*records.columns, "part"])
    lines = rows.select("listener_id", "part", record_json().alias("value"))
    with freed_shuffles(records.sparkSession):
        lines.write.partitionBy("listener_id", "part").option("compression", "gzip").text(path)


_WRITTEN = "listener_id bigint, file string"
_WRITTEN_ARROW = pa.schema([("listener_id", pa.int64()), ("file", pa.string())])


def _write_files(folder: str, plays_per_file: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, (who, texts) in enumerate(_runs(parts, plays_per_file)):
            name = f"listener_id={who}/{task}-{n}.txt.gz"
            with archives.created(f"{folder}/{name}") as out:
                out.write(gzip.compress(("[" + ",".join(texts) + "]").encode("utf-8"), 6, mtime=0))
            yield pa.RecordBatch.from_pylist([{"listener_id": who, "file": name}], schema=_WRITTEN_ARROW)

    return run


def export_files(records: DataFrame, path: str, plays_per_file: int = 1000) -> None:
    """Write the export records as gzipped files that hold one JSON array each, ``listener_id=<id>/<task>-<n>.txt.gz`` under ``path``.

    Each task writes the records it has, a listener's in files of at most ``plays_per_file``: nothing is shuffled, and
    there is a folder per listener, not per file. ``records`` are those of :func:`raw_records` or of :func:`raw_export`.
    """
    written = _listener_order(records).mapInArrow(_write_files(path, plays_per_file), _WRITTEN)
    with freed_shuffles(records.sparkSession):
        written.write.format("noop").mode("overwrite").save()


def _write_zips(folder: str, history: str, plays_per_member: int, members_per_zip: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for who, members in itertools.groupby(_runs(parts, plays_per_member), operator.itemgetter(0)):
            for number in itertools.count(task * _ZIPS_PER_TASK):
                some = list(itertools.islice(members, members_per_zip))
                if not some:
                    break
                name = f"{who}-{number}.zip"
                with archives.created(f"{folder}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("ReadMeFirst.txt", "an export")
                    for i, (_, texts) in enumerate(some):
                        archive.writestr(f"{history}/plays_{i}.json", "[" + ",".join(texts) + "]")
                yield pa.RecordBatch.from_pylist([{"listener_id": who, "file": name}], schema=_WRITTEN_ARROW)

    return run


def _write_others(folder: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                name = f"{row['listener_id']}-{row['number']}.zip"
                with archives.created(f"{folder}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("ReadMeFirst.txt", "an export")
                    archive.writestr(row["member"], row["value"])
                yield pa.RecordBatch.from_pylist([{"listener_id": row["listener_id"], "file": name}], schema=_WRITTEN_ARROW)

    return run


_ZIPS_PER_TASK = 1_000_000  # of a listener


def export_zips(records: DataFrame, path: str, history: str, plays_per_member: int = 1000, members_per_zip: int = 20) -> None:
    """Write the export records as zip archives ``<listener>-<number>.zip`` under ``path``, as the service hands them out.

    Members in the folder ``history`` hold one JSON array each; an archive has at most ``members_per_zip`` of them. Every
    fifth listener has a technical log too, every fifth an account export (other archives), every seventh a member that
    was cut off (archive number -1). Each task puts the records it has into archives: nothing is shuffled but the names
    of the archives, which are kept beside them. ``records`` are those of :func:`raw_records` or of :func:`raw_export`.
    """
    names = f"{path.rstrip('/')}-names"
    written = _listener_order(records).mapInArrow(_write_zips(path, history, plays_per_member, members_per_zip), _WRITTEN)
    with freed_shuffles(records.sparkSession):
        written.write.parquet(names)
    listeners = records.sparkSession.read.parquet(names).select("listener_id").distinct()
    who = F.col("listener_id")
    other = lambda when, number, member, value: F.when(when, F.struct(
        F.lit(number).alias("number"), F.lit(member).alias("member"), F.lit(value).alias("value")))
    others = F.array_compact(F.array(other(who % 7 == 0, -1, f"{history}/cut.json", '[{"ts": "2020-01-01T00:00:00Z", "ms_pl'),
                                     other(who % 5 == 3, -2, "MyData/share.json", "[]"), other(who % 5 == 4, -3, "MyData/Userdata.json", "{}")))
    rows = listeners.select("listener_id", F.explode(others).alias("other")).select("listener_id", "other.*")
    rows.mapInArrow(_write_others(path), _WRITTEN).write.format("noop").mode("overwrite").save()


def document_files(docs: DataFrame, path: str, id_col: str = "id", shown: str | None = None) -> None:
    """Write each document as a file ``<id>.json`` under ``path``, replacing one that is there (``shown``: its JSON column)."""
    body = F.col(shown) if shown else F.to_json(F.struct(*[c for c in docs.columns]))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                with archives.created(f"{path}/{name}.json") as out:
                    out.write(text.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([part.column(0)], names=["id"])

    # small files cost their number and not their bytes, by which a task would get them all
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body")).repartition(tasks, "id")
    rows.mapInArrow(write, "id string").write.format("noop").mode("overwrite").save()


def parse_export(records: DataFrame) -> DataFrame:
    """The JSON records parsed with the declared raw schema (as S1 does per file)."""
    return records.select("listener_id", F.from_json("json", schemas.RAW_PLAY).alias("r")).select(
        "listener_id", "r.*")


# ---------------------------------------------------------------------------
# entity documents


def _rows(raw: DataFrame, *columns: str) -> DataFrame:
    """The distinct rows of these columns: text cannot sit in a hash aggregate's buffer, so a maximum of it would sort the
    plays; as keys they are hash-aggregated, and a task sends a row per entity."""
    return raw.select(*columns).distinct()


def track_docs(raw: DataFrame) -> DataFrame:
    """One nested track document per track; artists divisible by 3 get a featured artist."""
    per = _rows(raw, "track_id", "track_name", "track_duration_ms", "album_id", "artist_id").groupBy("track_id").agg(
        F.max("track_name").alias("name"), F.max("track_duration_ms").alias("duration_ms"),
        F.max("album_id").alias("album_id"), F.max("artist_id").alias("artist_id"))
    size = F.col("duration_ms") / 6000
    a = F.col("artist_id")
    artists = F.when(a % 3 == 0, _ids(a, a + 1)).otherwise(_ids(a))
    return per.select(
        F.col("track_id").alias("id"), "name", "duration_ms",
        (size % 2 == 0).alias("explicit"), size.cast("int").alias("popularity"),
        F.lit(1).alias("track_number"), F.lit(1).alias("disc_number"),
        F.struct(F.col("album_id").alias("id"), _ids(a).alias("artists")).alias("album"),
        artists.alias("artists"),
    ).select(F.from_json(F.to_json(F.struct("*")), schemas.TRACK_DOC).alias("d")).select("d.*")


def _genre_parts(g: Column) -> tuple[Column, Column]:
    parts = F.split(g, ";")
    return parts.getItem(0), F.element_at(parts, 2)


# What documents of artists derive from.
ARTIST_COLUMNS = ["artist_id", "artist_name", "artist_genres", "artist_popularity", "wikidata_entity_id", "gender", "country", "website", "is_band"]


def artist_docs(raw: DataFrame) -> DataFrame:
    """One artist document per artist: the first genre comes from the API, images vary."""
    per = _rows(raw, "artist_id", "artist_name", "artist_genres", "artist_popularity").groupBy("artist_id").agg(
        F.max("artist_name").alias("name"), F.max("artist_genres").alias("g"),
        F.max("artist_popularity").alias("popularity"))
    api_genre, _ = _genre_parts(F.col("g"))
    a = F.col("artist_id")
    images = (F.when(a % 4 == 0, F.array().cast("array<struct<url:string>>"))
              .when(a % 4 == 1, F.array(F.struct(F.lit(None).cast("string").alias("url"))))
              .otherwise(F.array(F.struct(F.concat(F.lit("https://img.example/a"), a.cast("string"),
                                                   F.lit(".jpg")).alias("url")))))
    doc = F.struct(
        a.cast("string").alias("id"), F.col("name"),
        F.struct((F.col("popularity") * 1000).cast("int").alias("total")).alias("followers"),
        F.when(F.col("g") == "", F.array().cast("array<string>")).otherwise(F.array(api_genre)).alias("genres"),
        F.col("popularity").cast("int").alias("popularity"),
        images.alias("images"),
    )
    return per.select(F.from_json(F.to_json(doc), schemas.ARTIST_DOC).alias("d")).select("d.*")


def _binding(item: Column, prop: str, value: Column) -> Column:
    return F.struct(F.struct(item.alias("value")).alias("item"),
                    F.struct(F.lit(prop).alias("value")).alias("propLabel"),
                    F.struct(value.alias("value")).alias("valueLabel"))


def kg_docs(raw: DataFrame) -> DataFrame:
    """(artist_id, results) graph documents; artists without an entity id get ``{}``.

    Binding order plants the fold cases: an unknown "instance of" label after
    a known one, and a "country of origin" superseded by a later citizenship.
    """
    texts = ("wikidata_entity_id", "gender", "country", "website", "artist_genres")
    per = _rows(raw, "artist_id", *texts, "is_band").groupBy("artist_id").agg(
        *[F.max(c).alias(c) for c in texts],
        F.max(F.col("is_band").cast("int")).alias("is_band"))
    a = F.col("artist_id")
    item = F.concat(F.lit(GRAPH_ENTITY_PREFIX), F.col("wikidata_entity_id"))
    _, kg_genre = _genre_parts(F.col("artist_genres"))
    birth = F.when(a % 7 == 0, F.lit("unknown value")).otherwise(
        F.format_string("%04d-03-15T00:00:00Z", (F.lit(1900) + a % 80).cast("int")))
    kind = F.when(F.col("is_band") == 1, F.lit("musical group")).when(F.col("is_band") == 0, F.lit("human"))
    bindings = F.filter(F.array(
        _binding(item, "instance of", kind),
        _binding(item, "instance of", F.when(kind.isNotNull(), F.lit("album"))),
        _binding(item, "sex or gender", F.col("gender")),
        _binding(item, "Country of Origin", F.when(F.col("country").isNotNull(), F.lit("Atlantis"))),
        _binding(item, "country of citizenship", F.col("country")),
        _binding(item, "date of birth", birth),
        _binding(item, "official website", F.col("website")),
        _binding(item, "genre", kg_genre),
    ), lambda b: b["valueLabel"]["value"].isNotNull())
    results = F.when(F.col("wikidata_entity_id").isNotNull(), F.struct(bindings.alias("bindings")))
    doc = F.struct(results.alias("results"))
    return per.select(a.cast("string").alias("artist_id"),
                      F.from_json(F.to_json(doc), schemas.KG_DOC)["results"].alias("results"))


def album_docs(raw: DataFrame) -> DataFrame:
    """One album document per album; release dates in year / month / day precision,
    with the unknown date and a malformed one planted by artist id."""
    per = _rows(raw, "album_id", "album_name", "artist_id", "artist_name", "album_release_year", "track_id", "artist_popularity").groupBy("album_id").agg(
        F.max("album_name").alias("name"), F.max("artist_id").alias("artist_id"),
        F.max("artist_name").alias("artist_name"), F.max("album_release_year").alias("y"),
        F.array_sort(F.collect_set("track_id")).alias("tracks"),
        F.max("artist_popularity").alias("popularity"))
    a, y = F.col("artist_id"), F.col("y").cast("int")
    date = (F.when(a % 17 == 0, F.lit("1900-01-01")).when(a % 19 == 0, F.lit("n/a"))
            .when(y % 3 == 0, F.format_string("%04d", y)).when(y % 3 == 1, F.format_string("%04d-05", y))
            .otherwise(F.format_string("%04d-05-01", y)))
    precision = F.when(y % 3 == 0, "year").when(y % 3 == 1, "month").otherwise("day")
    doc = F.struct(
        F.col("album_id").alias("id"), F.col("name"), F.lit("album").alias("album_type"),
        F.concat(F.lit("label "), F.col("artist_name")).alias("label"),
        date.alias("release_date"), precision.alias("release_date_precision"),
        F.size("tracks").alias("total_tracks"), F.col("popularity").cast("int").alias("popularity"),
        _ids(a).alias("artists"),
        F.struct(F.transform("tracks", lambda t: F.struct(t.alias("id"))).alias("items")).alias("tracks"),
        F.array().cast(T.ArrayType(T.StructType([T.StructField("url", T.StringType())]))).alias("images"),
    )
    return per.select(F.from_json(F.to_json(doc), schemas.ALBUM_DOC).alias("d")).select("d.*")
