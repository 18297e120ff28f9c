"""S9 incrementally: per-entity JSON documents, one small file each, into one table that holds the last version of each.

An update reads the files that are new or replaced since the last one (tasks list the folder and open no other file)
and appends their documents, packed into few files, with the time of their file. When the table is read, the last version
of every id wins. Malformed files fail the update, or are listed beside the table. E1 takes its pending ids against the
table, so that the small files are read once.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.sources import files

CORRUPT = "_corrupt_record"
VERSION, FILE = "_version", "_file"
OVERLAP = dt.timedelta(seconds=1)  # file times of some stores are whole seconds; what is read twice is one version


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def _last_time(spark: SparkSession, out: str) -> dt.datetime | None:
    """The latest file time that an update has read."""
    times = [t.agg(F.max(VERSION).cast("timestamp_ntz")).first()[0] for p in ("docs", "rejected")
             if (t := _table(spark, f"{out}/{p}")) is not None]
    return max((t for t in times if t is not None), default=None)


def _read_by_spark(spark: SparkSession, src: str, schema: T.StructType, after: dt.datetime | None, skip: bool) -> DataFrame:
    """The documents with :data:`CORRUPT` (null unless ``skip``), version and file; Spark lists ``src`` on the driver."""
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = (spark.read.schema(whole if skip else schema).option("multiLine", True).option("pathGlobFilter", "*.json")
              .option("recursiveFileLookup", True).option("mode", "PERMISSIVE" if skip else "FAILFAST")
              .option("columnNameOfCorruptRecord", CORRUPT))
    if after is not None:
        reader = reader.option("modifiedAfter", after.strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    corrupt = F.col(CORRUPT) if skip else F.lit(None).cast("string").alias(CORRUPT)
    return reader.json(src).select(*schema.fieldNames(), corrupt, F.col("_metadata.file_modification_time").alias(VERSION),
                                   F.col("_metadata.file_path").alias(FILE))


def _read_by_tasks(spark: SparkSession, src: str, schema: T.StructType, after: dt.datetime | None, skip: bool) -> DataFrame:
    """The same rows; the files are listed and read by tasks. A file holds a document or an array of documents, which is
    malformed as a whole if one of them is."""
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    millis = None if after is None else int(after.replace(microsecond=0, tzinfo=dt.timezone.utc).timestamp() * 1000)
    found = files.texts(spark, src, ".json", millis).where(F.col("content").rlike(r"\S"))  # a blank file holds no document
    text = F.col("content")
    each = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    one = lambda t: F.from_json(t, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    docs = found.select("*", F.transform(each, one).alias("docs"))
    bad = F.col("docs").isNull() | F.exists("docs", lambda d: d.isNull() | d[CORRUPT].isNotNull())
    # a malformed file is one row
    rows = docs.select(F.col("modified").alias(VERSION), F.col("path").alias(FILE), F.when(bad, text).alias("_bad"),
                       F.explode(F.when(bad, F.array(F.lit(None).cast(whole))).otherwise(F.col("docs"))).alias("d"))
    corrupt = F.col("_bad") if skip else F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("malformed document: "), FILE)).cast("string"))
    return rows.select(*[F.col("d")[c].alias(c) for c in schema.fieldNames()], corrupt.alias(CORRUPT), VERSION, FILE)


def update(spark: SparkSession, src: str, out: str, schema: T.StructType, id_from_name: str | None = None,
           malformed: str = "fail", since: dt.datetime | None = None, ranged: bool = True) -> None:
    """Append the documents of files under ``src`` that changed since the last update (``since``: since that time, UTC).

    ``id_from_name``: a column for the file's name without ``.json`` (knowledge-graph documents carry no id).
    ``malformed="skip"`` lists such files in :func:`rejected`. An update that fails and runs again adds nothing wrong:
    a version that is there twice is still one version. Tasks list and read the files, and the driver holds none of
    their names (``sources.files``); ``ranged=False``, a glob or a store that only Spark's own readers reach leave both to
    these.
    """
    skip = malformed == "skip"
    last = since or _last_time(spark, out)
    read = _read_by_tasks if ranged and files.by_tasks(spark, src) else _read_by_spark
    docs = read(spark, src, schema, None if last is None else last - OVERLAP, skip)
    stem = F.regexp_extract(FILE, r"([^/]*)\.json$", 1)
    docs = docs.select(*([stem.alias(id_from_name)] if id_from_name else []), "*")
    part = uuid.uuid4().hex
    if not skip:
        # the column of what is malformed is asked for, so that it fails
        docs.where(F.col(CORRUPT).isNull()).drop(CORRUPT).hint("rebalance").write.parquet(f"{out}/docs/{part}")
        return
    docs = docs.persist()  # the files are read once
    try:
        docs.where(F.col(CORRUPT).isNotNull()).select(VERSION, FILE).coalesce(1).write.parquet(f"{out}/rejected/{part}")
        docs.where(F.col(CORRUPT).isNull()).drop(CORRUPT).hint("rebalance").write.parquet(f"{out}/docs/{part}")
    finally:
        docs.unpersist()


def documents(spark: SparkSession, out: str, id_col: str = "id") -> DataFrame:
    """The last version of every document (by file time, then path); documents without an id are left out."""
    rows = _table(spark, f"{out}/docs").where(F.col(id_col).isNotNull())
    columns = [c for c in rows.columns if c not in (VERSION, FILE)]
    rest = F.struct(*[c for c in columns if c != id_col])
    last = rows.groupBy(id_col).agg(F.max_by(rest, F.struct(VERSION, FILE)).alias("d"))
    return last.select(id_col, "d.*").select(*columns)


def rejected(spark: SparkSession, out: str) -> DataFrame:
    """``path, reason`` of malformed files that no well-formed version has replaced."""
    bad = _table(spark, f"{out}/rejected").groupBy(FILE).agg(F.max(VERSION).alias("bad"))
    good = _table(spark, f"{out}/docs").groupBy(FILE).agg(F.max(VERSION).alias("good"))
    left = bad.join(good, FILE, "left").where("good is null or good < bad")
    return left.select(F.col(FILE).alias("path"), F.lit("malformed document").alias("reason"))
