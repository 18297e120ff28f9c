"""Play-log sources.

* ``read_history`` (S1/S2): every ``*.json`` file of a folder (or glob) as one
  table; each file is a JSON array of play objects read with a declared schema.
  Files are split across tasks by Spark; nothing is concatenated on the driver.
* ``ingest_archives`` (S3): export zips → one row per JSON member, each read by
  itself (``sources.archives``) → ``from_json`` with the declared schema →
  exploded plays.
* ``classify_archives`` (S4): which archives are the wrong export kind.
* ``read_csv`` (S7): the cleaned fact re-read with ``ts`` as text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore import schemas
from encore.sources import archives

# Folder of the play history inside an export archive, and the
# member names that reveal a different export kind.
HISTORY_FOLDER = "Spotify Extended Streaming History"
TECHNICAL_LOG_MEMBERS = ["MyData/share.json", "MyData/AddedToCollection.json", "MyData/Download_Hourly.json"]
ACCOUNT_DATA_MEMBERS = ["MyData/YourLibrary.json", "MyData/Userdata.json"]


CORRUPT = "_corrupt_record"


def _listener(listener: str | None, path: F.Column) -> list[F.Column]:
    """``listener`` is a regular expression over the path whose first group is the listener; none gives no column."""
    return [] if listener is None else [F.regexp_extract(path, listener, 1).alias("listener_id")]


def read_history(spark: SparkSession, path: str, schema: T.StructType = schemas.RAW_PLAY, listener: str | None = None,
                 malformed: str = "fail", glob: str = "*.json") -> DataFrame:
    """All JSON-array files under ``path`` → raw play rows.

    ``malformed="fail"``: a file that is not a JSON array of plays fails the job. ``"skip"`` leaves it out; then
    :func:`rejected_files` lists it. ``listener``: regular expression over the file's path, group 1 is ``listener_id``.
    """
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", glob)
    if malformed == "fail":
        rows = reader.schema(schema).option("mode", "FAILFAST").json(path)
        return rows.select(*_listener(listener, F.col("_metadata.file_path")), *schema.fieldNames())
    rows = reader.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT).json(path)
    good = rows.where(F.col(CORRUPT).isNull())
    return good.select(*_listener(listener, F.col("_metadata.file_path")), *schema.fieldNames())


def rejected_files(spark: SparkSession, path: str, schema: T.StructType = schemas.RAW_PLAY, glob: str = "*.json") -> DataFrame:
    """The files that ``read_history(malformed="skip")`` leaves out: ``path, reason``."""
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = (spark.read.schema(whole).option("multiLine", True).option("pathGlobFilter", glob).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path).select("*", F.col("_metadata.file_path").alias("path")))
    # Spark reads the corrupt record only beside another column; this condition is true for every value of it
    beside = F.col(schema.fieldNames()[0])
    return rows.where(F.col(CORRUPT).isNotNull() & (beside.isNull() | beside.isNotNull() & (F.hash(beside) > F.lit(-(2 ** 31) - 1)))).select("path", F.lit("not a JSON array of plays").alias("reason")).distinct()


def archive_members(spark: SparkSession, path: str, history_only: bool = False, ranged: bool = True) -> DataFrame:
    """One row per JSON member of every zip under ``path`` (archive, member, content), read by itself.

    ``history_only`` keeps members under the history folder (the CLI's rule); otherwise every ``.json`` (the
    website's). Members are chosen from the archives' directories before any is read (``sources.archives``).
    """
    wanted = (re.escape(HISTORY_FOLDER) + r".*\.json$") if history_only else r"\.json$"
    return archives.contents(spark, path, wanted, ranged)


def _parse_members(members: DataFrame, mode: str) -> DataFrame:
    parsed = F.from_json(F.col("content"), T.ArrayType(schemas.RAW_PLAY), {"mode": mode})
    return members.select("archive", "member", parsed.alias("plays"))


def ingest_archives(spark: SparkSession, path: str, history_only: bool = True, listener: str | None = r"([^/]+)\.zip$",
                    malformed: str = "fail", ranged: bool = True) -> DataFrame:
    """S3: play rows of every archive, with ``archive``, ``member`` and ``listener_id``.

    An archive is one listener's export: ``listener_id`` is the archive's name, or group 1 of another regular
    expression over its path (``None``: no such column). ``malformed="fail"``: a member that is not a JSON array of
    plays fails the job; ``"skip"`` leaves it out, and :func:`rejected_members` lists it.
    """
    mode = "FAILFAST" if malformed == "fail" else "PERMISSIVE"
    members = _parse_members(archive_members(spark, path, history_only, ranged), mode)
    return members.select(*_listener(listener, F.col("archive")), "archive", "member", F.explode("plays").alias("p")).select(
        *(["listener_id"] if listener is not None else []), "archive", "member", "p.*")


def rejected_members(spark: SparkSession, path: str, history_only: bool = True) -> DataFrame:
    """The members that ``ingest_archives(malformed="skip")`` leaves out: ``archive, member, reason``."""
    members = _parse_members(archive_members(spark, path, history_only), "PERMISSIVE")
    return members.where(F.col("plays").isNull()).select("archive", "member", F.lit("not a JSON array of plays").alias("reason"))


def archive_manifest(spark: SparkSession, path: str, ranged: bool = True) -> DataFrame:
    """(archive, member) of every zip under ``path``, from the archives' directories: no member is unpacked, and only the
    end of each archive is read."""
    return archives.manifest(spark, path, ranged).select("archive", "member")


def classify_archives(members: DataFrame) -> DataFrame:
    """Per archive its kind — ``technical_log``, ``account_data`` or ``streaming_history`` (from its manifest)."""
    m = F.col("member")
    return members.groupBy("archive").agg(
        F.bool_or(m.isin(TECHNICAL_LOG_MEMBERS)).alias("_tech"),
        F.bool_or(m.isin(ACCOUNT_DATA_MEMBERS)).alias("_account"),
    ).select(
        "archive",
        F.when(F.col("_tech"), "technical_log").when(F.col("_account"), "account_data")
        .otherwise("streaming_history").alias("kind"),
    )


# One CSV dialect for writing and reading: RFC 4180 quotes, text kept to the last space, null told from empty.
CSV_OPTIONS = {
    "header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "escape": '"', "quote": '"', "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "\\N",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.PLAY_CSV) -> DataFrame:
    """S7 (read): the cleaned fact exported as CSV, ``ts`` as ``yyyy-MM-dd HH:mm:ss``; a malformed record fails."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).option("mode", "FAILFAST").csv(path)
