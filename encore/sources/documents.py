"""Per-entity JSON documents (one file per id) read with declared schemas.

The knowledge-graph documents carry no artist id inside; it is the file
stem, taken from Spark's hidden ``_metadata.file_name`` column. An empty
document (``{}``) reads as a row whose ``results`` is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore import schemas


def read_docs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents under ``path``; a malformed one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def read_track_docs(spark: SparkSession, path: str) -> DataFrame:
    return read_docs(spark, path, schemas.TRACK_DOC)


def read_artist_docs(spark: SparkSession, path: str) -> DataFrame:
    return read_docs(spark, path, schemas.ARTIST_DOC)


def read_album_docs(spark: SparkSession, path: str) -> DataFrame:
    return read_docs(spark, path, schemas.ALBUM_DOC)


def read_kg_docs(spark: SparkSession, path: str) -> DataFrame:
    """Graph documents with ``artist_id`` = file stem."""
    df = read_docs(spark, path, schemas.KG_DOC)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return df.select(stem.alias("artist_id"), "results")
