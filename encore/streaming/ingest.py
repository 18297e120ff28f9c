"""Incremental ingest: the S1/S2 + P1–P15 cleaning as a Structured Streaming job.

The reference processes a finished export in one batch. When exports of many
listeners keep arriving as files, the same cleaning runs incrementally:
``readStream`` over the drop folder → the row-wise P-operators → the dedup (P3)
→ one folder per micro-batch of a parquet fact.

The dedup has no time window, so the result is that of the batch ingest however
the files are split over triggers. Its index is the query's own state: every
stored play's key, the first 128 bits of the SHA-256 of its whole raw record and
its listener (of 10^12 plays, two differ and share one with a chance of about
10^-15), sits in a RocksDB state store that is partitioned by key hash and
checkpointed under the shared ``spark.checkpoint.dir``. A micro-batch looks up
its own keys only; what it reads does not grow with the fact. Keys cannot be
compressed and each is shuffled, kept in the state, checkpointed and stored, so
their length counts. Checkpoints with the whole SHA-256 cannot be continued
(Spark refuses them); a new one goes on with what they stored.

A run is a checkpoint. Each writes under ``run_id=<id of its query>`` and a batch
that runs again after a failure replaces its own folder, so no run overwrites
another's plays. A new checkpoint starts with empty state: it drops the plays
that other runs stored by a join with their keys, of which it reads the time
range of the batch (a play and its copy have the same time).
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from encore import schemas
from encore.functions import exprs as X
from encore.operators import clean
from encore.session import checkpoint_dir

RUN, BATCH = "run_id", "batch_id"
KEY_BYTES = 16
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_history_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100, multi_line: bool = True,
                        listener: str | None = None, glob: str = "*.json") -> DataFrame:
    """Streaming S1/S2: new files (``glob``) under ``path`` (folders in it included) — JSON arrays of plays
    (``multi_line``, the export format) or one play object per line. A malformed file fails the query.

    ``listener``: a regular expression over the file's path whose first group is ``listener_id``; none gives null.
    """
    rows = (
        spark.readStream.schema(schemas.RAW_PLAY).option("multiLine", multi_line).option("mode", "FAILFAST")
        .option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files_per_trigger).json(path)
    )
    who = F.lit(None).cast("string") if listener is None else F.regexp_extract(F.col("_metadata.file_path"), listener, 1)
    return rows.select(who.alias("listener_id"), *schemas.RAW_PLAY.fieldNames())


def keyed_plays(raw: DataFrame) -> DataFrame:
    """Cleaned plays with ``listener_id`` and the key of their raw record; copies still there."""
    flagged = clean.fill_flags(raw)
    record = F.to_json(F.struct(*raw.columns), {"ignoreNullFields": "false"})
    key = F.unhex(F.substring(F.sha2(record, 256), 1, 2 * KEY_BYTES))
    rows = clean.clean_rows(flagged.withColumn("play_key", key))
    return rows.select("play_key", "listener_id", *clean.PLAY_COLUMNS)


def first_of_keys(keyed: DataFrame) -> DataFrame:
    """One play of each key, whichever; on a stream, of all batches. The key goes as two numbers and the texts as one."""
    texts = X.text_columns(keyed)
    half = lambda n: F.conv(F.hex(F.substring("play_key", n, 8)), 16, -10).cast("bigint")
    packed = X.pack_texts(keyed, texts).withColumns({"_key_1": half(1), "_key_2": half(9)}).drop("play_key")
    first = packed.dropDuplicates(["_key_1", "_key_2"])
    whole = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("_key_1", "_key_2")]))
    return X.unpack_texts(first.withColumn("play_key", whole), texts, keyed.columns)


def _stored_schema(spark: SparkSession):
    empty = spark.createDataFrame([], schemas.RAW_PLAY).withColumn("listener_id", F.lit(None).cast("string"))
    return keyed_plays(empty).select("*", F.lit("").alias(RUN), F.lit(0).cast("long").alias(BATCH)).schema


def stored(spark: SparkSession, out: str) -> DataFrame:
    """The fact that the ingest wrote under ``out``, with ``play_key``, run and batch."""
    return spark.read.schema(_stored_schema(spark)).option("basePath", out).parquet(out)


def other_runs(spark: SparkSession, out: str, run: str) -> DataFrame | None:
    """What other checkpoints stored under ``out``; None if there is nothing."""
    try:
        fact = stored(spark, out).where(F.col(RUN) != run)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return fact if fact.limit(1).count() else None


def _write(plays: DataFrame, path: str) -> None:
    plays.write.mode("overwrite").option("compression", "zstd").parquet(path)


def store_batch(fresh: DataFrame, batch_id: int, out: str, run: str, others: DataFrame | None = None) -> None:
    """Write the plays of one micro-batch that no run has stored; a batch that runs again replaces its folder.

    ``fresh`` holds no copy of a play of this run; ``others`` are the plays of other runs.
    """
    path = f"{out}/{RUN}={run}/{BATCH}={batch_id}"
    if others is None:
        _write(fresh, path)
        return
    fresh = fresh.persist()  # read twice; the state behind it is not
    try:
        first, last = fresh.agg(F.min("ts"), F.max("ts")).first()
        seen = others.where(F.col("ts").isNull() | F.col("ts").between(first, last)) if first is not None else others
        # what was stored with longer keys counts by their beginning
        _write(fresh.join(seen.select(F.substring("play_key", 1, KEY_BYTES).alias("play_key")), "play_key", "left_anti"), path)
    finally:
        fresh.unpersist()


def start_ingest(
    spark: SparkSession, src: str, out: str, checkpoint: str | None = None, available_now: bool = True,
    processing_time: str = "1 minute", multi_line: bool = True, max_files_per_trigger: int = 100, listener: str | None = None,
    glob: str = "*.json",
) -> StreamingQuery:
    """Start the incremental ingest; ``available_now`` drains what is there and stops."""
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "ingest-" + os.path.basename(out.rstrip("/")))
    fresh = first_of_keys(keyed_plays(read_history_stream(spark, src, max_files_per_trigger, multi_line, listener, glob)))
    known: dict[str, object] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        if not known:  # once per start: the query's id, and whether other runs wrote here
            run = spark.read.json(f"{ckpt}/metadata").first()["id"]
            known.update(run=run, others=other_runs(spark, out, run))
        store_batch(batch, batch_id, out, known["run"], known["others"])

    writer = fresh.writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    key, provider = STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)  # a query takes the settings of its start
    try:
        return writer.start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
