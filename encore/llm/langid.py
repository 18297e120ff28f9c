"""Language identification by compression.

One zstandard raw-content dictionary per language is filled from a bounded
sample of labelled texts. A text is cut into blocks, every block is compressed
once with each dictionary, and the language whose blocks come out smallest
overall wins. The margin is the share that the winner saves against the second;
a narrow margin rejects the answer.

The sample is bounded: of the ``sample_docs`` texts per language that come first
in hash order, whatever their length, the first ``sample_chars`` characters, up
to ``dict_bytes``. Beyond ``max_languages`` languages both shrink in proportion,
so that all dictionaries together keep their bound.
The whole text of every document is classified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.llm import common

SAMPLE_DOCS = 64
SAMPLE_CHARS = 4000
DICT_BYTES = 65_536
MAX_LANGUAGES = 128
BLOCK_BYTES = 4096
LEVEL = 5
NARROW = 0.01  # smallest margin that is not rejected
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_REST = re.compile(r"[\W\d_]+")
_OUT = "row_id bigint, lang string, margin double, rejected boolean"
_OUT_ARROW = pa.schema([("row_id", pa.int64()), ("lang", pa.string()), ("margin", pa.float64()), ("rejected", pa.bool_())])


def letters(text: str) -> bytes:
    """Lower-cased letters in UTF-8, every run of other characters as one space."""
    return _REST.sub(" ", text.lower()).encode("utf-8")


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES,
          max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """Dictionary content by language. Rows without a language or text are left out.

    A text of any length can be chosen; its first ``sample_chars`` characters are used. About ``max_languages *
    sample_docs`` such parts reach the driver: with more languages than that each has fewer texts and a smaller dictionary.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                           F.col(lang_col).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("text", F.substring("text", 1, sample_chars))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    if len(sizes) > max_languages:
        sample_docs = max(1, sample_docs * max_languages // len(sizes))
        dict_bytes = max(256, dict_bytes * max_languages // len(sizes))
    # a share of each language's hash range that holds about four samples, so that no task ranks a whole language
    share = rows.sparkSession.createDataFrame([(lang, min(1.0, 4.0 * sample_docs / n + 64.0 / n)) for lang, n in sizes.items()],
                                              "lang string, share double")  # a row per language
    hashed = rows.withColumn("h", F.xxhash64("id")).join(F.broadcast(share), "lang").where(
        F.pmod("h", F.lit(1 << 30)) < F.col("share") * F.lit(float(1 << 30)))
    first = Window.partitionBy("lang").orderBy("h", "id", "text")
    picked = hashed.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample_docs).select("lang", "place", "text")
    out: dict[str, bytes] = {}
    for row in sorted(picked.collect(), key=lambda r: (r["lang"], r["place"])):
        out[row["lang"]] = out.get(row["lang"], b"") + letters(row["text"]) + b" "
    return {lang: content[:dict_bytes] for lang, content in out.items()}


class Classifier:
    """Compressors with one dictionary per language."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL, block: int = BLOCK_BYTES):
        self.block = block
        self.compressors = {}
        for lang, content in sorted(contents.items()):
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=level)
            self.compressors[lang] = zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_dict_id=False)

    def classify(self, text: str | None) -> tuple[str, float]:
        """The language with the smallest code (first in order on a tie) and its margin; no letters: unknown, 0."""
        if not self.compressors or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        data = letters(text)
        blocks = [data[i:i + self.block] for i in range(0, len(data), self.block)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.compressors.items())
        best = sizes[0][0]
        return sizes[0][1], 1.0 if len(sizes) == 1 else 1.0 - best / sizes[1][0]


def _classify(contents: dict[str, bytes], narrow: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(contents)

        def rows():
            for part in parts:
                for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    lang, margin = model.classify(text)
                    yield row, lang, margin, margin < narrow

        yield from common.batches(rows(), _OUT_ARROW)

    return run


def identify(docs: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
             narrow: float = NARROW) -> DataFrame:
    """One row per input row: ``row_id, lang, margin, rejected``.

    * ``lang`` is the best learned language even where a narrow margin rejects it (``rejected``); it is ``und`` with
      margin 0, rejected, where the text is null, has no letter, or nothing was learned.
    * Only the id and the text are read; rows that repeat come back as often, a null id as null.
    """
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_classify(contents, narrow), _OUT)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    contents = learn(docs.where(~held_out()))
    found = identify(docs, contents)
    return found.select(F.col("row_id").alias("doc_id"), held_out("row_id").alias("held_out"), F.col("lang").alias("lang_pred"),
                        F.col("margin").alias("score"), "rejected")
