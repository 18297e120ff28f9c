"""Vector code compression: product quantisation trained by Lloyd rounds over resident members.

A vector's integer components are cut into equal consecutive parts; each part position has a codebook of entries. The
members of a codebook entry are the parts assigned to it. They live in a written table that is dealt by
``(position, entry, salt)``: one owner per such key holds its members, and the salt splits a hot entry. In a round the
owners add up their members (one row of sums per key leaves the task), the codebooks are replaced, and every owner
assigns its members anew. A part that keeps its entry stays with its owner and is written without a shuffle; only parts
that change entry go through the next shuffle to their new owners. Equal parts of one batch are one member with a weight.

The codebooks (positions x entries x part length, fixed by the parameters) are the only thing that reaches the driver.
The final assignment needs no members: it reads the vectors once more and emits a row per vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm import common

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
SALT_MEMBERS = 65_536  # members of one owner of an entry that holds all vectors
LABEL_SALTS = 64
EXACT = 2.0 ** 53  # doubles below hold every integer

_MEMBERS = "position int, entry int, salt bigint, part array<bigint>, weight bigint"
_MEMBERS_ARROW = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("salt", pa.int64()),
                            ("part", pa.list_(pa.int64())), ("weight", pa.int64())])
_MOVED = _MEMBERS + ", moved boolean"
_MOVED_ARROW = _MEMBERS_ARROW.append(pa.field("moved", pa.bool_()))


@dataclass(frozen=True)
class Codebooks:
    """Per part position an array of (entries, part length) integers."""

    books: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        """Digest of all components in order of part, entry and position within the part, as decimals joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()


def nearest(book: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest on a tie) and its squared distance, in exact integers.

    Distances are taken in doubles while those hold every integer that can occur, else in Python's integers.
    """
    if len(parts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    high = max(1, int(max(int(book.max(initial=0)), -int(book.min(initial=0)), int(parts.max(initial=0)), -int(parts.min(initial=0)))))
    if 4.0 * high * high * max(1, book.shape[1]) < EXACT:
        b, p = book.astype(np.float64), parts.astype(np.float64)
        far = (p * p).sum(axis=1)[:, None] - 2.0 * (p @ b.T) + (b * b).sum(axis=1)[None, :]
        best = far.argmin(axis=1)
        return best, far[np.arange(len(p)), best].astype(np.int64)
    b, p = book.astype(object), parts.astype(object)
    best, least = np.zeros(len(p), np.int64), None
    for i in range(len(b)):
        far = ((p - b[i]) ** 2).sum(axis=1)
        closer = np.zeros(len(p), bool) if least is not None else np.ones(len(p), bool)
        if least is not None:
            closer = np.array([x < y for x, y in zip(far, least, strict=True)])
        best[closer] = i
        least = far if least is None else np.where(closer, far, least)
    return best, np.array([int(x) for x in least], dtype=np.int64)


def whole_numbers(column: pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * component), all of one length, as int64; larger numbers raise an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(flat * scale)
    if len(out) and np.abs(out).max() >= 2.0 ** 62:
        raise ValueError("a component times the scale does not fit 62 bits")
    return out.astype(np.int64).reshape(len(column), -1)


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c
                                       for c, f in zip(columns, schema, strict=True)], schema=schema)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _first_owners(books: Codebooks, scale: int, salts: int):
    """Vectors → weighted members with their first entry."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = 0
        for part in parts:
            vectors = whole_numbers(part.column(0), scale)
            width = vectors.shape[1] // len(books.books)
            for position, book in enumerate(books.books):
                cut, weight = np.unique(vectors[:, position * width:(position + 1) * width], axis=0, return_counts=True)
                entry, _ = nearest(book, cut)
                salt = (dealt + np.arange(len(cut))) * 2654435761 % salts
                yield _batch([np.full(len(cut), position, np.int32), entry.astype(np.int32), salt, _lists(cut), weight], _MEMBERS_ARROW)
            dealt += len(vectors)

    return run


def _assigned(books: Codebooks):
    """Members under new codebooks, with a mark for those that change entry."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            position, entry = part.column(0).to_numpy(), part.column(1).to_numpy()
            rows = part.column(3).flatten().to_numpy().reshape(part.num_rows, -1)
            new = entry.copy()
            for p in np.unique(position):
                at = position == p
                new[at] = nearest(books.books[p], rows[at])[0]
            yield _batch([part.column(0), pa.array(new.astype(np.int32)), part.column(2), part.column(3), part.column(4),
                          pa.array(new != entry)], _MOVED_ARROW)

    return run


def _encoded(books: Codebooks, scale: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for part in parts:
            vectors = whole_numbers(part.column(2), scale)
            width = vectors.shape[1] // len(books.books)
            error = np.zeros(len(vectors), dtype=object)
            code = np.zeros((len(vectors), len(books.books)), dtype=np.int64)
            for position, book in enumerate(books.books):
                best, far = nearest(book, vectors[:, position * width:(position + 1) * width])
                code[:, position] = best
                error = error + far
            schema = schema or pa.schema([part.schema.field(0), part.schema.field(1), ("code", pa.string()), ("error", pa.int64())])
            yield _batch([part.column(0), part.column(1), ["".join(f"{e:02x}" for e in row) for row in code.tolist()],
                          [int(e) for e in error]], schema)

    return run


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, vector`` of the rows whose vector has components, all of them finite numbers."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector")).where(
        F.col("vector").isNotNull() & (F.size("vector") > 0)).where(finite)


def _seeds(rows: DataFrame, parts: int, entries: int, scale: int) -> tuple[Codebooks, int] | None:
    """Codebooks of the ``entries`` smallest ids (a repeated id gives its smallest vector), and the number of rows."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).collect()[0]
    if not facts["n"]:
        return None
    if facts["low"] != facts["high"] or facts["low"] % parts:
        raise ValueError(f"vectors must share one length divisible by {parts}: found {facts['low']} to {facts['high']}")
    ids = [r["id"] for r in rows.select("id").where("id is not null").distinct().orderBy("id").limit(entries).collect()]
    first = rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").collect()
    if not first:  # only null ids: the smallest vectors
        first = rows.select("vector").distinct().orderBy("vector").limit(entries).collect()
    whole = whole_numbers(pa.array([r["vector"] for r in first], type=pa.list_(pa.float64())), scale)
    return Codebooks(tuple(np.split(whole, parts, axis=1))), facts["n"]


def _means(members: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks with every used entry replaced by the floor of its members' mean; unused ones stay.

    The members of a key are together in one task, so the partial sums that leave it are one row per key.
    """
    width = books.books[0].shape[1]
    total = lambda i: F.sum(F.element_at("part", i + 1).cast("decimal(20,0)") * F.col("weight")).cast("decimal(38,0)")
    sums = members.groupBy("position", "entry").agg(F.sum("weight").alias("n"), *[total(i).alias(f"s{i}") for i in range(width)]).collect()
    new = [book.copy() for book in books.books]
    for row in sums:
        new[row["position"]][row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return Codebooks(tuple(new))


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after ``rounds`` Lloyd rounds; None without a whole vector. See :func:`compress` for odd rows."""
    common.bound_batches(vectors.sparkSession)
    rows = whole_vectors(vectors, id_col, vector_col, id_col)
    begun = _seeds(rows, parts, entries, scale)
    if begun is None:
        return None
    books, n = begun
    owner = ["position", "entry", "salt"]
    if rounds > 0:
        salts = max(8, -(-n // SALT_MEMBERS))
        members = rows.select("vector").mapInArrow(_first_owners(books, scale, salts), _MEMBERS)
        resident = common.written(members.repartition(*owner), "lloyd-members")
        books = _means(resident, books)
    for _ in range(1, rounds):
        assigned = common.written_by(resident.mapInArrow(_assigned(books), _MOVED), "lloyd-assigned", "moved")
        arrived = common.written(assigned.where("moved").drop("moved").repartition(*owner), "lloyd-moved")
        resident = assigned.where("not moved").drop("moved").union(arrived)
        books = _means(resident, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``id, label, code, error`` per row with a whole vector, by the given codebooks; one pass, no shuffle."""
    rows = whole_vectors(vectors, id_col, vector_col, label_col)
    types = dict(rows.dtypes)
    return rows.mapInArrow(_encoded(books, scale), f"id {types['id']}, label {types['label']}, code string, error bigint")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per row with a whole vector: ``id, label, code, error, label_error, codebooks_sha256``.

    * Rows whose vector is null or empty or holds a null or non-finite component are left out.
    * Vectors must have one length, a multiple of ``parts``; anything else raises an error, as does a number over 62 bits.
    * Rows that repeat, share an id or have a null id count and come back as often. A null id gives no first codebook
      entry while there are others; a repeated id gives its smallest vector.
    * Fewer ids than ``entries`` give smaller codebooks. ``label_error`` sums over equal labels, null ones together.
    * Ties go to the lower entry. Columns other than the three named are not read.
    """
    books = train(vectors, id_col, vector_col, parts, entries, rounds, scale)
    if books is None:
        empty = whole_vectors(vectors, id_col, vector_col, label_col).where("false")
        return empty.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
                            F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = common.written(encode(vectors, books, id_col, vector_col, label_col, scale), "vector-codes")
    # a label may hold most rows: its sum is repeated for every salt, and the rows are dealt over the salts by their code
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    salt: Column = F.pmod(F.xxhash64("id", "code"), F.lit(LABEL_SALTS))
    right = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
    left = coded.withColumn("salt", salt).alias("a")
    joined = left.join(right.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")) & (F.col("a.salt") == F.col("b.salt")))
    return joined.select("a.id", "a.label", "a.code", "a.error", "b.label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    found = compress(common.table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """Parts as rows, entries as rows; two rounds of nearest entries and floored means."""
    far = "list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    best = lambda books: f"""(SELECT rid, pos, e, far FROM (  -- the nearest entry of every part
      SELECT p.rid, p.pos, b.e, {far} AS far, row_number() OVER (PARTITION BY p.rid, p.pos ORDER BY {far}, b.e) AS rn
      FROM parts p JOIN {books} b USING (pos)) WHERE rn = 1)"""  # noqa: E731
    floor = "((s - ((s % n) + n) % n) // n)"

    def means(old: str) -> str:
        return f"""(
      SELECT b.pos, b.e, coalesce(m.part, b.part) AS part FROM {old} b LEFT JOIN (
        SELECT pos, e, list({floor} ORDER BY j) AS part FROM (
          SELECT a.pos, a.e, x.j, sum(x.v)::BIGINT AS s, count(*) AS n FROM {best(old)} a JOIN flat x USING (rid, pos) GROUP BY ALL)
        GROUP BY pos, e) m ON b.pos = m.pos AND b.e = m.e)"""

    return f"""
WITH whole AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT rid, pos, v[pos * (len(v) // {PARTS}) + 1:(pos + 1) * (len(v) // {PARTS})] AS part
  FROM whole, (SELECT unnest(range({PARTS})) AS pos)),
flat AS MATERIALIZED (SELECT rid, pos, unnest(range(1, len(part) + 1)) AS j, unnest(part) AS v FROM parts),
seeds AS (
  SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM (
    SELECT rid, vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS rn FROM whole WHERE vec_id IS NOT NULL)
  WHERE rn = 1 ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS MATERIALIZED (SELECT pos, e, part FROM parts JOIN seeds USING (rid)),
b1 AS MATERIALIZED {means("b0")},
b2 AS MATERIALIZED {means("b1")},
coded AS (
  SELECT rid, string_agg(printf('%02x', e), '' ORDER BY pos) AS code, sum(far)::BIGINT AS error FROM {best("b2")} GROUP BY rid),
sha AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, e)) AS s FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
FROM coded JOIN whole USING (rid), sha
"""


ORACLE_SQL = _oracle()
