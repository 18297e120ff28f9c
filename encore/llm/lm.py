"""Language-model scores by stupid backoff over count tables of the whole corpus.

A word's score is the count of its longest n-gram that was seen ``min_count``
times or more, over the count of that n-gram's context, times ``backoff`` for
every order it fell short; at the end of the ladder stands the word's share of
all words. A document's score is the sum of the logarithms.

Documents are dealt into blocks of about ``block_bytes`` of text (so their
number grows with the input). A block is exploded to one row per distinct
n-gram, ``(part, gram, block, n)``, so an n-gram that a third of all words make
up is one row per block. The rows are partitioned by ``part``, a range of the
n-gram's hash of which there are about as many per block at any size. There the
counts of all blocks are summed and joined to every row that asked: the sum of
a window over the n-gram, which shuffles the rows once where an aggregate
joined back would shuffle them twice. What comes back to a block has no hashes:
a row per part holds the sums in the order of the hashes, which the block knows
from its own texts, a byte for each sum under 255. The block sums per document.
A task takes its block's texts a batch at a time and keeps 8 bytes per word and
order of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.llm import common

ORDER = 2
BACKOFF = 0.4
MIN_COUNT = 2  # an n-gram seen once was seen in the scored text only
BLOCK_BYTES = 16 << 20

_ALL_WORDS = np.uint64(0)  # the entry that counts all words
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

PARTS = 4  # ranges of hashes per block, or up to twice as many
_LARGE = 255  # sums from here on are listed by themselves

_ASK = "part int, gram bigint, block int, n bigint"
_ASK_ARROW = pa.schema([("part", pa.int32()), ("gram", pa.int64()), ("block", pa.int32()), ("n", pa.int64())])
_ANSWER = "block int, part int, small binary, large array<bigint>"
_ANSWER_ARROW = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("small", pa.binary()), ("large", pa.list_(pa.int64()))])
_ASK_ROWS = 1 << 16  # in an Arrow batch
_SCORE = "row_id bigint, n_words bigint, n_backoff bigint, log_prob double"
_SCORE_ARROW = pa.schema([("row_id", pa.int64()), ("n_words", pa.int64()), ("n_backoff", pa.int64()), ("log_prob", pa.float64())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(grams: np.ndarray, bits: int) -> np.ndarray:
    """The range of each hash: its first ``bits`` bits (1 or more)."""
    return (grams >> np.uint64(64 - bits)).astype(np.int32)


def _words(texts: list[str | None], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as hashes, and their number per text; ``known`` keeps the hashes of words met before."""
    words, lengths = [], []
    for text in texts:
        own = (text or "").encode("utf-8").lower().split()  # A-Z; between \x20 and \x09-\x0D
        out = list(map(known.get, own))
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    out[i] = known[own[i]] = xxhash.xxh64_intdigest(own[i]) or 1
        words.append(np.array(out, dtype=np.uint64))
        lengths.append(len(out))
    return np.concatenate(words) if words else np.empty(0, np.uint64), np.array(lengths, dtype=np.int64)


def _grams(flat: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order the n-gram's hash at every word (0 where the text does not reach back so far)."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams = [flat]
    for m in range(1, order):
        before = grams[-1]
        longer = np.zeros_like(flat)
        longer[1:] = _mix(before[:-1] * _GOLDEN + flat[1:] + np.uint64(m))
        longer[place < m] = 0
        grams.append(longer)
    return grams


class Block:
    """The distinct n-grams of some texts with their counts, per order and sorted.

    The texts come in batches, of which only hashes stay: 8 bytes per word and order, and with ``keep`` those of the words.
    """

    def __init__(self, batches: Iterable[list[str | None]], order: int, keep: bool = False):
        known: dict[bytes, int] = {}
        seen: list[list[np.ndarray]] = [[] for _ in range(order)]
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # words and their number per text, by batch
        self.order, self.n_words = order, 0
        for texts in batches:
            flat, lengths = _words(texts, known)
            self.n_words += len(flat)
            for own, g in zip(seen, _grams(flat, lengths, order), strict=True):
                own.append(g[g != 0])
            if keep:
                self.parts.append((flat, lengths))
        del known
        self.distinct, self.counts = [], []
        for own in seen:
            g = np.concatenate(own) if own else np.empty(0, np.uint64)
            own.clear()
            g.sort()
            first = np.flatnonzero(np.concatenate([np.ones(min(len(g), 1), bool), g[1:] != g[:-1]]))
            self.distinct.append(g[first])
            self.counts.append(np.diff(first, append=len(g)))

    def asks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every distinct n-gram and its count here, a batch at a time; the first stands for all words."""
        if self.n_words:
            yield np.array([_ALL_WORDS]), np.array([self.n_words])
        for grams, counts in zip(self.distinct, self.counts, strict=True):
            for i in range(0, len(grams), _ASK_ROWS):
                yield grams[i:i + _ASK_ROWS], counts[i:i + _ASK_ROWS]

    def take_totals(self, grams: np.ndarray, totals: np.ndarray) -> None:
        """Replace the counts of n-grams that other blocks have too by those of the corpus."""
        for distinct, counts in zip(self.distinct, self.counts, strict=True):
            at = np.minimum(np.searchsorted(distinct, grams), max(len(distinct) - 1, 0))
            found = distinct[at] == grams if len(distinct) else np.zeros(len(grams), bool)
            counts[at[found]] = totals[found]
        whole = totals[grams == _ALL_WORDS]
        self.n_words = int(whole[0]) if len(whole) else self.n_words

    def take_parts(self, answers: Iterable[tuple[int, bytes, np.ndarray]], bits: int) -> None:
        """As :meth:`take_totals`, from the totals of parts (see :func:`_answer`), which stand in the order of the hashes."""
        own = np.concatenate([np.full(min(self.n_words, 1), _ALL_WORDS), *self.distinct])
        own.sort()
        parts = _parts(own, bits)
        for part, small, large in answers:
            start, end = np.searchsorted(parts, [part, part + 1])
            totals = np.frombuffer(small, dtype=np.uint8).astype(np.int64)
            if len(totals) != end - start:
                raise ValueError(f"{len(totals)} counts for {end - start} n-grams")
            totals[totals == _LARGE] = large
            self.take_totals(own[start:end], totals)

    def score(self, backoff: float, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of words, of backed-off words and log score per text, in order."""
        found = [self._score(flat, lengths, backoff, min_count) for flat, lengths in self.parts]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _score(self, flat: np.ndarray, lengths: np.ndarray, backoff: float, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(flat):
            return lengths, np.zeros(len(lengths), np.int64), np.zeros(len(lengths))
        grams = _grams(flat, lengths, self.order)
        count = []
        for g, distinct, counts in zip(grams, self.distinct, self.counts, strict=True):
            at = np.minimum(np.searchsorted(distinct, g), max(len(distinct) - 1, 0))
            count.append(np.where(g != 0, counts[at] if len(distinct) else 0, 0).astype(np.float64))
        value = np.log(count[0]) - math.log(self.n_words)
        backed = np.zeros(len(value), dtype=bool)
        for m in range(1, len(count)):
            context = np.ones_like(value)
            context[1:] = np.maximum(count[m - 1][:-1], 1.0)
            exists, hit = grams[m] != 0, (grams[m] != 0) & (count[m] >= min_count)
            value = np.where(hit, np.log(np.maximum(count[m], 1.0)) - np.log(context), np.where(exists, value + math.log(backoff), value))
            backed = exists & ~hit
        owner = np.repeat(np.arange(len(lengths)), lengths)
        return (lengths, np.bincount(owner, weights=backed, minlength=len(lengths)).astype(np.int64),
                np.bincount(owner, weights=value, minlength=len(lengths)))


def _ask(order: int, bits: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = Block((b.column("text").to_pylist() for b in batches), order), key[0].as_py()
        for grams, counts in block.asks():
            yield pa.RecordBatch.from_arrays(
                [pa.array(_parts(grams, bits)), pa.array(grams.view(np.int64)), pa.repeat(pa.scalar(own, pa.int32()), len(grams)),
                 pa.array(counts.astype(np.int64))], schema=_ASK_ARROW)

    return run


def _part_answers(part: int, gram: np.ndarray, block: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    by = np.lexsort((gram.view(np.uint64), block))
    block, total = block[by], total[by]
    small = np.minimum(total, _LARGE).astype(np.uint8)
    edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
    runs = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    return pa.RecordBatch.from_arrays([
        pa.array([block[r.start] for r in runs], pa.int32()), pa.repeat(pa.scalar(part, pa.int32()), len(runs)),
        pa.array([small[r].tobytes() for r in runs], pa.binary()),
        pa.array([total[r][small[r] == _LARGE] for r in runs], pa.list_(pa.int64()))], schema=_ANSWER_ARROW)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows ``part, gram, block, total`` in the order of the hashes a row per part and block: its totals in that order.

    A total is one byte of ``small``; where that is 255, the next of ``large`` is the total. A task holds one part.
    """
    own, held = -1, []
    for batch in batches:
        part, *rest = (column.to_numpy() for column in batch.columns)
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and part[a] != own:
                yield _part_answers(own, *map(np.concatenate, zip(*held, strict=True)))
                held = []
            if a < b:
                own = int(part[a])
                held.append([column[a:b].copy() for column in rest])
    if held:
        yield _part_answers(own, *map(np.concatenate, zip(*held, strict=True)))


def _score(order: int, backoff: float, min_count: int, bits: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SCORE_ARROW.empty_table()
        block = Block((chunk.to_pylist() for chunk in docs.column("text").chunks), order, keep=True)
        block.take_parts(((part.as_py(), small.as_py(), large.values.to_numpy()) for part, small, large in zip(
            *(answers.column(c) for c in ("part", "small", "large")), strict=True)), bits)
        lengths, backed, log_prob = block.score(backoff, min_count)
        return pa.table([docs.column("row_id").cast(pa.int64()), pa.array(lengths), pa.array(backed), pa.array(log_prob)], schema=_SCORE_ARROW)

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF,
           min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``row_id, n_words, n_backoff, log_prob`` under counts over all rows of ``docs``.

    * A null or empty text has no words and the log score 0. Rows that repeat are counted and returned as often.
    * Only the id (null or not) and the text are read, whatever other columns there are; an empty table gives none.
    """
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), common.text_or_empty(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(size / block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row_id", "text"), F.lit(n)).cast("int"))
    bits = max(1, math.ceil(math.log2(n * PARTS)))
    asked = dealt.groupBy("block").applyInArrow(_ask(order, bits), _ASK)
    total = F.sum("n").over(Window.partitionBy("gram", "part"))
    # dealt by the part alone, and the window leaves the hashes in order: the answers need no other shuffle or sort of the rows
    summed = asked.repartition("part").select("part", "gram", "block", total.alias("total")).sortWithinPartitions("gram")
    answered = summed.mapInArrow(_answer, _ANSWER)
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_score(order, backoff, min_count, bits), _SCORE)


def op3_lm_scores(spark, sf_dir: str) -> DataFrame:
    found = scores(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("row_id").alias("doc_id"), "n_words", "n_backoff", F.round("log_prob", 4).alias("log_prob"),
                        F.when(F.col("n_words") > 0, F.round(F.col("log_prob") / F.col("n_words"), 6)).alias("score"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
t AS (SELECT id, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
one AS (SELECT b, count(*) AS n FROM t GROUP BY b),
two AS (SELECT a, b, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b),
total AS (SELECT count(*) AS n FROM t),
s AS (
  SELECT t.id, CASE WHEN t.a IS NULL THEN ln(y.n::DOUBLE) - ln(total.n::DOUBLE) WHEN two.n >= {MIN_COUNT} THEN ln(two.n::DOUBLE) - ln(x.n::DOUBLE)
               ELSE ln(y.n::DOUBLE) - ln(total.n::DOUBLE) + ln({BACKOFF}::DOUBLE) END AS v, t.a IS NOT NULL AND two.n < {MIN_COUNT} AS backed
  FROM t JOIN one y ON y.b = t.b LEFT JOIN one x ON x.b = t.a LEFT JOIN two ON two.a = t.a AND two.b = t.b, total),
p AS (SELECT id, sum(v) AS v, count(*) FILTER (backed) AS n FROM s GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_backoff, round(coalesce(v, 0.0), 4) AS log_prob,
       CASE WHEN len(w) > 0 THEN round(v / len(w), 6) END AS score
FROM w LEFT JOIN p USING (id)
"""
