"""Toxicity by maximum-scoring segments.

A token's score is the log ratio of its share in toxic and in clean text, both smoothed by a Dirichlet prior in
proportion to the pooled shares. Tokens are words; a word that is not in the lexicon stands for its longest prefix that
is, and all others share one (negative) score. A linear-time scan finds every maximal-scoring segment of a text. By
extreme-value theory a clean text of n tokens holds about ``K * n * exp(-lambda * s)`` segments that score ``s`` or more;
``lambda`` follows from the clean shares, ``K`` is fitted to the best segments of the clean sample. That gives each
passage its expected count by chance, and the document the chance of passages as good as its own. The document's score
is the posterior of the toxic class given that evidence, which is exponential with mean 1 in clean text and with the mean
of the toxic sample in toxic text.

What is learned is bounded: the sample holds at most ``sample_docs`` whole texts of each class (the first in hash order),
the lexicon at most ``lexicon`` features, those with the most significant excess in toxic documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm import common

SAMPLE_DOCS = 20_000
LEXICON = 50_000
PREFIXES = (7, 6, 5, 4)  # code points of the prefix features, longest first
PRIOR_TOKENS = 1_000.0  # weight of the Dirichlet prior in tokens
LEAST_ODDS = 1.0  # smallest log ratio of a lexicon feature
LEAST_CHANCE = 1e-300  # smaller chances count as this one
CHANCE = 0.01  # a passage is significant if so many like it are expected by chance in a clean text of its length
FLUSH_FEATURES = 200_000
CACHE_WORDS = 500_000

_WORD = re.compile(r"[^\W\d_]+")
_PASSAGE = "struct<start:bigint,stop:bigint,score:double,expected:double>"
_OUT = f"row_id bigint, score double, passages array<{_PASSAGE}>"
_OUT_ARROW = pa.schema([("row_id", pa.int64()), ("score", pa.float64()), ("passages", pa.list_(pa.struct([
    ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])))])


def features(word: str) -> list[str]:
    """The lower-cased word and its prefixes, most specific first; a prefix is marked by a final ``~``."""
    word = word.lower()
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) >= n)]


@dataclass(frozen=True)
class Model:
    """Scores by feature, the score of all other tokens, and the extreme-value parameters of clean text.

    Without features (nothing labelled, or no word tells the classes apart) every text has score 0.
    """

    scores: dict[str, float] = field(default_factory=dict)
    rest: float = -1.0
    rate: float = 1.0  # lambda
    factor: float = 1.0  # K
    prior: float = 0.0  # share of toxic rows among the labelled ones
    evidence: float = 1.0  # mean of -ln(chance) in toxic text


class TokenScores(dict):
    """Token → score, 0 for a token outside the lexicon; filled on demand and bounded."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = next((self.scores[f] for f in features(token) if f in self.scores), 0.0)
        self[token] = found
        return found


def maximal_segments(marks: Iterable[tuple[int, float]], rest: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last, score)`` of a sequence in which the positions in ``marks`` have the
    given positive scores and every other position the negative score ``rest``; in one pass.

    Candidates are kept with the cumulated score before and after them. A new candidate joins an older one when some
    candidate begins lower and ends lower than it; what lies between is then part of a better segment.
    """
    held: list[list] = []  # first, last, total before, total after, index of the nearest older one that begins lower
    total, at = 0.0, -1
    for place, score in marks:
        total += rest * (place - at - 1)
        new = [place, place, total, total + score, -1]
        total += score
        at = place
        older = len(held) - 1
        while True:
            while older >= 0 and held[older][2] >= new[2]:
                older = held[older][4]
            if older < 0 or held[older][3] >= new[3]:
                new[4] = older
                held.append(new)
                break
            # begins lower and ends lower: the new one takes in all from there on
            new[0], new[2] = held[older][0], held[older][2]
            older_still = held[older][4]
            del held[older:]
            older = older_still
    return [(first, last, after - before) for first, last, before, after, _ in held]


class Scanner:
    """A model applied to texts."""

    def __init__(self, model: Model):
        self.model = model
        self.tokens = TokenScores(model.scores)

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens and the maximal segments by token position."""
        words = _WORD.findall(text or "")
        marks = [(i, s) for i, s in enumerate(map(self.tokens.__getitem__, words)) if s]
        return len(words), maximal_segments(marks, self.model.rest)

    def expected(self, n: int, score: float) -> float:
        """Expected number of segments of at least this score in a clean text of ``n`` tokens."""
        return self.model.factor * n * math.exp(-self.model.rate * score)

    def chance(self, n: int, found: list[float]) -> float:
        """Probability that the best passages of a clean text of ``n`` tokens are as good, for the best number of them.

        For r passages the sum of their normalised scores has the tail exp(-t) t^(r-1) / (r! (r-1)!); a factor 2^r pays
        for the choice of r.
        """
        if not found or n == 0:
            return 1.0
        shift = math.log(self.model.factor * n)
        ranked = sorted(found, reverse=True)
        best = 2.0 * -math.expm1(-self.expected(n, ranked[0]))
        total = 0.0
        for r, score in enumerate(ranked, 1):
            step = self.model.rate * score - shift
            if step <= 0:
                break
            total += step
            if r > 1:
                log_tail = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2.0)
                best = min(best, math.exp(min(log_tail, 0.0)))
        return min(best, 1.0)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        return -math.log(max(self.chance(n, [s for _, _, s in found]), LEAST_CHANCE))

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """Posterior probability that the text is toxic, and its significant passages by code point, end exclusive."""
        n, found = self.segments(text)
        probability = self._posterior(self.evidence(n, found))
        if not found:
            return probability, []
        kept = [(first, last, s, e) for first, last, s in found if (e := self.expected(n, s)) <= CHANCE]
        if not kept:
            return probability, []
        places = [m.span() for m in _WORD.finditer(text)]
        return probability, [{"start": places[first][0], "stop": places[last][1], "score": s, "expected": e}
                             for first, last, s, e in kept]

    def _posterior(self, evidence: float) -> float:
        """Both densities of the evidence are exponential, so the log odds are linear in it."""
        toxic, mean = self.model.prior, self.model.evidence
        if toxic <= 0.0:
            return 0.0
        odds = math.log(toxic) - math.log1p(-toxic) - math.log(mean) + evidence * (1.0 - 1.0 / mean)
        return 1.0 / (1.0 + math.exp(min(-odds, 700.0)))


# ---- learning

def _counted(rows: Iterator[tuple[tuple, int, int]], limit: int) -> Iterator[tuple[tuple, int, int]]:
    """Sums of ``(key, toxic, clean)``, handed on whenever ``limit`` keys are held."""
    held: dict[tuple, list[int]] = {}
    for key, toxic, clean in rows:
        entry = held.setdefault(key, [0, 0])
        entry[0] += toxic
        entry[1] += clean
        if len(held) >= limit:
            yield from ((k, a, b) for k, (a, b) in held.items())
            held = {}
    yield from ((k, a, b) for k, (a, b) in held.items())


_COUNTS = "feature string, toxic bigint, clean bigint"
_COUNTS_ARROW = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _document_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a feature."""

    def each():
        for part in parts:
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for name in {f for w in set(_WORD.findall(text)) for f in features(w)}:
                    yield name, toxic, 1 - toxic

    yield from common.batches(_counted(each(), FLUSH_FEATURES), _COUNTS_ARROW)


def _token_counts(names: frozenset[str]):
    """Tokens of each class by the lexicon feature they stand for; the empty name is all others."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for part in parts:
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for word, n in Counter(_WORD.findall(text)).items():
                        name = next((f for f in features(word) if f in names), "")
                        yield name, n * toxic, n * (1 - toxic)

        yield from common.batches(_counted(each(), FLUSH_FEATURES), _COUNTS_ARROW)

    return run


def _best_segments(model: Model):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch: texts with a segment, and the sum of n * exp(-lambda * best), the least score standing for none."""
        scanner = Scanner(model)
        least = min(model.scores.values())
        for part in parts:
            hits, mass = 0, 0.0
            for text in part.column(0).to_pylist():
                n, found = scanner.segments(text)
                hits += bool(found)
                mass += n * math.exp(-model.rate * max((s for _, _, s in found), default=least))
            yield pa.RecordBatch.from_pydict({"hits": [hits], "mass": [mass]})

    return run


def _evidence(model: Model):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch: the sum of the evidence of its texts, and their number."""
        scanner = Scanner(model)
        for part in parts:
            texts = part.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"n": [len(texts)], "total": [sum(scanner.evidence(*scanner.segments(t)) for t in texts)]})

    return run


def _decay(shares: list[tuple[float, float]]) -> float:
    """The positive root of sum(share * exp(x * score)) = 1 over ``(share, score)`` of clean text, by bisection."""
    total = lambda x: sum(p * math.exp(min(x * s, 700.0)) for p, s in shares)
    low, high = 1e-6, 1.0
    while total(high) < 1.0 and high < 64.0:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1.0 else (low, middle)
    return (low + high) / 2


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample_docs: int = SAMPLE_DOCS, lexicon: int = LEXICON) -> Model:
    """A model from the rows of ``docs`` whose id ``labels`` marks 0 or 1 (the larger mark where an id repeats).

    Other marks, null ids and null texts are left out. Collected are class counts, at most ``lexicon`` features and
    their token counts, and one row of sums.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    marked = (labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y"))
              .where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y")))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    chosen = None
    for y, n in sorted(sizes.items()):
        # a part of the hash range that holds about four samples, so that the sample is not sought among all rows
        share = min(1.0, 4.0 * sample_docs / n + 64.0 / n)
        hashed = marked.where(F.col("y") == y).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
        part = hashed.where(F.col("h") < int(share * (1 << 30))).orderBy("h", "id").limit(sample_docs).select("id", "y")
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # at most 2 * sample_docs pairs of numbers are broadcast
    sample = common.written(rows.join(F.broadcast(chosen), "id").select("text", "y"), "toxicity-sample")

    counts = sample.mapInArrow(_document_counts, _COUNTS).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    counts = common.written(counts, "toxicity-counts")
    whole = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")).collect()[0]
    if not whole["a"] or not whole["b"]:
        return Model()
    # signed root of the likelihood ratio: how far the toxic documents with the feature exceed their share by chance
    share = whole["a"] / (whole["a"] + whole["b"])
    a, n = F.col("a"), F.col("a") + F.col("b")
    ratio = 2.0 * (a * F.log(a / (n * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1.0 - share)))).otherwise(0.0))
    odds = F.log((a + share) / whole["a"]) - F.log((F.col("b") + (1.0 - share)) / whole["b"])
    found = (counts.where((a > 0) & (a > n * share)).withColumn("z2", ratio)
             .where((F.col("z2") > 2.0 * math.log(whole["n"])) & (odds > LEAST_ODDS))
             .orderBy(F.desc("z2"), "feature").limit(lexicon).collect())
    names = frozenset(r["feature"] for r in found)
    if not names:
        return Model()

    tokens = {r["feature"]: (r["a"], r["b"]) for r in sample.mapInArrow(_token_counts(names), _COUNTS).groupBy("feature").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b")).collect()}
    toxic, clean = (sum(t[i] for t in tokens.values()) for i in (0, 1))
    smooth = lambda count, n, pooled: (count + PRIOR_TOKENS * pooled) / (n + PRIOR_TOKENS)
    shares = {}
    for name, (x, y) in tokens.items():
        pooled = (x + y) / (toxic + clean)
        shares[name] = smooth(x, toxic, pooled), smooth(y, clean, pooled)
    scores = {name: s for name, (p, q) in shares.items() if name and (s := math.log(p / q)) > 0}
    # tokens of no use join all others
    p, q = (1.0 - sum(shares[name][i] for name in scores) for i in (0, 1))
    if not scores or p <= 0 or q <= 0:
        return Model()
    rest = min(math.log(p / q), -1e-6)
    rate = _decay([(shares[name][1], s) for name, s in scores.items()] + [(q, rest)])
    model = Model(scores, rest, rate)
    tail = sample.where("y = 0").select("text").mapInArrow(_best_segments(model), "hits bigint, mass double").agg(
        F.sum("hits").alias("hits"), F.sum("mass").alias("mass")).collect()[0]
    factor = ((tail["hits"] or 0) + 0.5) / ((tail["mass"] or 0.0) + 0.5)  # maximum likelihood, with half a hit beforehand
    model = Model(scores, rest, rate, factor, sizes[1] / (sizes[0] + sizes[1]))
    known = sample.where("y = 1").select("text").mapInArrow(_evidence(model), "n bigint, total double").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).collect()[0]
    return replace(model, evidence=max(1.0, (known["total"] or 0.0) / (known["n"] or 1)))


# ---- scoring

def _score(model: Model):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)

        def rows():
            for part in parts:
                for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    yield row, *scanner.score(text)

        yield from common.batches(rows(), _OUT_ARROW)

    return run


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``row_id, score, passages``.

    * ``score`` is the posterior probability of a toxic text; ``passages`` lists its significant segments in order, with
      their score and the number of such segments a clean text of the length holds by chance.
    * A text without a lexicon token (null, empty, without letters) has no passage and the score of a text without
      evidence; with an empty model every score is 0. Equal texts have equal results, rows that repeat come back as often.
    * Only the id and the text are read.
    """
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(model), _OUT)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels")
    model = learn(docs.where(~held_out()), labels.where(~held_out()))
    shown = F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["stop"].cast("string"))), ",")
    return passages(docs, model).select(
        F.col("row_id").alias("doc_id"), held_out("row_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("bigint").alias("n_passages"), shown.alias("passages"))
