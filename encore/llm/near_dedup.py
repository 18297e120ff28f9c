"""Near-duplicate classes from DartMinHash signatures.

A text is the set of its five-word shingles (or the bag of them, with counts as
weights). Every element throws darts, all derived by hashing, into its region
of weight times rank. A signature has ``coordinates`` values; each is the dart
with the smallest rank that fell on that coordinate inside the element's
weight. Rank strips are opened from the lowest up until every coordinate has
its dart, so the work follows the number of darts needed and not the number of
elements times coordinates. Two texts agree on a coordinate with the
probability of their weighted Jaccard similarity.

Texts that share a band (``rows`` neighbouring coordinates) are candidates:

1. Texts with the same shingles are one node.
2. In every bucket all members are verified against one hub, the member that
   shares the most buckets with others. A bucket never emits its pairs.
3. Members that failed against a hub and are not near it by other links may
   still be similar to one another or to other members. For them an exact
   similarity join over their rarest shingles (prefix filter by classes of
   size, positional filter, pairs that links already connect left out) finds
   every partner.
4. Verified links are contracted, in an order that each round hashes anew, until none is left.

Links and labels stay in tables; nothing is gathered on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm import common

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 6  # a pair at the threshold shares no band with probability (1 - 0.8^6)^40 = 5e-6
CHUNK = 1 << 18  # elements handled at once
SLICE_ROWS, SLICE_BYTES = 400, 1 << 20  # texts sketched at once; one longer text is a slice of its own
KNOWN_WORDS = 200_000  # words whose hashes a task remembers

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(*parts: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(repr(parts)))


class Shingler:
    """64-bit hashes of the shingles of texts (lower-cased, words between ASCII white space)."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.words: dict[bytes, int] = {}
        self.odd = [_salt(size, i) | np.uint64(1) for i in range(size)]

    def word_hashes(self, text: str | None) -> np.ndarray:
        known, digest = self.words, xxhash.xxh64_intdigest
        if len(known) > KNOWN_WORDS:
            known.clear()
        words = (text or "").lower().encode("utf-8").split()
        out = list(map(known.get, words))
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    out[i] = known[words[i]] = digest(words[i])
        return np.array(out, dtype=np.uint64)

    def shingles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all texts, one after the other, and how many each has; repeats are not removed.

        A text shorter than a shingle has one, of all its words; a text without words has none.
        """
        words = [self.word_hashes(t) for t in texts]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        if not len(lengths) or not lengths.sum():
            return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
        flat = np.concatenate(words)
        counts = np.where(lengths >= self.size, lengths - self.size + 1, np.minimum(lengths, 1))
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.repeat(np.cumsum(lengths) - lengths, counts) + place
        width = np.repeat(np.minimum(lengths, self.size), counts)
        h = width.astype(np.uint64)
        for i in range(self.size):
            word = flat[np.minimum(start + i, len(flat) - 1)] * self.odd[i]
            h += word if (width == self.size).all() else np.where(i < width, word, np.uint64(0))
        h = mix(mix(h))
        return h, counts


@lru_cache(maxsize=4096)
def _poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of the number of darts in a cell of this area."""
    out, log_p, total, n = [], -area, 0.0, 0
    while total < 1.0 - 1e-15 and n < area + 20 * math.sqrt(area) + 40:
        total += math.exp(log_p)
        out.append(total)
        n += 1
        log_p += math.log(area) - math.log(n)
    return np.array(out)


def _strips() -> Iterator[tuple[int, float, float]]:
    """Rank strips, the same for all texts: (number, from, to)."""
    edges = [0.0, 1 / 64, 1 / 8, 1 / 2, 1.0]
    for i in range(4):
        yield i, edges[i], edges[i + 1]
    i, low = 4, 1.0
    while True:
        yield i, low, 2 * low
        i, low = i + 1, 2 * low


def dart_minhash(elements: np.ndarray, counts: np.ndarray, weights: np.ndarray | None = None,
                 coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Signatures, one row per text; ``counts`` gives each text's run in ``elements``. A text without elements has zeros.

    ``weights`` are positive; without them every element weighs 1. An element that repeats in a text throws the same
    darts again, which changes nothing.
    """
    n, k = len(counts), coordinates
    sig = np.zeros(n * k, dtype=np.uint64)
    filled = np.zeros(n * k, dtype=bool)
    owner = np.repeat(np.arange(n, dtype=np.int64), counts)
    open_texts = counts > 0
    heaviest = 1.0 if weights is None else float(weights.max()) if len(weights) else 1.0
    for strip, low, high in _strips():
        if not open_texts.any():
            break
        best = np.full(n * k, _NONE, dtype=np.uint64)
        live = np.flatnonzero(open_texts[owner])
        cell = 0
        while 2.0 ** cell - 1.0 < heaviest:  # weight cells [2^c - 1, 2^(c+1) - 1)
            floor, span = 2.0 ** cell - 1.0, 2.0 ** cell
            chances = _poisson((high - low) * span)
            salt = _salt(strip, cell)
            for a in range(0, len(live), CHUNK):
                at = live[a:a + CHUNK]
                if weights is not None:
                    at = at[weights[at] > floor]
                base = mix(elements[at] ^ salt)
                thrown = np.searchsorted(chances, (base >> np.uint64(11)).astype(np.float64) * 2.0 ** -53, side="right")
                hit = thrown > 0
                at, base, thrown = at[hit], base[hit], thrown[hit]
                for b, e in _runs(thrown):
                    times = thrown[b:e]
                    source = np.repeat(np.arange(b, e), times)
                    number = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
                    dart = mix(base[source] + (number + 1).astype(np.uint64) * np.uint64(_GOLDEN))
                    if weights is not None:
                        depth = (mix(dart ^ np.uint64(_GOLDEN)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
                        inside = floor + depth * span < weights[at[source]]
                        dart, source = dart[inside], source[inside]
                    # the upper half of a dart is its rank in the strip, the lower half gives the coordinate
                    place = ((dart & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)
                    np.minimum.at(best, owner[at[source]] * k + place.astype(np.int64), dart)
            cell += 1
        new = ~filled & (best != _NONE)
        sig[new] = mix(best[new] ^ _salt(strip))
        filled |= new
        open_texts &= ~filled.reshape(n, k).all(axis=1)
    return sig.reshape(n, k)


def _runs(thrown: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of elements that throw about ``limit`` darts together."""
    total = np.cumsum(thrown)
    start, done = 0, 0
    while start < len(thrown):
        end = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield start, end
        start, done = end, int(total[end - 1])


def bands(signatures: np.ndarray, n_bands: int = BANDS, n_rows: int = ROWS) -> np.ndarray:
    """One key per text and band."""
    parts = signatures.reshape(len(signatures), n_bands, n_rows)
    key = mix(np.arange(n_bands, dtype=np.uint64) + np.uint64(1))[None, :].repeat(len(signatures), axis=0)
    for i in range(n_rows):
        key = mix(key * np.uint64(_GOLDEN) + parts[:, :, i])
    return key


def weighted(elements: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements per text with their counts as weights."""
    out, sizes, weights, at = [], [], [], 0
    for c in counts:
        e, w = np.unique(elements[at:at + c], return_counts=True)
        out.append(e)
        weights.append(w)
        sizes.append(len(e))
        at += c
    empty = np.empty(0)
    return (np.concatenate(out) if out else empty.astype(np.uint64), np.array(sizes, np.int64),
            (np.concatenate(weights) if weights else empty).astype(np.float64))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (distinct sorted elements, weights)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def _slices(part: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``SLICE_ROWS`` rows and, but for a single row, ``SLICE_BYTES`` of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(part.column(text)), 0).to_numpy(zero_copy_only=False))
    start, done = 0, 0
    while start < part.num_rows:
        end = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(ends, done + SLICE_BYTES, side="right"))))
        yield part.slice(start, end - start)
        start, done = end, int(ends[end - 1])


_SKETCH = "row_id bigint, node binary, shingle_key binary, bands array<bigint>"
_SKETCH_ARROW = pa.schema([("row_id", pa.int64()), ("node", pa.binary()), ("shingle_key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sketch(by_count: bool, n_bands: int, n_rows: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part in parts:
            for piece in _slices(part, 2):
                texts = piece.column(2).to_pylist()
                elements, counts = shingler.shingles(texts)
                # order-free key of the bag of shingles
                starts, some = np.cumsum(counts) - counts, counts > 0
                sums = np.zeros((len(counts), 2), dtype=np.uint64)
                if some.any():
                    for c in range(2):
                        sums[some, c] = np.add.reduceat(mix(elements ^ _salt(-1, c)), starts[some])
                keys = [s.tobytes() + int(c).to_bytes(8, "little") for s, c in zip(sums, counts, strict=True)]
                first: dict[bytes, int] = {}  # copies inside the batch are sketched once
                for i, key in enumerate(keys):
                    first.setdefault(key, i)
                once = np.array(sorted(first.values()), dtype=np.int64)
                take = np.zeros(len(counts), dtype=bool)
                take[once] = True
                chosen, sizes = elements[np.repeat(take, counts)], counts[once]
                weights = None
                if by_count:
                    chosen, sizes, weights = weighted(chosen, sizes)
                made = bands(dart_minhash(chosen, sizes, weights, n_bands * n_rows), n_bands, n_rows).view(np.int64)
                row_of = {keys[i]: r for r, i in enumerate(once)}
                none: list[int] = []
                rows = [made[row_of[k]].tolist() if c else none for k, c in zip(keys, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(keys, pa.binary()),
                                                  pa.array(rows, pa.list_(pa.int64()))], schema=_SKETCH_ARROW)

    return run


_PAIR = "a binary, b binary, similarity double"
_PAIR_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])


def _profile(shingler: Shingler, text: str | None, by_count: bool) -> tuple[np.ndarray, np.ndarray]:
    elements, counts = np.unique(shingler.shingles([text])[0], return_counts=True)
    return elements, counts if by_count else np.ones(len(elements), dtype=np.int64)


def _verify(by_count: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()

        def rows():
            hub, held = None, None
            for part in parts:
                for a, b, text_a, text_b in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if b != hub:
                        hub, held = b, _profile(shingler, text_b, by_count)
                    yield a, b, similarity(_profile(shingler, text_a, by_count), held)

        yield from common.batches(rows(), _PAIR_ARROW)

    return run


def verified(pairs: DataFrame, texts: DataFrame, by_count: bool = False) -> DataFrame:
    """``a, b, similarity`` of the pairs, from the nodes' texts. A node in very many pairs is split by the join."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(common.trimmed(_verify(by_count)), _PAIR)


_SHINGLES = "node binary, shingle bigint"
_SHINGLES_ARROW = pa.schema([("node", pa.binary()), ("shingle", pa.int64())])


def _occurrences(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One element for each occurrence, the first as it is: set similarity of these is weighted similarity by counts."""
    k = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    each = np.repeat(elements, counts)
    return np.where(k == 0, each, mix(each + k * np.uint64(_GOLDEN)))


def _explode_shingles(by_count: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()

        def rows():
            for part in parts:
                for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for h in _occurrences(*_profile(shingler, text, by_count)).view(np.int64).tolist():
                        yield node, h

        yield from common.batches(rows(), _SHINGLES_ARROW, limit=20_000)

    return run


def rest_pairs(nodes: DataFrame, threshold: float = SIMILARITY, by_count: bool = False) -> DataFrame:
    """Every pair of a failed node and a node of another component that can reach the threshold on sets of shingles: ``a, b``.

    With ``by_count`` the k-th occurrence of a shingle is an element of its own, so that bags are sets.
    ``nodes``: ``node, root, failed, text``. Shingles are ordered by the number of nodes that have them, rare ones
    first. Two sets of sizes m and n that reach the threshold t share need = t / (1 + t) * (m + n) shingles or more.
    Hence one of the first m - need + 1 of the one is among the first n - need + 1 of the other (sizes fall into
    classes a tenth apart, whose smallest size gives a safe count for the class), and after the first one they share,
    at places i and j, there are need - 1 more to come: 1 + min(m - i, n - j) >= need, with the exact sizes.
    """
    exploded = common.written(nodes.select("node", "text").mapInArrow(common.trimmed(_explode_shingles(by_count)), _SHINGLES), "near-shingles")
    frequency = exploded.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    # a shingle that one node has can meet no other, but takes a place in the order
    ranked = exploded.join(frequency, "shingle").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("own"))  # the shingles of one text
    ranked = ranked.join(nodes.select("node", "root", "failed"), "node")
    size = F.size("own")
    step = math.log(1.1)
    level = F.floor(F.log(size.cast("double")) / F.lit(step) + F.lit(1e-9)).cast("int")
    reach = math.ceil(-math.log(threshold) / step)
    sized = ranked.select("node", "root", "failed", size.alias("size"), level.alias("level"), F.transform(
        "own", lambda x, i: F.struct(x["n"].alias("n"), x["shingle"].alias("shingle"), (i + 1).alias("place"))).alias("own"))
    sized = sized.withColumn("other", F.explode(F.sequence(F.col("level") - reach, F.col("level") + reach))).where("other >= 0")
    smallest = F.greatest(F.ceil(F.pow(F.lit(1.1), F.col("other")) - F.lit(1e-6)), F.lit(1))
    need = lambda m, n: F.ceil(F.lit(threshold / (1 + threshold)) * (m + n) - F.lit(1e-6))
    take = (F.col("size") - need(F.col("size"), smallest) + 1).cast("int")
    keys = sized.withColumn("take", F.least(F.col("size"), take)).where("take > 0").select(
        "node", "root", "failed", "level", "other", "size", F.explode(F.filter(F.slice("own", 1, F.col("take")), lambda x: x["n"] > 1)).alias("x"))
    keys = keys.select("node", "root", "failed", "level", "other", "size", "x.shingle", "x.place")
    left = keys.where("failed").select(F.col("node").alias("a"), F.col("root").alias("a_root"), "shingle", F.col("level").alias("mine"),
                                       F.col("other").alias("theirs"), F.col("size").alias("m"), F.col("place").alias("i"))
    right = keys.select(F.col("node").alias("b"), F.col("root").alias("b_root"), F.col("failed").alias("b_failed"), "shingle",
                        F.col("level").alias("theirs"), F.col("other").alias("mine"), F.col("size").alias("n"), F.col("place").alias("j"))
    met = left.join(right, ["shingle", "mine", "theirs"]).where(
        (F.col("a_root") != F.col("b_root")) & (~F.col("b_failed") | (F.col("a") < F.col("b")))
        & (1 + F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= need(F.col("m"), F.col("n"))))
    return met.select("a", "b").distinct()


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _nearest(edges: DataFrame, order) -> DataFrame:
    """``node, root``: the first node, by ``order`` of its column, among a node, its neighbours and theirs; written."""
    first = lambda column: F.struct(order(F.col(column)).alias("rank"), F.col(column).alias("node"))
    near = edges.groupBy("a").agg(F.min(first("b")).alias("m")).select(F.col("a").alias("b"), F.least(first("a"), "m").alias("near"))
    return common.written(edges.join(near, "b").groupBy("a").agg(F.min("near").alias("near")).select(
        F.col("a").alias("node"), F.col("near.node").alias("root")), "near-round")


def neighbourhoods(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node within two links. Equal roots are in one component; a star has one root."""
    return _nearest(common.written(_both_ways(links), "near-links"), lambda c: F.lit(0))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that has a link ``a, b``: one node of its connected component, the same for all of it.

    Each round points a node to the first node within two links, by an order that is hashed anew for the round, and
    contracts. In a fresh order about a third of a chain's nodes come first for some node, so the rounds grow with the
    logarithm of the longest chain, however its nodes are numbered; a star is one round.
    """
    edges = common.written(_both_ways(links), "near-links")
    roots, number = None, 0
    while not edges.isEmpty():
        to = _nearest(edges, lambda c, salt=number: F.xxhash64(F.lit(salt), c))
        if roots is None:
            roots = to
        else:
            roots = common.written(roots.join(to.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select(
                "node", F.coalesce("next", "root").alias("root")), "near-roots")
        one = edges.join(to.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        two = one.join(to.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = common.written(two.where(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "near-links")
        number += 1
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("a").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY,
            by_count: bool = False, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """One row per input row: ``row_id, node, class_id, class_size, kept``; a class is a connected component of similar texts.

    * ``class_id`` is the smallest id of the class (null only if all its ids are null); ``node`` tells texts apart.
    * ``kept`` is true for one row of a class: one with the class's id, also where that id repeats or is null.
    * Null, empty and wordless texts have no shingles and are copies of one another.
    * Rows that repeat come back as often. Other columns, whatever their names, are not read; an empty table gives none.
    """
    common.bound_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.unhex(F.md5(common.text_or_empty(text_col))).alias("node"),
                       common.text_or_empty(text_col).alias("text"))
    sketches = common.written(text.mapInArrow(common.trimmed(_sketch(by_count, n_bands, n_rows)), _SKETCH), "near-sketches")
    # one node per bag of shingles
    nodes = common.written(sketches.groupBy("shingle_key").agg(F.min("node").alias("hub"), F.first("bands").alias("bands")), "near-nodes")
    entries = nodes.select(F.col("hub").alias("node"), F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # both grow with the corpus: never broadcast, however small they are here
    buckets = common.written(entries.join(shared.hint("merge"), "key"), "near-buckets")
    central = buckets.groupBy("node").agg(F.sum("n").alias("meets"))
    hubs = buckets.join(central, "node").groupBy("key").agg(F.max(F.struct("meets", "node")).alias("top")).select("key", F.col("top.node").alias("b"))
    pairs = buckets.join(hubs, "key").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()
    pairs = common.written(pairs, "near-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = common.written(text.select("node", "text").join(wanted.hint("merge"), "node", "left_semi").groupBy("node").agg(
        F.first("text").alias("text")), "near-texts")
    checked = common.written(verified(pairs, texts, by_count), "near-checked")
    links = checked.where(F.col("similarity") >= threshold)
    # members that are not similar to a hub of theirs, nor near it by other links: they and all members of those buckets
    nearby = neighbourhoods(links)
    own = lambda name: nearby.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    failed = checked.where(F.col("similarity") < threshold).join(own("a"), "a", "left").join(own("b"), "b", "left").where(
        F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    failed = common.written(failed, "near-failed")
    if not failed.isEmpty():
        # in a bucket of two the hub's pair was the only one
        several = buckets.where("n > 2").select("key", "node")
        open_keys = hubs.join(failed.withColumnRenamed("a", "node"), "b").join(several, ["key", "node"]).select("key").distinct()
        rest = several.join(open_keys, "key", "left_semi").select("node").distinct().join(
            failed.select(F.col("a").alias("node")).distinct().withColumn("failed", F.lit(True)), "node", "left").join(
            nearby, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("failed", F.lit(False)).alias("failed"))
        rest = common.written(rest.join(texts, "node"), "near-rest")
        more = rest_pairs(rest, threshold, by_count)
        known = checked.select("a", "b").union(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        found = verified(more.join(known, ["a", "b"], "left_anti"), texts, by_count)
        links = links.unionByName(found.where(F.col("similarity") >= threshold))
    roots = components(links)
    rooted = nodes.join(roots.select(F.col("node").alias("hub"), "root"), "hub", "left").select(
        "shingle_key", F.coalesce("root", "hub").alias("root"))
    # the mark tells rows of one id apart; it is written with them, so that it stays
    members = common.written(sketches.select("row_id", "node", "shingle_key").join(rooted, "shingle_key").select(
        "row_id", "node", "root", F.monotonically_increasing_id().alias("mark")), "near-members")
    # numbers in every buffer, so that a large class is hashed in every task and never sorted
    per_id = members.groupBy("root", "row_id").agg(F.min("mark").alias("mark"), F.count(F.lit(1)).alias("n"))
    sizes = per_id.groupBy("root").agg(F.min("row_id").alias("class_id"), F.sum("n").alias("class_size"), F.coalesce(
        F.min_by("mark", "row_id"), F.min("mark")).alias("keeper"))
    return members.join(sizes, "root").select("row_id", "node", "class_id", "class_size", (F.col("mark") == F.col("keeper")).alias("kept"))


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names: one of each class, with its smallest id.

    Nulls as in :func:`classes`. Of rows that repeat this id, one with the smallest MD5 of its text stays; a null id
    stays only where its class has no other. An empty table stays empty.
    """
    found = classes(docs, id_col, text_col, threshold)
    stay = found.where(F.col("row_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("node").alias("node")).select(
        F.col("class_id").alias("id"), F.lower(F.hex("node")).alias("mark"))
    return common.rows_that_stay(docs, stay, id_col, F.md5(common.text_or_empty(text_col)))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("row_id").alias("doc_id"), "class_id", "class_size", "kept")
