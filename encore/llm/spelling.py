"""Spelling variant grouping with a bidirectional FM-index.

Words are counted over all texts; two words are near if they differ by one inserted, deleted or replaced code point. A
near word shares a half with the word it is near to: the search scheme matches one half exactly and extends across the
other, allowing one error, as intervals of suffix ranks in an index over the delimited vocabulary. A search begins at a
word's delimiter and ends at its other one, so that a hit is a whole word.

The vocabulary is dealt into indexes by half: a word is indexed under every prefix and suffix that can be the exact half
of a near word (two or three lengths each), and asked for in the indexes of its own two halves. A half shared by very
many words is split over salts, each with its part of the words, and asked in all of them. So every index holds a
bounded number of words, nothing is compared pair by pair, and every near pair is found once in each direction.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm import common

LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_FACTOR = 5
TYPO_EVERY = 199
FLUSH_WORDS = 200_000
INDEX_CHARS = 60_000  # characters of an index on average
HALF_WORDS = 4_096  # words of one half in one index at most; more are split over salts
MOST_HALVES = 50_000  # the limit above grows so that no more halves than these are split
ASK_CHARS = 1 << 18  # letters of the words searched for at a time (one word at least), the shorter ones padded

_PREFIX, _SUFFIX = 0, 1

# ---- words of texts

# a byte of Latin-1 → the lower-cased letter of A-Z, the letter itself, or a space
_LETTERS = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))

_COUNTED = "word string, n bigint"
_COUNTED_ARROW = pa.schema([("word", pa.string()), ("n", pa.int64())])


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, in Latin-1 (a byte per code point)."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def _typo(prefix: int, run: bytes) -> bytes:
    """``run`` or, where the checksum of the row's id and the run says so, the run without one code point."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode("utf-8"), prefix)
    if h % TYPO_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count_words(least_length: int):
    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
        held: dict[bytes, int] = {}
        for part in parts:
            for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(f"{'' if row is None else row}:".encode())
                for run, n in Counter(runs(text)).items():
                    if len(run) < least_length:
                        continue
                    word = _typo(prefix, run)
                    if len(word) >= least_length:
                        held[word] = held.get(word, 0) + n
                if len(held) >= FLUSH_WORDS:
                    yield from ((w.decode("latin-1"), n) for w, n in held.items())
                    held = {}
        yield from ((w.decode("latin-1"), n) for w, n in held.items())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.batches(counted(parts), _COUNTED_ARROW, limit=20_000)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the distinct words of at least ``least_length`` code points and ``least_count`` occurrences.

    A null text has no words; a null id counts as the empty string in the checksum. Rows that repeat count as often.
    """
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_count_words(least_length), _COUNTED)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- the index

class FMIndex:
    """Bidirectional FM-index over ``0 w1 0 w2 0 ... 0`` where 0 is the delimiter.

    A state is three numbers: the first rank ``low`` of the suffixes that begin with the matched text, their number
    ``size``, and the first rank ``back`` of its reverse in the reversed text. Every table row counts, for a rank, the
    symbols below each symbol among the earlier entries of the transform.
    """

    def __init__(self, words: list[np.ndarray], symbols: int):
        """``words``: arrays of symbols from 1 on, at most ``symbols``, all distinct."""
        zero = np.zeros(1, np.int32)
        text = np.concatenate([zero, *(x for w in words for x in (w, zero))]).astype(np.int32)
        starts = np.flatnonzero(text == 0)[:-1]
        self.word_at = np.full(len(text) + 1, -1, np.int64)
        self.word_at[starts] = np.arange(len(words))
        self.symbols = symbols
        self.suffixes, self.below = self._transform(text)
        _, self.below_back = self._transform(text[::-1])
        counts = np.bincount(text, minlength=symbols + 1)
        self.first = 1 + np.concatenate([[0], np.cumsum(counts)])  # rank 0 is the empty suffix

    def _transform(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = suffix_array(text)
        before = np.where(order > 0, text[order - 1] if len(text) else 0, -1)  # -1: what precedes the whole text
        # below[r, c]: entries before rank r whose symbol is less than c (the text's end counts as less than all)
        seen = np.zeros((len(order) + 1, self.symbols + 3), np.int32)
        seen[np.arange(1, len(order) + 1), before + 2] = 1
        np.cumsum(seen, axis=0, out=seen)
        np.cumsum(seen, axis=1, out=seen)
        return order, seen[:, 1:]

    def start(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``n`` states that have matched a delimiter."""
        size = self.first[1] - self.first[0]
        return (np.full(n, self.first[0]), np.full(n, size), np.full(n, self.first[0]))

    def extend(self, state: tuple, symbol: np.ndarray, right: bool) -> tuple:
        """States with ``symbol`` added on the right or left; size 0 where that text does not occur."""
        low, size, back = state
        table, near, far = (self.below_back, back, low) if right else (self.below, low, back)
        at, end = table[near], table[near + size]
        row = np.arange(len(symbol))
        less_at, less_end = at[row, symbol], end[row, symbol]
        up_to_at, up_to_end = at[row, symbol + 1], end[row, symbol + 1]
        near = self.first[symbol] + (up_to_at - less_at)
        far = far + (less_end - less_at)
        size = (up_to_end - up_to_at) - (less_end - less_at)
        return (far, size, near) if right else (near, size, far)

    def extend_all(self, state: tuple, right: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
        """For every letter that can follow each state: index of the state, the letter, the new state."""
        low, size, back = state
        table, near, far = (self.below_back, back, low) if right else (self.below, low, back)
        at, end = table[near], table[near + size]
        here = np.diff(end, axis=1) - np.diff(at, axis=1)
        here[:, 0] = 0  # the delimiter is no letter
        which, symbol = np.nonzero(here)
        near = self.first[symbol] + (at[which, symbol + 1] - at[which, symbol])
        far = far[which] + (end[which, symbol] - at[which, symbol])
        size = here[which, symbol].astype(np.int64)
        return which, symbol, ((far, size, near) if right else (near, size, far))

    def words_of(self, low: np.ndarray) -> np.ndarray:
        """Number of the word that follows the delimiter of each rank."""
        return self.word_at[self.suffixes[low]]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Ranks → positions of all suffixes, the empty one first; by doubling the sorted length until all differ."""
    n = len(text) + 1
    rank = np.concatenate([text.astype(np.int64) + 1, [0]])
    width = 1
    while True:
        next_rank = np.zeros(n, np.int64)
        next_rank[:max(0, n - width)] = rank[width:] + 1
        key = rank * (n + int(rank.max()) + 2) + next_rank
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if new[order[-1]] == n - 1:
            return order
        rank, width = new, width * 2


def _kept(state: tuple, keep: np.ndarray) -> tuple:
    return tuple(x[keep] for x in state)


def _joined(states: list[tuple]) -> tuple:
    return tuple(np.concatenate([s[i] for s in states]) for i in range(len(states[0])))


def near_words(index: FMIndex, asked: np.ndarray, length: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number of the asked word, number of an indexed word) one edit apart in the second (``right``) or first half.

    ``asked`` holds a word per row, symbols from 1 on, padded by 0. Of the edit scripts that give the same word, only the
    one with the rightmost place is followed: an inserted letter differs from the letter after it, a deleted one too.
    """
    half = length // 2
    n = len(asked)
    # letters in the order of the search: from the first on, or from the last back
    step = (lambda who, done: asked[who, done]) if right else (lambda who, done: asked[who, length[who] - 1 - done])
    exact = half if right else length - half
    who, state = np.arange(n), index.start(n)
    for done in range(int(exact.max(initial=0))):
        going = exact[who] > done
        rest, moved = _kept((who, *state), ~going), _kept((who, *state), going)
        new = index.extend(moved[1:], step(moved[0], np.full(len(moved[0]), done)), right)
        moved = _kept((moved[0], *new), new[1] > 0)
        who, *state = _joined([rest, moved])
    who, low, size, back = who, *state
    done = exact[who].astype(np.int64)
    found_who: list[np.ndarray] = []
    found_word: list[np.ndarray] = []
    wrong = tuple(np.zeros(0, np.int64) for _ in range(5))  # states with the error behind them: who, done, low, size, back
    while len(who) or len(wrong[0]):
        branched = [wrong]
        if len(who):
            end = done >= length[who]
            safe = np.where(end, 0, np.minimum(done, length[who] - 1))
            letter = np.where(end, 0, step(who, safe))
            which, symbol, new = index.extend_all((low, size, back), right)
            # replaced: one letter further; a letter of its own
            other = symbol != letter[which]
            replaced = other & ~end[which]
            branched.append((who[which[replaced]], done[which[replaced]] + 1, *_kept(new, replaced)))
            # inserted: the asked word stays where it is. Going right, before letter ``done`` or at the end; going left,
            # before the letter taken last, so the letter after the gap is that one
            if right:
                inserted = other
            else:
                after = step(who, done - 1)
                inserted = (symbol != after[which]) & (done[which] > exact[who[which]])
            branched.append((who[which[inserted]], done[which[inserted]], *_kept(new, inserted)))
            # deleted: the letter is passed over, if the next one to its right differs
            if right:
                last = done >= length[who] - 1
                following = np.where(last, 0, step(who, np.where(last, 0, done + 1)))
            else:
                following = step(who, done - 1)
            deleted = ~end & (following != letter)
            branched.append((who[deleted], done[deleted] + 1, low[deleted], size[deleted], back[deleted]))
            # no error here
            going = ~end
            who, done = who[going], done[going]
            low, size, back = index.extend(_kept((low, size, back), going), letter[going], right)
            alive = size > 0
            who, done, low, size, back = who[alive], done[alive] + 1, low[alive], size[alive], back[alive]
        whom, at, *state = _joined(branched)
        whole = at >= length[whom]
        shut = index.extend(_kept(state, whole), np.zeros(int(whole.sum()), np.int64), right)
        hit = shut[1] > 0
        found_who.append(whom[whole][hit])
        found_word.append(index.words_of(shut[0][hit]))
        whom, at, state = whom[~whole], at[~whole], _kept(state, ~whole)
        state = index.extend(state, step(whom, at), right)
        wrong = _kept((whom, at + 1, *state), state[1] > 0)
    return np.concatenate(found_who or [np.zeros(0, np.int64)]), np.concatenate(found_word or [np.zeros(0, np.int64)])


# ---- dealing words to indexes

def _halves(lengths: Column, word: Column) -> Column:
    """Prefixes and suffixes of ``word`` that are the exact half of a word whose length is in ``lengths``."""
    low = F.array_distinct(F.transform(lengths, lambda n: F.floor(n / 2).cast("int")))
    high = F.array_distinct(F.transform(lengths, lambda n: n - F.floor(n / 2).cast("int")))
    return F.concat(
        F.transform(low, lambda m: F.struct(F.lit(_PREFIX).alias("side"), F.substring(word, F.lit(1), m).alias("half"))),
        F.transform(high, lambda m: F.struct(F.lit(_SUFFIX).alias("side"), F.right(word, m).alias("half"))))


_NEAR = "word string, n_near bigint, best struct<minus:bigint,word:string>"
_NEAR_ARROW = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("minus", pa.int64()), ("word", pa.string())]))])


def _blocks(words: list[str]) -> Iterator[list[str]]:
    """Runs of words, which come in order of length, whose padded letters stay within ``ASK_CHARS``."""
    block: list[str] = []
    for word in words:
        if block and (len(block) + 1) * len(word) > ASK_CHARS:
            yield block
            block = []
        block.append(word)
    if block:
        yield block


def _search(group: pa.Table) -> pa.Table:
    """All near words within one index: per asked word and half, their number and the best of them.

    A hit counts if the found word is here for that half; it may be here for another half or salt too.
    """
    rows = list(zip(*(group.column(c).to_pylist() for c in ("side", "size", "asked", "word", "n")), strict=True))
    held = dict(sorted({word: n for _, _, asked, word, n in rows if not asked}.items()))  # code-point order
    if not held:
        return _NEAR_ARROW.empty_table()
    letters = sorted({c for _, _, _, word, _ in rows for c in word})
    symbol = {c: i for i, c in enumerate(letters, 1)}
    symbols = lambda word: np.array([symbol[c] for c in word], np.int32)
    words = list(held)
    counts = np.array(list(held.values()), np.int64)
    index = FMIndex([symbols(w) for w in words], len(letters))
    number = {w: i for i, w in enumerate(words)}
    sizes = 1 + max(size for _, size, *_ in rows)
    out: list[tuple] = []
    for side in (_PREFIX, _SUFFIX):
        here = np.array(sorted({number[word] * sizes + size for s, size, q, word, _ in rows if not q and s == side}), np.int64)
        asked = sorted({word for s, _, q, word, _ in rows if q and s == side}, key=len)
        for block in _blocks(asked):
            length = np.array([len(w) for w in block], np.int64)
            matrix = np.zeros((len(block), int(length.max())), np.int64)
            for row, word in enumerate(block):
                matrix[row, :len(word)] = symbols(word)
            who, word = near_words(index, matrix, length, right=side == _PREFIX)
            exact = length // 2 if side == _PREFIX else length - length // 2
            due = np.isin(word * sizes + exact[who], here)
            who, word = who[due], word[due]
            order = np.lexsort((word, -counts[word], who))
            who, word = who[order], word[order]
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
            found = np.diff(np.concatenate([first, [len(who)]]))
            out += [(block[a], int(k), {"minus": -int(counts[b]), "word": words[b]})
                    for a, b, k in zip(who[first], word[first], found, strict=True)]
    if not out:
        return _NEAR_ARROW.empty_table()
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), _NEAR_ARROW, strict=True)], schema=_NEAR_ARROW)


def neighbours(words: DataFrame, index_chars: int = INDEX_CHARS, half_words: int = HALF_WORDS) -> DataFrame:
    """``word, n_near, form, form_n`` of every word of ``words`` (``word, n``, words distinct) with a near word.

    ``form`` is the near word of largest ``n``, the first in code-point order of equal ones.
    """
    length = F.length("word")
    sizes = words.agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("chars")).collect()[0]
    if not sizes["n"]:
        return words.select("word", F.lit(0).cast("bigint").alias("n_near"), F.col("word").alias("form"), F.col("n").alias("form_n")).where("false")
    indexes = max(1, -(-5 * sizes["chars"] // index_chars))
    half_words = max(half_words, -(-5 * sizes["n"] // MOST_HALVES))
    one = F.col("word")
    place = F.explode(_halves(F.array(length - 1, length, length + 1), one)).alias("at")
    indexed = words.select("word", "n", place).select("word", "n", "at.side", "at.half")
    asked = words.select("word", "n", F.explode(_halves(F.array(length), one)).alias("at")).select("word", "n", "at.side", "at.half")
    # halves of more words than an index takes: at most MOST_HALVES, by the choice of half_words
    hot = indexed.groupBy("side", "half").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > half_words).select(
        "side", "half", F.ceil(F.col("held") / half_words).cast("int").alias("salts"))
    hot = F.broadcast(common.written(hot, "spelling-hot-halves"))
    salts = F.coalesce("salts", F.lit(1))
    number = lambda salt: F.pmod(F.xxhash64("side", "half", salt), F.lit(indexes)).alias("index")
    size = F.length("half").alias("size")
    held = indexed.join(hot, ["side", "half"], "left").withColumn("salt", F.pmod(F.xxhash64("word"), salts).cast("int")).select(
        number(F.col("salt")), "side", size, F.lit(False).alias("asked"), "word", "n")
    asks = asked.join(hot, ["side", "half"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(
        number(F.col("salt")), "side", size, F.lit(True).alias("asked"), "word", "n")
    found = held.unionByName(asks).groupBy("index").applyInArrow(_search, _NEAR)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return best.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.minus")).alias("form_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """One row per word of the vocabulary: ``word, n, n_near, form, form_n, root``.

    * ``form`` is the most frequent near word if it is at least ``factor`` times as frequent, else null; ``root`` is the
      last word that the forms lead to, the word itself without a form. Counts grow along the way, so that the way has
      no more steps than powers of ``factor`` up to the largest count.
    * Null, empty and long texts, null ids and repeated rows as in :func:`vocabulary`; an empty table has no words.
    * Of equally frequent near words the first in code-point order is the form. Other columns are not read.
    """
    words = common.written(vocabulary(docs, id_col, text_col, least_length, least_count), "spelling-words")
    found = neighbours(words)
    firm = F.col("form_n") >= factor * F.col("n")
    out = common.written(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(firm, F.col("form")).alias("form"),
        F.when(firm, F.col("form_n")).alias("form_n")), "spelling-forms")
    most = out.agg(F.max("n").alias("n")).collect()[0]["n"] or 1
    steps, reach = 0, max(1, least_count)
    while reach * factor <= most:
        steps, reach = steps + 1, reach * factor
    links = out.where("form is not null").select("word", F.col("form").alias("root"))
    known = 1
    while known < steps:  # each join doubles the steps taken
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = common.written(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        known *= 2
    return out.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(common.table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
