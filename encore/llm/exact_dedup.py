"""Exact deduplication with Patricia-trie owners.

Texts are equal when they are the same bytes after lower-casing A-Z. Every map
task inserts its normalised texts into compressed radix tries and hands on one
terminal per distinct text (smallest identifier, number of rows), so a text
that a third of all rows share leaves each task once. The terminals are dealt
by (length, content hash), ordered by their bytes, and inserted again; the
terminal nodes then hold the owner and the size of each class.

Memory is bounded on both sides by spilling subtrees: a map trie over its
budget hands its heaviest subtree to the shuffle, and a reduce trie, whose keys
arrive in byte order, hands on every subtree the order has passed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm import common

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TRIE_BYTES = 32 << 20  # text held by one task's trie before it spills a subtree

_TERMINAL = "text_bytes int, text_sha binary, text_key binary, owner_rank bigint, n_rows bigint"
_TERMINAL_ARROW = pa.schema([("text_bytes", pa.int32()), ("text_sha", pa.binary()), ("text_key", pa.binary()),
                             ("owner_rank", pa.int64()), ("n_rows", pa.int64())])
_OWNER = "text_sha binary, owner_rank bigint, group_size bigint"
_OWNER_ARROW = pa.schema([("text_sha", pa.binary()), ("owner_rank", pa.int64()), ("group_size", pa.int64())])
_MEMBER_ARROW = pa.schema([("member_id", pa.int64()), ("text_sha", pa.binary())])


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased (``bytes.lower`` touches ASCII letters only); null counts as empty."""
    return (text or "").encode("utf-8").lower()


class _Node:
    __slots__ = ("label", "children", "rank", "rows")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] = {}
        self.rank: int | None = None
        self.rows = 0


def _common_prefix(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """Compressed radix trie over byte strings; a terminal keeps the smallest rank and the number of rows."""

    def __init__(self) -> None:
        self.root = _Node(b"")
        self.size = 0

    def insert(self, key: bytes, rank: int | None, rows: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:])
                self.size += len(child.label) + 200
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                cut = _common_prefix(child.label, key, at)
                middle = _Node(child.label[:cut])
                child.label = child.label[cut:]
                middle.children[child.label[0]] = child
                node.children[key[at]] = middle
                self.size += 200
                node, at = middle, at + cut
        node.rows += rows
        if rank is not None and (node.rank is None or rank < node.rank):
            node.rank = rank

    def _drain(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            self.size -= len(node.label) + 200
            if node.rows:
                yield key, node.rank, node.rows
            stack.extend((child, key) for child in node.children.values())

    def spill_all(self) -> Iterator[tuple[bytes, int | None, int]]:
        root, self.root = self.root, _Node(b"")
        yield from self._drain(root, b"")
        self.size = 0

    def spill_heaviest(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Terminals of the heaviest subtree below the root, which leaves the trie."""
        weight: dict[int, int] = {}
        for first, child in self.root.children.items():
            stack, total = [child], 0
            while stack:
                node = stack.pop()
                total += len(node.label) + 200
                stack.extend(node.children.values())
            weight[first] = total
        first = max(weight, key=weight.__getitem__)
        yield from self._drain(self.root.children.pop(first), b"")

    def spill_passed(self, key: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        """With keys inserted in byte order, every subtree left of the path to ``key`` is final and leaves the trie."""
        node, at, prefix = self.root, 0, b""
        while at < len(key):
            for first in [f for f in node.children if f < key[at]]:
                yield from self._drain(node.children.pop(first), prefix)
            node = node.children[key[at]]
            prefix += node.label
            at += len(node.label)


def _combine(budget: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def terminals():
            trie = RadixTrie()
            for part in parts:
                for rank, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    trie.insert(normalise(text), rank)
                    while trie.size > budget:
                        yield from trie.spill_heaviest()
            yield from trie.spill_all()

        rows = ((len(key), hashlib.sha256(key).digest(), key, rank, n) for key, rank, n in terminals())
        yield from common.batches(rows, _TERMINAL_ARROW)

    return run


def _own(budget: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def terminals():
            trie, last = RadixTrie(), None
            for part in parts:
                for key, rank, rows in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    trie.insert(key, rank, rows)
                    last = key
                    if trie.size > budget:
                        yield from trie.spill_passed(key)
            if last is not None:
                yield from trie.spill_all()

        rows = ((hashlib.sha256(key).digest(), rank, n) for key, rank, n in terminals())
        yield from common.batches(rows, _OWNER_ARROW)

    return run


def _members(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        sha = [hashlib.sha256(normalise(text)).digest() for text in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sha, type=pa.binary())], schema=_MEMBER_ARROW)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
           trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: ``text_sha``, ``owner_id`` (smallest or largest identifier), ``group_size``."""
    common.bound_batches(docs.sparkSession)
    sign = {"smallest": 1, "largest": -1}[keep]
    keys = docs.select((F.col(id_col).cast("bigint") * F.lit(sign)).alias("rank"), F.col(text_col).cast("string").alias("text"))
    terminals = keys.mapInArrow(common.trimmed(_combine(trie_bytes)), _TERMINAL)
    dealt = terminals.repartition("text_bytes", "text_sha").sortWithinPartitions("text_key")
    found = dealt.select("text_key", "owner_rank", "n_rows").mapInArrow(common.trimmed(_own(trie_bytes)), _OWNER)
    return found.select("text_sha", (F.col("owner_rank") * F.lit(sign)).alias("owner_id"), "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                     trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    * A null text counts as empty. A row with a null id owns its class only if every id of the class is null.
    * Of rows that repeat the owner's id (the same row twice), exactly one is kept.
    * Any further columns of the input, whatever their names, are neither read nor returned.
    * An empty table gives an empty result.
    """
    own = owners(docs, id_col, text_col, keep, trie_bytes)
    keys = docs.select(F.col(id_col).cast("bigint").alias("member_id"), F.col(text_col).cast("string").alias("text"))
    # repeated rows are counted, not dropped: they come back below, and only the first may be kept
    members = (keys.mapInArrow(common.trimmed(_members), "member_id bigint, text_sha binary")
               .groupBy("member_id", "text_sha").agg(F.count(F.lit(1)).alias("copies")))
    joined = members.join(own, "text_sha").select(
        "*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return joined.select(
        F.col("member_id").alias(id_col), F.col("owner_id").alias("keep_id"), "group_size",
        (F.col("member_id").eqNullSafe(F.col("owner_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("text_sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; one row per class of equal texts.

    Nulls and repeated rows as in :func:`exact_duplicates`: null and empty texts are one class, a row that repeats the
    owner's id stays once, a null id stays only where its class has no other. An empty table stays empty.
    """
    stay = exact_duplicates(docs, id_col, text_col, keep).where("kept").select(
        F.col(id_col).alias("id"), F.col("text_sha256").alias("mark"))
    own = F.sha2(F.translate(common.text_or_empty(text_col), UPPER, UPPER.lower()), 256)
    return common.rows_that_stay(docs, stay, id_col, own)


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents),
n AS (SELECT doc_id, norm, row_number() OVER (PARTITION BY norm, doc_id) AS copy FROM t)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AND copy = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.table(spark, sf_dir, "documents"), keep="largest")
