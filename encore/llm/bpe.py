"""Byte-level BPE encoding and decoding, with tree concatenation for long texts.

The result is that of ``Tokenizer.from_file(path).encode(text,
add_special_tokens=False)`` and ``decode(ids, skip_special_tokens=False)``.

A text up to ``long_chars`` is encoded where it is. A longer one is cut into
fixed pieces (a special token in the text cuts it first, as the library does),
the pieces are dealt over the cluster and encoded in parallel, and the parts of
a text are joined pairwise as a tree. A join re-encodes a growing window around
the cut until both sides agree: on the left at a pre-token boundary that the
cut cannot have moved, on the right at the first boundary that the window and
the right part share. Inside one pre-token that spans the cut, the window is
counted in tokens and grows until its first token is the left side's and its
last token the right side's; every neighbouring pair is then one that BPE
keeps, so the joined sequence is the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from encore.llm import common

LONG_CHARS = 32_768
PIECE_CHARS = 16_384
BATCH_IDS = 1 << 18  # ids in an Arrow batch; as a list each takes about 36 bytes

# The pre-token pattern of this family of vocabularies; white space is the Unicode property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LOOKS = 2  # characters past a match's end that can decide it (a contraction is at most three characters)

# Code points on whose class (letter, number, white space) all Unicode versions agree; other texts take the
# library's own pre-tokeniser and model.
_ODD = re.compile(r"[^\x00-\u036f\u2010-\u2027]")

_IDS_ARROW = pa.schema([("row_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_LEAF = ("row_id bigint, text_sha binary, stretch int, piece int, copies bigint, plain boolean, part string, "
         "lengths array<int>, counts array<int>, ids array<int>")
_LEAF_ARROW = pa.schema([("row_id", pa.int64()), ("text_sha", pa.binary()), ("stretch", pa.int32()), ("piece", pa.int32()),
                         ("copies", pa.int64()), ("plain", pa.bool_()), ("part", pa.string()),
                         ("lengths", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])
_PIECE = "row_id bigint, text_sha binary, stretch int, piece int, plain boolean, part string"
_PIECE_ARROW = pa.schema([("row_id", pa.int64()), ("text_sha", pa.binary()), ("stretch", pa.int32()), ("piece", pa.int32()),
                          ("plain", pa.bool_()), ("part", pa.string())])


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """One tokenizer file. ``plain`` texts are encoded by rank tables, all others by the library itself."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        byte = _byte_letters()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.ranks = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.pretokens = regex.compile(PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self._cache: dict[str, list[int]] = {}

    @staticmethod
    def is_plain(text: str) -> bool:
        return text.isascii() or _ODD.search(text) is None

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if self.is_plain(text) and not self.special_re.search(text):
            return self.ranks.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.ranks.decode(ids)

    def split(self, text: str, plain: bool) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if plain:
            return self.pretokens.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def token_ids(self, pretoken: str, plain: bool) -> list[int]:
        """Ids of one pre-token."""
        found = self._cache.get(pretoken)
        if found is None:
            found = (self.ranks.encode_ordinary(pretoken) if plain
                     else self.library.encode(pretoken, add_special_tokens=False).ids)
            if len(pretoken) <= 32:
                if len(self._cache) > 200_000:
                    self._cache.clear()
                self._cache[pretoken] = found
        return found

    def token_bytes(self, ids: list[int]) -> bytes:
        return self.ranks.decode_bytes(ids)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


class Part:
    """An encoded stretch of text: its pre-tokens' lengths and their ids."""

    __slots__ = ("text", "lengths", "ids")

    def __init__(self, text: str, lengths: list[int], ids: list[list[int]]):
        self.text, self.lengths, self.ids = text, lengths, ids


def leaf(c: Codec, text: str, plain: bool) -> Part:
    tokens = c.split(text, plain)
    return Part(text, [len(t) for t in tokens], [c.token_ids(t, plain) for t in tokens])


def join_ids(c: Codec, left: list[int], right: list[int], plain: bool) -> list[int]:
    """Ids of one pre-token from those of its two halves: a token window grows until both sides agree."""
    a = b = 4
    while True:
        a, b = min(a, len(left)), min(b, len(right))
        try:
            window = c.token_bytes(left[len(left) - a:] + right[:b]).decode("utf-8")
        except UnicodeDecodeError:  # the window begins or ends inside a character
            if a == len(left) and b == len(right):
                raise
            a, b = a + 1, b + 1
            continue
        ids = c.token_ids(window, plain)
        left_ok = a == len(left) or ids[0] == left[len(left) - a]
        right_ok = b == len(right) or ids[-1] == right[b - 1]
        if left_ok and right_ok:
            return left[:len(left) - a] + ids + right[b:]
        a, b = (a if left_ok else 2 * a), (b if right_ok else 2 * b)


def join(c: Codec, left: Part, right: Part, plain: bool) -> Part:
    """The part for ``left.text + right.text``: the window around the cut grows until both sides agree."""
    if not left.text or not right.text:
        return left if left.text else right
    near = 4
    while True:
        n_left, n_right = min(near, len(left.lengths)), min(near, len(right.lengths))
        back, ahead = sum(left.lengths[-n_left:]), sum(right.lengths[:n_right])
        near *= 2
        if back <= LOOKS and n_left < len(left.lengths):
            continue
        window = left.text[-back:] + right.text[:ahead]
        whole = n_right == len(right.lengths)
        shared, at = {back: 0}, back
        for i, length in enumerate(right.lengths[:n_right], 1):
            at += length
            shared[at] = i
        tokens, end, taken = [], 0, None
        for token in c.split(window, plain):
            tokens.append(token)
            end += len(token)
            if end in shared and (whole or end + LOOKS < len(window)):
                taken = shared[end]
                break
        if taken is None:
            continue
        ids, start = [], 0
        for token in tokens:
            last = left.lengths[-1]
            if start == back - last and taken and start + len(token) == back + right.lengths[0]:
                ids.append(join_ids(c, left.ids[-1], right.ids[0], plain))
            else:
                ids.append(c.token_ids(token, plain))
            start += len(token)
        keep = len(left.lengths) - n_left
        return Part(left.text + right.text, left.lengths[:keep] + [len(t) for t in tokens] + right.lengths[taken:],
                    left.ids[:keep] + ids + right.ids[taken:])


def join_all(c: Codec, parts: list[Part], plain: bool) -> list[int]:
    """Ids of neighbouring parts, joined pairwise as a tree."""
    while len(parts) > 1:
        paired = [join(c, parts[i], parts[i + 1], plain) for i in range(0, len(parts) - 1, 2)]
        parts = paired + parts[len(parts) - len(parts) % 2:]
    return [i for ids in parts[0].ids for i in ids] if parts else []


def _encode_short(path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        rows = ((row, c.encode(text)) for part in parts
                for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
        yield from common.batches(rows, _IDS_ARROW, limit_bytes=BATCH_IDS)

    return run


def _cut(path: str, piece_chars: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)

        def rows():
            for part in parts:
                for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    sha, plain = hashlib.sha256(text.encode()).digest(), c.is_plain(text)
                    at, stretch = 0, 0
                    for hit in [*c.special_re.finditer(text), None]:
                        end = hit.start() if hit else len(text)
                        for piece, a in enumerate(range(at, end, piece_chars)):
                            yield row, sha, stretch, piece, plain, text[a:min(a + piece_chars, end)]
                        if hit:
                            yield row, sha, stretch + 1, 0, None, hit.group()
                            at, stretch = hit.end(), stretch + 2

        yield from common.batches(rows(), _PIECE_ARROW)

    return run


def _encode_pieces(path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)

        def rows():
            for part in parts:
                for *key, plain, text in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
                    if plain is None:  # a special token
                        yield *key, plain, text, [len(text)], [1], [c.special[text]]
                    else:
                        done = leaf(c, text, plain)
                        yield (*key, plain, text, done.lengths, [len(i) for i in done.ids], [i for ids in done.ids for i in ids])

        yield from common.batches(rows(), _LEAF_ARROW, limit=200, limit_bytes=2 << 20)

    return run


def _part(text: str, lengths: list[int], counts: list[int], ids: list[int]) -> Part:
    out, at = [], 0
    for n in counts:
        out.append(ids[at:at + n])
        at += n
    return Part(text, lengths, out)


def _join_pieces(path: str):
    def run(table: pa.Table) -> pa.Table:
        c = codec(path)
        rows = sorted(table.to_pylist(), key=lambda r: (r["stretch"], r["piece"]))
        ids: list[int] = []
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end]["stretch"] == rows[at]["stretch"]:
                end += 1
            ids += join_all(c, [_part(r["part"], r["lengths"], r["counts"], r["ids"]) for r in rows[at:end]],
                            bool(rows[at]["plain"]))
            at = end
        n = rows[0]["copies"]
        return pa.table({"row_id": pa.array([rows[0]["row_id"]] * n, pa.int64()), "ids": pa.array([ids] * n, pa.list_(pa.int32()))})

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           long_chars: int = LONG_CHARS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per input row: ``row_id`` (the value of ``id_col``) and ``ids`` (array of int).

    * A null or empty text has no ids. A null id is returned as null. Rows that repeat come back as often.
    * The strings of special tokens in a text become those tokens, as the library does by default.
    * Further columns of the input, whatever their names, are neither read nor returned; an empty table gives none.
    """
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), common.text_or_empty(text_col).alias("text"))
    short = rows.where(F.length("text") <= long_chars).mapInArrow(common.trimmed(_encode_short(path)), "row_id bigint, ids array<int>")
    key = ["row_id", "text_sha", "stretch", "piece"]
    pieces = (rows.where(F.length("text") > long_chars).mapInArrow(common.trimmed(_cut(path, piece_chars)), _PIECE)
              .groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.first("plain").alias("plain"), F.first("part").alias("part")))
    long = (pieces.mapInArrow(common.trimmed(_encode_pieces(path)), _LEAF)
            .groupBy("row_id", "text_sha").applyInArrow(_join_pieces(path), "row_id bigint, ids array<int>"))
    return short.unionByName(long)


def _decode(path: str, with_ids: bool = False):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        schema = pa.schema([("row_id", pa.int64()), ("text", pa.string()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
        for part in parts:
            text = pa.array([c.decode(ids) for ids in _lists(part.column(1))], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), text, *([part.column(1).cast(pa.list_(pa.int32()))] if with_ids else [])], schema=schema)

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``row_id, text`` of rows ``row_id, ids``; null ids decode to the empty text."""
    common.bound_batches(encoded.sparkSession)
    return encoded.select("row_id", "ids").mapInArrow(common.trimmed(_decode(path)), "row_id bigint, text string")


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    for i in range(len(column)):
        yield values[offsets[i]:offsets[i + 1]].tolist() if column[i].is_valid else []


_DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                           ("decoded_sha256", pa.string())])


def _digest(path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        digits = [str(i) for i in range(c.library.get_vocab_size(with_added_tokens=True))]
        sha = lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()
        rows = ((row, len(ids), sha(",".join([digits[i] for i in ids])), sha(c.decode(ids))) for part in parts
                for row, ids in zip(part.column(0).to_pylist(), _lists(part.column(1)), strict=True))
        yield from common.batches(rows, _DIGEST_ARROW)

    return run


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of rows ``row_id, ids`` (decoded again)."""
    return encoded.mapInArrow(common.trimmed(_digest(path)), _DIGEST)


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of documents: the ids, and the digest of the text decoded from them.

    * A null text counts as empty and has no ids; rows that repeat, or have a null id, each get their row.
    * Only id and text are read, so other columns may have any name. An empty table gives none.
    """
    made = encode(docs, path)
    decoded = F.sha2(F.col("text"), 256)
    rows = made.mapInArrow(common.trimmed(_decode(path, True)), "row_id bigint, text string, ids array<int>")
    return rows.select(F.col("row_id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids", decoded.alias("decoded_sha256"))


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(encode(common.table(spark, sf_dir, "documents"), path), path)
