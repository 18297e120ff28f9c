"""Chat formatting by schema fingerprint.

A record is a JSON object in any of several layouts (prompt and response,
instruction with input and output, lists of messages under various names). Its
fingerprint is the SHA-256 of its sorted nested field paths, arrays written as
``[]``. The fingerprint selects a declarative mapping, which says where the
turns are; the canonical turns are then written with a template whose control
strings cannot occur in a text, because texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm import common

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"  # the role whose texts are under the loss mask


def field_paths(value: Any, prefix: str = "") -> set[str]:
    """Paths of all leaves of a decoded JSON value; an empty object or array is a leaf too."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value))
    return {prefix}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8")).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns``: (role, field or fields) in order; several fields are joined by a blank line, absent and empty ones
    skipped. ``items``: a list of objects with ``role`` and ``text`` fields, after ``turns``. ``roles`` renames roles.
    ``optional`` paths may be absent: the mapping is registered for each combination.
    """

    name: str
    paths: frozenset[str]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    optional: frozenset[str] = frozenset()

    def read(self, record: dict[str, Any]) -> list[tuple[str, str]]:
        out = []
        for role, fields in self.turns:
            present = [f for f in fields if record.get(f) is not None]
            if present:
                out.append((role, str(record[present[0]]) if len(present) == 1
                            else "\n\n".join(str(record[f]) for f in present if record[f] != "")))
        names = dict(self.roles)
        for item in record.get(self.items) or [] if self.items else []:
            role = item.get(self.role)
            out.append(("" if role is None else names.get(role, str(role)), str(item.get(self.text) or "")))
        return out


_SPOKEN = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = (
    Mapping("messages", frozenset({"messages[].role", "messages[].content"}), items="messages"),
    Mapping("no messages", frozenset({"messages"}), items="messages"),
    Mapping("conversations", frozenset({"conversations[].from", "conversations[].value"}), (("system", ("system",)),),
            "conversations", "from", "value", _SPOKEN, frozenset({"system"})),
    Mapping("prompt", frozenset({"prompt", "response"}), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
            optional=frozenset({"system"})),
    Mapping("instruction", frozenset({"instruction", "output"}), (("system", ("system",)), ("user", ("instruction", "input")),
            ("assistant", ("output",))), optional=frozenset({"system", "input"})),
    Mapping("question", frozenset({"question", "answer"}), (("user", ("question",)), ("assistant", ("answer",)))),
)


def registry(mappings: Sequence[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    """Fingerprint → mapping."""
    return {fingerprint(m.paths | set(extra)): m for m in mappings
            for n in range(len(m.optional) + 1) for extra in combinations(sorted(m.optional), n)}


def escape(text: str) -> str:
    """One more backslash between ``<`` and ``|``: no control string is left, and :func:`unescape` gives the text back."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def write(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of canonical turns, and the code-point spans under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The canonical turns of a formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_OUT = "conv_id bigint, layout string, schema_sha256 string, formatted string, loss array<struct<start:bigint,stop:bigint>>"
_OUT_ARROW = pa.schema([("conv_id", pa.int64()), ("layout", pa.string()), ("schema_sha256", pa.string()),
                        ("formatted", pa.string()), ("loss", _SPANS)])


def _format(mappings: Sequence[Mapping]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(mappings)

        def rows():
            for part in parts:
                for conv, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    try:
                        record = json.loads(text or "null")
                    except ValueError:
                        record = None
                    if not isinstance(record, dict):
                        yield conv, None, None, None, None
                        continue
                    mark = fingerprint(field_paths(record))
                    mapping = known.get(mark)
                    if mapping is None:
                        yield conv, None, mark, None, None
                        continue
                    formatted, spans = write(mapping.read(record))
                    yield conv, mapping.name, mark, formatted, [{"start": a, "stop": b} for a, b in spans]

        yield from common.batches(rows(), _OUT_ARROW)

    return run


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record",
                   mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """One row per record: ``conv_id, layout, schema_sha256, formatted, loss`` (code-point spans of what is learned).

    * A null, malformed or non-object record has null in every column but the id; a record of unknown layout keeps
      its fingerprint, so that a mapping can be written for it. None is dropped.
    * A null text is empty, a null role is the empty role. Records that repeat come back as often.
    * Only the two columns are read, whatever others there are; an empty table gives an empty result.
    """
    common.bound_batches(records.sparkSession)
    return records.select(F.col(id_col).cast("bigint").alias("conv_id"), F.col(record_col).cast("string").alias("record")).mapInArrow(
        _format(mappings), _OUT)


def records_of_turns(turns: DataFrame) -> DataFrame:
    """JSON records, in the layout that fits each conversation, from rows ``conv_id, turn, role, text``.

    Turns go by ``turn``, then role and text, nulls first; each row is a turn, repeated ones too.
    """
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    convs = turns.groupBy("conv_id").agg(rows.alias("rows")).withColumn("roles", F.transform("rows", lambda r: r["role"]))
    body = F.when(F.array_contains("roles", "system") & (F.col("roles")[0] == "system") & (F.size("rows") > 1), F.slice(
        "rows", 2, F.greatest(F.size("rows") - 1, F.lit(1)))).otherwise(F.col("rows"))
    spoken = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    as_json = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})
    text = lambda i: F.col("rows")[i]["text"]
    exchange = F.concat_ws(",", "roles")
    alternate = F.forall(body, lambda r: F.coalesce(r["role"].isin("user", "assistant"), F.lit(False)))
    whole = ~F.exists("roles", lambda r: r.isNull())
    record = (
        F.when(whole & (exchange == "user,assistant") & (F.size("rows") == 2), as_json(prompt=text(0), response=text(1)))
        .when(whole & (exchange == "system,user,assistant") & (F.size("rows") == 3), as_json(
            system=text(0), prompt=text(1), response=text(2)))
        .when(whole & (F.col("roles")[0] == "system") & (F.size("rows") > 1) & alternate, as_json(
            system=text(0), conversations=F.transform(body, lambda r: F.struct(
                spoken[r["role"]].alias("from"), r["text"].alias("value")))))
        .otherwise(as_json(messages=F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content"))))))
    return convs.select("conv_id", record.alias("record"))


_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                           ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()

    def rows():
        for part in parts:
            for conv, formatted, loss in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                turns = read_back(formatted)
                learned = "".join(unescape(formatted[s["start"]:s["stop"]]) for s in loss)
                yield (conv, len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)), len(learned), sha(learned),
                       len(formatted))

    yield from common.batches(rows(), _DIGEST_ARROW)


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of the turns and the learned text, read back from the formatted texts."""
    return formatted.where("formatted is not null").select("conv_id", "formatted", "loss").mapInArrow(_digest, _DIGEST)


PROBE = f"{END}{START}assistant ok"


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)],
                                  "conv_id bigint, turn bigint, role string, text string")
    return digests(format_records(records_of_turns(turns.unionByName(probe))))


ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}', 'user' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}', 'assistant')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
       sum({len(START) + len(END) + 2} + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
