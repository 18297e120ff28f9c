"""Secret scans over an incremental blob ledger.

Every historical version of a path is content-addressed: its blob is the
SHA-256 of its text. The ledger is a table of ``(blob, scans)`` rows, where
``scans`` lists the rule versions run on the blob and their spans, clean ones
included. A scan takes the distinct blobs of the versions it is given, drops
the (blob, rule version) pairs the ledger has, runs the rest, appends them, and
joins the ledger's findings back to every path with that blob. New paths for
old content, and old paths under an unchanged rule, cost a join and no scan.

A text that no rule can match, by the rules' hints and screens, is clean: its
blob enters the ledger, the text itself is not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm import common
from encore.session import scratch_path


def _either_case(word: str) -> str:
    """ASCII letters of ``word`` in either case, and no other characters that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least`` code points or more.

    ``hints``: a text whose lower-cased form holds none of them has no match. ``screen``: nor has a text in which this
    regular expression (Java's) finds nothing. A rule without either may match any text.
    A changed pattern takes a new ``version``, so that old blobs are scanned for it again.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = field(default=())
    screen: str = ""


_VALUE = r"[A-Za-z0-9+/_.=-]"
BASE_RULES = (
    Rule("assign", 1, "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
         + r""")["']?\x20*[:=]\x20*["']?(""" + _VALUE + "+)", 2, 6, ("passw", "secret", "token", "api")),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24, screen="[0-9a-f]{24}"),  # the whole run, as [0-9a-f]+ of 24 or more
)
MORE_RULES = (
    # up to the END line where there is one, so that the key itself is in the span
    Rule("private_key", 2, "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?", hints=("private key",)),
    Rule("forge_token", 1, "gh[opsur]_[A-Za-z0-9]{36,}", hints=("gho_", "ghp_", "ghs_", "ghu_", "ghr_")),
    Rule("chat_token", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("url_login", 1, r"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@", hints=("://",)),
)
RULES = BASE_RULES + MORE_RULES

_SCANS = "array<struct<kind:string,version:int,spans:array<struct<start:int,stop:int>>>>"
_LEDGER = f"blob binary, scans {_SCANS}"
_SPAN_ARROW = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_LEDGER_ARROW = pa.schema([("blob", pa.binary()), ("scans", pa.list_(pa.struct([
    ("kind", pa.string()), ("version", pa.int32()), ("spans", pa.list_(_SPAN_ARROW))])))])


def find(rule: Rule, text: str, lowered: str) -> list[dict[str, int]]:
    if rule.hints and not any(h in lowered for h in rule.hints):
        return []
    return [{"start": m.start(), "stop": m.end()} for m in re.finditer(rule.pattern, text)
            if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _may_match(text: Column, rules: Sequence[Rule]) -> Column:
    """Whether some rule can match ``text``."""
    lowered = F.lower(text)
    tests = [lowered.contains(h) for h in sorted({h for r in rules if not r.screen for h in r.hints})]
    tests += [text.rlike(r.screen) for r in rules if r.screen]
    if any(not r.hints and not r.screen for r in rules):
        tests = [F.lit(True)]
    return reduce(Column.__or__, tests, F.lit(False))


def _scan(rules: Sequence[Rule]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {f"{r.kind}:{r.version}": r for r in rules}

        def rows():
            for part in parts:
                for blob, text, todo in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    text = text or ""  # null: nothing can match
                    lowered = text.lower()
                    yield blob, [{"kind": (r := by_name[n]).kind, "version": r.version, "spans": find(r, text, lowered)} for n in todo]

        yield from common.batches(rows(), _LEDGER_ARROW)

    return run


def _read_ledger(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def update_ledger(versions: DataFrame, ledger: str, text_col: str = "text", rules: Sequence[Rule] = RULES) -> None:
    """Scan the (blob, rule version) pairs of ``versions`` that the ledger table at ``ledger`` lacks, and append them."""
    spark = versions.sparkSession
    common.bound_batches(spark)
    names = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    text = common.text_or_empty(text_col)
    blobs = (versions.select(F.unhex(F.sha2(text, 256)).alias("blob"), F.when(_may_match(text, rules), text).alias("text"))
             .groupBy("blob").agg(F.first("text").alias("text")))
    known = _read_ledger(spark, ledger)
    if known is None:
        todo = blobs.select("blob", "text", names.alias("todo"))
    else:
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(F.transform(
            "scans", lambda s: F.concat_ws(":", s["kind"], s["version"].cast("string")))))).alias("seen"))
        todo = (blobs.join(seen, "blob", "left")
                .select("blob", "text", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
                .where(F.size("todo") > 0))
    todo.mapInArrow(_scan(rules), _LEDGER).write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, keys: Sequence[str] = ("doc_id",), text_col: str = "text",
             rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``versions``: the key columns, ``blob_sha256`` and ``scans`` of the current rule versions.

    A pair that was appended more than once (two scanners at a time, a scan that ran again) counts once: its scans are
    the same, as they depend on the blob and the rule version alone.
    """
    spark = versions.sparkSession
    names = [f"{r.kind}:{r.version}" for r in rules]
    per_blob = _read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.filter(
        F.flatten(F.collect_list("scans")), lambda s: F.concat_ws(":", s["kind"], s["version"].cast("string")).isin(names))).alias("scans"))
    paths = versions.select(*[F.col(k) for k in keys], F.unhex(F.sha2(common.text_or_empty(text_col), 256)).alias("blob"))
    return paths.join(per_blob, "blob").select(*keys, F.lower(F.hex("blob")).alias("blob_sha256"), "scans")


def scan(versions: DataFrame, ledger: str, keys: Sequence[str] = ("doc_id",), text_col: str = "text",
         rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``versions`` and return :func:`findings`.

    * A null text is the empty blob. Rows that repeat, and paths that share a blob, each get their row.
    * Only the key columns and the text are read, so other columns may have any name.
    * An empty table appends nothing and returns nothing.
    """
    update_ledger(versions, ledger, text_col, rules)
    return findings(versions, ledger, keys, text_col, rules)


def with_digests(found: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    spans = F.array_sort(F.flatten(F.transform("scans", lambda s: F.transform(s["spans"], lambda p: F.struct(
        p["start"].alias("start"), order[s["kind"]].alias("rank"), p["stop"].alias("stop"), s["kind"].alias("kind"))))))
    shown = lambda column: F.array_join(F.transform(column, lambda p: F.concat_ws(
        ":", p["kind"], p["start"].cast("string"), p["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("all_spans", lambda p: p["kind"] == kind)).cast("bigint")
    counts = [count(r.kind).alias(f"n_{r.kind}") for r in base]
    return found.withColumn("all_spans", spans).select(
        "doc_id", *counts, F.sha2(shown(F.filter("all_spans", lambda p: p["rank"] < len(base))), 256).alias("base_sha256"),
        shown(F.col("all_spans")).alias("spans"))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The ledger meets the base rules first and all rules after, so the second scan runs the unseen pairs alone."""
    docs, ledger = common.table(spark, sf_dir, "documents"), scratch_path(spark, "secret-ledger")
    update_ledger(docs, ledger, rules=BASE_RULES)
    return with_digests(scan(docs, ledger))


def _oracle() -> str:
    """Match positions from the lengths of the pieces between the matches and of the matches themselves."""
    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT id, {rank} AS rank, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
    start := (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT,
    size := length(m[i]), held := length(g[i])))) AS x
  FROM (SELECT id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.group}) AS g,
               regexp_split_to_array(text, '{p}') AS s FROM d WHERE regexp_matches(text, '{p}'))""")
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
spans AS (SELECT id, rank, kind, x.start AS start, x.start + x.size AS stop FROM found WHERE x.held >= CASE rank {least} END),
per AS (
  SELECT id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE_RULES)}) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (id)
"""


ORACLE_SQL = _oracle()
