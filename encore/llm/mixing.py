"""Mixing sources to target weights by hierarchical budgeting, in DataFrame and SQL functions only.

The corpus is a tree of domains, languages and sources. A token budget goes
down the tree: at every node it is shared among the children by their weights,
and what a child cannot use (its capacity is its tokens times ``max_epochs``)
goes to its siblings by the same weights. Because a node never gets more than
its subtree's capacity, a shortage reaches the node's own siblings only when
all of its children are used up.

Each leaf then takes whole epochs, and of its last epoch the documents that
come first in that epoch's seeded order, as long as their tokens fit. The order
is an MD5 over (seed, epoch, id), then the token count, then the row's place in
the table. A leaf, or one id in it, may hold any share of all rows, so no task
orders a whole leaf: the tokens are summed by ranges of the order, one range
per leaf holds the cut, and only its distinct (id, token count) pairs are
ordered. Of the pair at the cut, the rows are counted by the tasks that wrote
them, and only one such task's rows are ordered. Rows meet their leaf's
decision by (leaf, salt), with several salts for leaves of many rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.llm import common

LEVELS = ("domain", "lang", "source")
RANGE_DIGITS = 3  # a leaf's order is cut into 16^3 ranges
SALTS = 256  # parts of a leaf that holds more than one in HOT_SHARE of all rows, of which there are at most HOT_SHARE
HOT_SHARE = 1000
SEED = 17
MAX_EPOCHS = 3
BUDGET_PERCENT = 60  # of all tokens
# Target weights by level and name; others weigh 1.
WEIGHTS: Mapping[str, Mapping[str, int]] = {
    "domain": {"web": 4, "books": 3, "code": 2, "talk": 1},
    "lang": {"en": 5, "fr": 2, "de": 2, "es": 1},
    "source": {"src0": 2},
}
# The domain of a source, by the first hexadecimal digit of its MD5: the same text in Spark and in the check.
DOMAIN_SQL = ("CASE WHEN substr(md5(source), 1, 1) < '4' THEN 'web' WHEN substr(md5(source), 1, 1) < '8' THEN 'books' "
              "WHEN substr(md5(source), 1, 1) < 'c' THEN 'code' ELSE 'talk' END")


def n_words(text: Column) -> Column:
    """Words of a text between \\x20 and \\x09-\\x0D; a null text has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")).cast("bigint")


def with_tree(docs: DataFrame, domain_sql: str = DOMAIN_SQL) -> DataFrame:
    """``node_domain, node_lang, node_source`` of each row; null names are the empty name."""
    named = docs.select("*", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("node_lang"),
                        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("node_source"))
    return named.withColumn("node_domain", F.expr(domain_sql.replace("source", "node_source")))


NODES = tuple(f"node_{level}" for level in LEVELS)


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    known = weights.get(level, {})
    if not known:
        return F.lit(1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in known.items() for x in item]), F.col(f"node_{level}")), F.lit(1))


def budgets(leaves: DataFrame, budget: Column, max_epochs: int = MAX_EPOCHS,
            weights: Mapping[str, Mapping[str, int]] = WEIGHTS) -> DataFrame:
    """``leaves`` (nodes, ``leaf_tokens``, ``all_tokens``, any more) with ``leaf_budget``; ``budget`` may use ``all_tokens``.

    Children are taken by capacity per weight. A child is used up when its share of what is left, by the weights of
    those not yet used up, reaches its capacity; the others share the rest. All sums are exact integers.
    """
    wide = "decimal(38,0)"
    tree = leaves.withColumn("capacity", F.col("leaf_tokens") * max_epochs)
    tree = tree.withColumn("budget", F.least(budget, F.col("all_tokens") * max_epochs))
    for depth, level in enumerate(LEVELS):
        parent, path = list(NODES[:depth]), list(NODES[:depth + 1])
        nodes = tree.groupBy(*path).agg(F.sum("capacity").alias("cap"), F.first("budget").alias("b")).withColumn("w", _weight(level, weights))
        siblings = Window.partitionBy(*parent)
        upto = siblings.orderBy(F.col("cap").cast("double") / F.col("w"), path[-1])
        before = upto.rowsBetween(Window.unboundedPreceding, -1)
        onward = upto.rowsBetween(0, Window.unboundedFollowing)
        nodes = (nodes.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0)))
                 .withColumn("open", F.sum("w").over(onward))
                 .withColumn("full", F.col("cap").cast(wide) * F.col("open") <= (F.col("b") - F.col("used")).cast(wide) * F.col("w"))
                 .withColumn("rest", F.col("b") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(siblings))
                 .withColumn("share", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(siblings)))
        given = F.when(F.col("full"), F.col("cap")).otherwise(F.expr(
            "cast((cast(rest as decimal(28,0)) * cast(w as decimal(9,0))) div cast(greatest(share, 1) as decimal(18,0)) as bigint)"))
        tree = tree.drop("budget").join(nodes.select(*path, given.alias("budget")), path)
    return tree.drop("capacity").withColumnRenamed("budget", "leaf_budget")


def _key(epoch: Column, seed: int, id_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def with_leaf(rows: DataFrame, leaf: DataFrame) -> DataFrame:
    """``rows`` with the columns of their leaf; leaves of many rows are met in ``salts`` parts."""
    hot = leaf.where("salts > 1").select(*NODES, F.col("salts").alias("parts"))
    dealt = rows.join(F.broadcast(hot), list(NODES), "left")  # at most HOT_SHARE rows
    dealt = dealt.withColumn("salt", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod("mark", "parts")).cast("int")).drop("parts")
    each = leaf.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return dealt.join(each, [*NODES, "salt"]).drop("salt")


def decisions(rows: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
              weights: Mapping[str, Mapping[str, int]] = WEIGHTS) -> DataFrame:
    """One row per leaf: its tokens and budget, ``epochs`` taken whole, and the cut in the next epoch's order; written.

    ``rows`` has the nodes, ``row_id``, ``n_tokens`` and ``mark`` (unique, from monotonically_increasing_id). The first
    row that no longer fits is in the range ``cut_range`` and has ``cut_key`` and ``cut_tokens``; of the rows with these
    two, those up to ``cut_mark`` still fit (null: none).
    """
    # the tree's tables have a row per leaf; written, so that no level computes them again
    leaves = common.written(rows.groupBy(*NODES).agg(F.sum("n_tokens").alias("leaf_tokens"), F.count(F.lit(1)).alias("leaf_rows")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("leaf_tokens"), F.lit(0)).alias("all_tokens"), F.sum("leaf_rows").alias("all_rows"))
    given = budgets(leaves.crossJoin(F.broadcast(total)),  # one row
                    F.expr(f"(all_tokens * {int(budget_percent)}) div 100"), max_epochs, weights)
    whole = F.when(F.col("leaf_tokens") > 0, F.expr("leaf_budget div leaf_tokens")).otherwise(F.lit(0)).cast("bigint")
    salts = F.when(F.col("leaf_rows") * HOT_SHARE > F.col("all_rows"), F.lit(SALTS)).otherwise(F.lit(1))
    leaf = common.written(given.withColumn("epochs", whole).withColumn("rest", F.col("leaf_budget") - F.col("epochs") * F.col("leaf_tokens"))
                          .withColumn("salts", salts).drop("leaf_rows", "all_rows", "all_tokens"), "mix-budgets")
    key = _key(F.col("epochs"), seed, "row_id")
    # rows of one id collapse in each task: a row per task that wrote some
    counted = (with_leaf(rows, leaf.select(*NODES, "epochs", "rest", "salts"))
               .select(*NODES, "rest", "n_tokens", key.alias("key"), F.shiftright("mark", 33).alias("part"))
               .groupBy(*NODES, "key", "n_tokens", "part").agg(F.count(F.lit(1)).alias("m"), F.first("rest").alias("rest"))
               .withColumn("range", F.substring("key", 1, RANGE_DIGITS)))
    by_leaf = Window.partitionBy(*NODES)
    ranges = counted.groupBy(*NODES, "range").agg(F.sum(F.col("n_tokens") * F.col("m")).alias("n"), F.first("rest").alias("rest")).withColumn(
        "end", F.sum("n").over(by_leaf.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))
    cut = ranges.where((F.col("end") > F.col("rest")) & (F.col("end") - F.col("n") <= F.col("rest"))).select(
        *NODES, "range", (F.col("end") - F.col("n")).alias("cut_from"))
    inside = common.written(counted.join(cut, [*NODES, "range"]), "mix-cuts")
    pairs = inside.groupBy(*NODES, "range", "key", "n_tokens").agg(
        F.sum("m").alias("m"), F.first("rest").alias("rest"), F.first("cut_from").alias("cut_from"))
    pairs = pairs.withColumn("n", F.col("n_tokens") * F.col("m")).withColumn("end", F.col("cut_from") + F.sum("n").over(
        by_leaf.orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)))
    last = pairs.where((F.col("end") > F.col("rest")) & (F.col("end") - F.col("n") <= F.col("rest"))).select(
        *NODES, F.col("range").alias("cut_range"), F.col("key").alias("cut_key"), F.col("n_tokens").alias("cut_tokens"),
        F.expr("(rest - (end - n)) div n_tokens").alias("fit"))
    # the task in whose rows the last fitting copy is, and which of them it is
    copies_of = inside.select(*NODES, F.col("key").alias("cut_key"), F.col("n_tokens").alias("cut_tokens"), "part", "m").join(
        last.where("fit > 0"), [*NODES, "cut_key", "cut_tokens"])
    copies_of = copies_of.withColumn("upto", F.sum("m").over(by_leaf.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    at = copies_of.where((F.col("upto") >= F.col("fit")) & (F.col("upto") - F.col("m") < F.col("fit"))).select(
        *NODES, "cut_key", "cut_tokens", "part", (F.col("fit") - F.col("upto") + F.col("m")).alias("nth"))
    own = rows.withColumn("part", F.shiftright("mark", 33)).withColumnRenamed("n_tokens", "cut_tokens").join(
        at.join(leaf.select(*NODES, "epochs"), list(NODES)), [*NODES, "part", "cut_tokens"]).where(key == F.col("cut_key"))
    marks = own.withColumn("copy", F.row_number().over(by_leaf.orderBy("mark"))).where("copy = nth").select(
        *NODES, F.col("mark").alias("cut_mark"))
    return common.written(leaf.drop("rest").join(last.drop("fit"), list(NODES), "left").join(marks, list(NODES), "left"), "mix-decisions")


def copies(seed: int) -> Column:
    """How often a row (``row_id, n_tokens, mark``) is taken, next to its leaf's decision."""
    key = _key(F.col("epochs"), seed, "row_id")
    same = (key == F.col("cut_key")) & (F.col("n_tokens") == F.col("cut_tokens"))
    before = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (F.col("n_tokens") < F.col("cut_tokens")))
    taken = F.col("cut_key").isNull() | before | (same & F.coalesce(F.col("mark") <= F.col("cut_mark"), F.lit(False)))
    return F.col("epochs") + F.when(taken, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_sql: str = DOMAIN_SQL,
               whole_rows: bool = False) -> DataFrame:
    """``row_id``, the nodes, ``n_tokens`` and ``mark`` of each row, counted once and written; with ``whole_rows`` also ``row``."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    tree = with_tree(docs.select(*row, F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"), "lang", "source"), domain_sql)
    return common.written(tree.select(*(["row"] if row else []), "row_id", *NODES, n_words(F.col("text")).alias("n_tokens"),
                                      F.monotonically_increasing_id().alias("mark")), "mix-tokens")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget_percent: int = BUDGET_PERCENT,
        max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
        domain_sql: str = DOMAIN_SQL) -> DataFrame:
    """One row per input row: id, nodes, ``n_tokens``, its leaf's tokens and budget, and ``copies`` (0: not taken).

    * A null text has no tokens; a null language or source is the node with the empty name; a null id is an id.
    * Rows with the same id and token count in one leaf are taken one by one, in the order of the table.
    * A leaf without tokens is taken once. Only id, text, lang and source are read; an empty table gives none.
    """
    rows = token_rows(docs, id_col, text_col, domain_sql)
    joined = with_leaf(rows, decisions(rows, budget_percent, max_epochs, seed, weights))
    return joined.select(F.col("row_id").alias(id_col), *[F.col(n).alias(level) for n, level in zip(NODES, LEVELS, strict=True)],
                         "n_tokens", "leaf_tokens", "leaf_budget", copies(seed).alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget_percent: int = BUDGET_PERCENT,
          max_epochs: int = 1, seed: int = SEED, weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
          domain_sql: str = DOMAIN_SQL) -> DataFrame:
    """The rows of ``docs`` that are taken, with all their columns, whatever their names, as often as they are taken.

    Nulls, repeated rows and empty tables as in :func:`mix`.
    """
    rows = token_rows(docs, id_col, text_col, domain_sql, whole_rows=True)
    joined = with_leaf(rows, decisions(rows.drop("row"), budget_percent, max_epochs, seed, weights))
    return joined.select("row", copies(seed).cast("int").alias("n")).where("n > 0").select(
        "row", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("copy")).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same budgets level by level; the cut by ordering every leaf's rows."""
    case = lambda level: " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items())
    parts = [f"""
d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
t AS (SELECT *, {DOMAIN_SQL} AS domain FROM d),
l0 AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS leaf_tokens, sum(n_tokens)::HUGEINT * {MAX_EPOCHS} AS capacity FROM t GROUP BY ALL),
b0 AS (SELECT *, least(sum(leaf_tokens) OVER () * {BUDGET_PERCENT} // 100, sum(capacity) OVER ())::HUGEINT AS budget FROM l0)"""]
    for depth, level in enumerate(LEVELS):
        path, parent = ", ".join(LEVELS[:depth + 1]), ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {parent} " if parent else ""
        order = f"{by}ORDER BY cap::DOUBLE / w, {level}"
        parts.append(f"""
n{depth} AS (SELECT {path}, sum(capacity)::HUGEINT AS cap, any_value(budget) AS b, (CASE {level} {case(level)} ELSE 1 END)::HUGEINT AS w FROM b{depth} GROUP BY {path}),
u{depth} AS (SELECT *, cap * sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
               <= (b - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS full_ FROM n{depth}),
g{depth} AS (SELECT {path}, CASE WHEN full_ THEN cap ELSE (b - coalesce(sum(cap) FILTER (full_) OVER ({by}), 0)) * w
               // greatest(sum(w) FILTER (NOT full_) OVER ({by}), 1) END AS budget FROM u{depth}),
b{depth + 1} AS (SELECT b.* EXCLUDE (budget), g.budget FROM b{depth} b JOIN g{depth} g USING ({path}))""")
    return f"""
WITH {",".join(parts)},
leaf AS (SELECT domain, lang, source, leaf_tokens, budget AS leaf_budget,
                CASE WHEN leaf_tokens > 0 THEN budget // leaf_tokens ELSE 0 END AS epochs FROM b{len(LEVELS)}),
k AS (SELECT t.*, leaf_tokens, leaf_budget, epochs, leaf_budget - epochs * leaf_tokens AS rest,
             md5('{SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM t JOIN leaf USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens::BIGINT AS leaf_tokens, leaf_budget::BIGINT AS leaf_budget,
       (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
"""


ORACLE_SQL = _oracle()
