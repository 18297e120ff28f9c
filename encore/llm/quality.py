"""Quality rules as weak supervision, in DataFrame and SQL functions only.

Each rule looks at counts of one document and votes good, votes bad or
abstains. Expectation-maximisation over the counts of vote patterns (at most
3^rules rows, whatever the number of documents; documents that fail the base
checks have their verdict already and are left out) estimates how often each rule
casts each vote on good and on bad documents, and the share of good ones. A
document is kept by the posterior probability that it is good, not by having
to pass every rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm import common

BAD, ABSTAIN, GOOD = 0, 1, 2
ITERATIONS = 25
SMOOTHING = 1.0
START_ACCURACY = 0.8
KEEP_FROM = 0.5

FUNCTION_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "this", "was", "are", "on", "it", "be",
    "der", "die", "und", "das", "den", "von", "nicht", "mit", "im", "ein", "auf", "als",
    "de", "la", "le", "les", "et", "des", "un", "une", "du", "que", "est", "dans", "pour",
    "el", "los", "las", "en", "se", "por", "con", "del", "al",
)

# (name, votes bad when, votes good when): SQL conditions over the counts, the same text in Spark and in the check
RULES = (
    ("symbols", "100 * n_symbols > 10 * n_words", "100 * n_symbols <= 2 * n_words"),
    ("capitals", "100 * n_upper > 30 * word_chars", "100 * n_upper <= 10 * word_chars"),
    ("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("lines", "100 * n_dup_lines > 30 * n_lines", "n_dup_lines = 0 AND n_lines >= 2"),
    ("function_words", "100 * n_function < 3 * n_words", "100 * n_function >= 8 * n_words"),
    ("word_length", "word_chars > 12 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    ("sentences", "100 * n_ends > 40 * n_words OR (n_ends = 0 AND n_words >= 50)", "100 * n_ends BETWEEN 2 * n_words AND 25 * n_words"),
    ("length", "n_words < 30", "n_words >= 80"),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_function", "n_ends")
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(words: str) -> str:
    """SQL: words inside 3-word windows that occur twice or more in the array ``words``.

    The windows' hashes are sorted as longs whose low 31 bits are the window's place (a primitive sort); only windows
    whose remaining 33 bits meet are then compared by their whole hash, so the cost stays n log n on any text.
    """
    low = 2 ** 31 - 1
    meets = "(x & ~{m}L)"
    same = meets.format(m=low)
    near = (f"filter(s, (x, k) -> (k > 0 AND {same} = (s[greatest(k - 1, 0)] & ~{low}L)) "
            f"OR (k < size(s) - 1 AND {same} = (s[least(k + 1, size(s) - 1)] & ~{low}L)))")
    exact = f"array_sort(transform(c, x -> struct(h[cast(x & {low}L as int)] AS h, cast(x & {low}L as int) AS i)))"
    places = ("sort_array(transform(filter(e, (x, k) -> (k > 0 AND x.h = e[greatest(k - 1, 0)].h) "
              "OR (k < size(e) - 1 AND x.h = e[least(k + 1, size(e) - 1)].h)), x -> x.i))")
    covered = ("aggregate(p, named_struct('last', -10, 'n', 0L), "
               "(a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)), a -> a.n)")
    hashes = f"transform(slice({words}, 1, size({words}) - 2), (x, i) -> xxhash64(x, {words}[i + 1], {words}[i + 2]))"
    tail = _let(exact, "e", _let(places, "p", covered))
    found = _let(hashes, "h", _let(f"sort_array(transform(h, (x, i) -> (x & ~{low}L) | cast(i as bigint)))", "s",
                                   _let(near, "c", f"CASE WHEN size(c) = 0 THEN 0L ELSE {tail} END")))
    return f"CASE WHEN size({words}) < 4 THEN 0L ELSE {found} END"


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id`` and the counts the rules look at, for every row; a null text has no words."""
    text = docs.select(F.col(id_col).alias("row_id"), common.text_or_empty(text_col).alias("text"))
    # \x20 and \x09-\x0D separate words
    listed = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    body = ("named_struct("
            "'n_words', cast(size(w) as bigint), "
            f"'n_repeat_words', {_repeat_words('w')}, "
            f"'n_function', cast(size(filter(w, x -> x IN ({listed}))) as bigint), "
            "'n_ends', cast(size(filter(w, x -> right(x, 1) IN ('.', '!', '?'))) as bigint))")
    words = _let(r"filter(split(text, '[\\x20\\x09-\\x0D]+', -1), x -> x <> '')", "w", body)
    lines = _let(r"filter(split(text, '\\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]')", "l",
                 "named_struct('n_lines', cast(size(l) as bigint), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint))")

    def without(pattern: str) -> Column:
        return F.length(F.regexp_replace("text", pattern, "")).cast("bigint")

    made = text.select("row_id", F.expr(words).alias("w"), F.expr(lines).alias("l"),
                       without(r"[\x20\x09-\x0D]+").alias("word_chars"),
                       (F.length("text") - without(r"[#*$%&|<>]+")).alias("n_symbols"),
                       (F.length("text") - without(r"\p{Lu}+")).alias("n_upper"))
    return made.select("row_id", *[F.col(c) if c in ("word_chars", "n_symbols", "n_upper") else
                                   F.col(f"{'l' if c in ('n_lines', 'n_dup_lines') else 'w'}.{c}").alias(c) for c in COUNTS])


def vote_sql(bad: str, good: str) -> str:
    return f"CASE WHEN {bad} THEN {BAD} WHEN {good} THEN {GOOD} ELSE {ABSTAIN} END"


def with_votes(counted: DataFrame, rules=RULES) -> DataFrame:
    """One vote column ``vote_<rule>`` per rule."""
    return counted.select("*", *[F.expr(vote_sql(bad, good)).alias(f"vote_{name}") for name, bad, good in rules])


def posteriors(voted: DataFrame, rules=RULES, iterations: int = ITERATIONS) -> DataFrame:
    """``votes`` (a pattern, as array of int) and ``p_good``, for every pattern that occurs: at most 3^rules rows.

    The whole of expectation-maximisation is one SQL expression over the one-row array of pattern counts. Its state is
    ``b``, the log odds of a good document, and ``w``, per rule and vote the log ratio of that vote's probability on
    good and on bad documents.
    """
    votes = [f"vote_{name}" for name, *_ in rules]
    cells = F.array(*[F.lit(3 * j) + F.col(v) for j, v in enumerate(votes)]).alias("cells")
    patterns = voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).select(F.struct(cells, F.col("n").cast("double").alias("n")).alias("x"))
    one = patterns.agg(F.array_sort(F.collect_list("x")).alias("ps"))
    right, wrong = START_ACCURACY, 1.0 - START_ACCURACY
    start = f"array({', '.join(f'ln({a!r}D) - ln({b!r}D)' for _ in rules for a, b in ((wrong, right), (1.0, 1.0), (right, wrong)))})"
    s = f"{SMOOTHING!r}D"
    # e-step: the posterior of every pattern under the state a
    scored = "transform(ps, x -> named_struct('cells', x.cells, 'n', x.n, 'p', 1D / (1D + exp(-(a.b + aggregate(x.cells, 0D, (t, c) -> t + a.w[c]))))))"
    mass = lambda share, where: f"aggregate(q, 0D, (t, x) -> t + {f'IF(array_contains(x.cells, c), x.n * {share}, 0D)' if where else f'x.n * {share}'})"
    good, bad = mass("x.p", False), mass("(1D - x.p)", False)
    step = (f"named_struct('b', ln(({good} + {s}) / ({bad} + {s})), 'w', " + _let(f"array({good}, {bad})", "m", (
        f"transform(sequence(0, {3 * len(rules) - 1}), c -> ln(({mass('x.p', True)} + {s}) / (m[0] + 3 * {s})) "
        f"- ln(({mass('(1D - x.p)', True)} + {s}) / (m[1] + 3 * {s})))")) + ")")
    state = (f"aggregate(sequence(1, {iterations}), named_struct('b', 0D, 'w', {start}), (a, i) -> {_let(scored, 'q', step)}, "
             f"a -> {scored})")
    final = one.where(F.size("ps") > 0).select(F.explode(F.expr(state)).alias("x"))
    place = [(F.col("x.cells")[j] - F.lit(3 * j)).alias(v) for j, v in enumerate(votes)]
    return final.select(*place, F.col("x.p").alias("p_good"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: the id, the counts, the votes, ``p_good``, ``base_failed`` and ``kept``.

    * A null or empty text has no words, fails the base and is not kept. Rows that repeat come back as often.
    * A posterior of exactly ``KEEP_FROM`` is kept.
    * Ids may be null or repeat: no step joins on them. Other columns, whatever their names, are not read.
    * An empty table gives an empty result.
    """
    counted = common.written(with_votes(counts(docs, id_col, text_col), rules), "quality-counts")
    by = [f"vote_{name}" for name, *_ in rules]
    # 3^rules rows at most
    passed = counted.where(f"NOT ({BASE_FAILED})")  # the rest needs no verdict and would teach the rules its own faults
    judged = counted.join(F.broadcast(posteriors(passed, rules)), by, "left")
    return judged.withColumn("base_failed", F.expr(BASE_FAILED)).select(
        F.col("row_id").alias(id_col), *COUNTS, *by, "p_good", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("p_good") >= KEEP_FROM, F.lit(False))).alias("kept"))


def kept_rows(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names.

    Nulls and ties as in :func:`quality`; rows that repeat are judged alike and all stay. An empty table stays empty.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return quality(rows, "row", "text", rules).where("kept").select("row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = quality(common.table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same counts, votes and iterations in DuckDB; repeated windows by grouping the windows of each row."""
    listed = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    votes = ", ".join(f"{vote_sql(bad, good)} AS vote_{name}" for name, bad, good in RULES)
    names = ", ".join(f"vote_{name}" for name, *_ in RULES)
    cells = ", ".join(f"{3 * j} + vote_{name}" for j, (name, *_) in enumerate(RULES))
    a, b, s = START_ACCURACY, 1.0 - START_ACCURACY, SMOOTHING
    start = ", ".join(f"(ln({x}::DOUBLE / {y}::DOUBLE))" for _ in RULES for x, y in ((b, a), (1.0, 1.0), (a, b)))
    score = "list_transform(ps, lambda x: 1.0 / (1.0 + exp(-(b + list_sum(list_transform(x.cells, lambda c: w[c + 1]))))))"
    mass = lambda share: f"list_sum(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN list_contains(ps[i].cells, c) THEN ps[i].n * {share} ELSE 0.0 END))"
    whole = lambda share: f"list_sum(list_transform(range(1, len(ps) + 1), lambda i: ps[i].n * {share}))"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
windows AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
            FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2)),
twice AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
repeats AS (SELECT id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY id),
counted AS (
  SELECT d.id, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')))::BIGINT AS n_upper,
         len(list_filter(w, lambda x: x IN ({listed})))::BIGINT AS n_function,
         len(list_filter(w, lambda x: right(x, 1) IN ('.', '!', '?')))::BIGINT AS n_ends
  FROM d JOIN words USING (id) LEFT JOIN repeats r USING (id)),
voted AS (SELECT *, {votes} FROM counted),
grouped AS (SELECT {names}, count(*)::DOUBLE AS n FROM voted WHERE NOT ({BASE_FAILED}) GROUP BY ALL),
patterns AS (SELECT list(struct_pack(cells := [{cells}], n := n) ORDER BY {names}) AS ps, list(struct_pack({", ".join(f"vote_{name} := vote_{name}" for name, *_ in RULES)}) ORDER BY {names}) AS vs FROM grouped),
em AS (
  SELECT 0 AS i, 0.0::DOUBLE AS b, [{start}]::DOUBLE[] AS w
  UNION ALL
  SELECT i + 1, ln(({whole("q[i]")} + {s}) / ({whole("(1.0 - q[i])")} + {s})),
         list_transform(range(0, {3 * len(RULES)}), lambda c: ln(({mass("q[i]")} + {s}) / ({whole("q[i]")} + 3 * {s}))
           - ln(({mass("(1.0 - q[i])")} + {s}) / ({whole("(1.0 - q[i])")} + 3 * {s})))
  FROM (SELECT em.i, ps, {score} AS q FROM em, patterns WHERE em.i < {ITERATIONS})),
final AS (SELECT unnest(vs) AS v, unnest({score}) AS p_good FROM em, patterns WHERE em.i = {ITERATIONS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
       NOT ({BASE_FAILED}) AND coalesce(p_good >= {KEEP_FROM}, false) AS kept
FROM voted LEFT JOIN final ON {" AND ".join(f"voted.vote_{name} = v.vote_{name}" for name, *_ in RULES)}
"""


ORACLE_SQL = _oracle()
