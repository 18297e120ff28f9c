"""Maximal segments against brute force; held-out accuracy and row-by-row results of the query; odd rows."""

import math

import pytest
from conftest import SF_MID
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from encore.llm import common, toxicity

SF_LARGE = "/root/testdata/sf0.1"


def maximal_by_definition(scores):
    """The best segment (shortest, then first), then the same on both sides of it, as long as it is positive."""
    def best(low, high):
        found = None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += scores[j]
                if total > 0 and (found is None or total > found[2] + 1e-9 or (abs(total - found[2]) <= 1e-9 and j - i < found[1] - found[0])):
                    found = (i, j, total)
        return [] if found is None else [*best(low, found[0]), found, *best(found[1] + 1, high)]

    return best(0, len(scores))


@given(st.lists(st.one_of(st.just(0), st.integers(1, 9)), max_size=40), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_segments_are_the_maximal_ones(marks, rest):
    rest += 0.37  # no ties between segments that end or begin at a sum of zero
    got = toxicity.maximal_segments([(i, float(s)) for i, s in enumerate(marks) if s], -rest)
    want = maximal_by_definition([float(s) if s else -rest for s in marks])
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(math.isclose(x[2], y[2]) for x, y in zip(got, want, strict=True))


def test_words_back_off_to_prefixes():
    scores = toxicity.TokenScores({"vequ~": 2.0, "vequtax": 5.0, "idiot": 3.0})
    assert [scores[w] for w in ("Vequtax", "vequée", "veq", "IDIOT", "idiots", "x")] == [5.0, 2.0, 0.0, 3.0, 0.0, 0.0]


def test_rate_solves_its_equation():
    rate = toxicity._decay([(0.01, 3.0), (0.99, -0.2)])
    assert math.isclose(0.01 * math.exp(3 * rate) + 0.99 * math.exp(-0.2 * rate), 1.0, rel_tol=1e-6)


def test_held_out_accuracy(spark):
    got = E.queries()["op11_toxicity"](spark, SF_LARGE)
    labels = spark.read.parquet(f"{SF_LARGE}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{SF_LARGE}/documents.parquet")
    assert got.count() == docs.count()
    assert got.where("score < 0 or score > 1 or predicted != cast(score >= 0.5 as int)").count() == 0
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).count() == 0
    rates = {r["toxic"]: r["p"] for r in got.where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rates[1] >= 0.85 and rates[0] <= 0.03


def test_every_row_of_the_query_by_the_model(spark):
    docs, labels = (common.table(spark, SF_MID, t) for t in ("documents", "labels"))
    keep = ~toxicity.held_out()
    model = toxicity.learn(docs.where(keep), labels.where(keep))
    assert "idiot" in model.scores and model.rest < 0 < model.factor and math.isclose(model.rate, 1.0, abs_tol=1e-3)
    scanner = toxicity.Scanner(model)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in E.queries()["op11_toxicity"](spark, SF_MID).collect():
        n, found = scanner.segments(texts[row["doc_id"]])
        score, kept = scanner.score(texts[row["doc_id"]])
        assert row["score"] == score
        scores = [scanner.tokens[w] or model.rest for w in toxicity._WORD.findall(texts[row["doc_id"]])]
        assert len(scores) == n and all(math.isclose(sum(scores[a:b + 1]), s, abs_tol=1e-6) for a, b, s in found)
        assert row["passages"] == ",".join(f"{p['start']}:{p['stop']}" for p in kept)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = (common.table(spark, SF_MID, t) for t in ("documents", "labels"))
    keep = ~toxicity.held_out()
    turned = labels.withColumn("toxic", F.when(keep, F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert toxicity.learn(docs.where(keep), turned.where(keep)) == toxicity.learn(docs.where(keep), labels.where(keep))


LABELLED = "doc_id bigint, toxic int"


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(1, 0), (2, 0)], [(None, 1), (None, 0)], [(1, None), (2, 7)]])
def test_nothing_to_learn_gives_score_zero(spark, rows):
    docs = spark.createDataFrame([(1, "some idiot"), (2, None), (2, ""), (None, "x")], "doc_id bigint, text string")
    model = toxicity.learn(docs, spark.createDataFrame(rows, LABELLED))
    out = toxicity.passages(docs, model).collect()
    assert sorted((r["row_id"] or 0, r["score"], r["passages"]) for r in out) == [(0, 0.0, []), (1, 0.0, []), (2, 0.0, []), (2, 0.0, [])]


def test_passages_of_long_and_odd_texts(spark):
    clean = "the cat sat on the mat and the dog ran to the house by the river "
    texts = {1: clean * 2000 + "you utter idiot, idiot scum " + clean * 2000, 2: clean, 3: None, 4: "", 5: "... 42", 6: "İdiot İ idiot́"}
    model = toxicity.Model({"idiot": 6.0, "scum": 6.0}, -0.05, 1.0, 0.01, 0.1, 20.0)
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id bigint, text string").selectExpr("*", "'c' AS score", "'c' AS passages", "0 AS row_id")
    out = toxicity.passages(docs, model).collect()
    assert len(out) == 7
    for r in out:
        if r["row_id"] == 1:
            (p,) = r["passages"]
            assert texts[1][p["start"]:p["stop"]] == "idiot, idiot scum" and r["score"] > 0.5
        elif r["row_id"] != 6:
            assert r["passages"] == [] and r["score"] < 0.01
