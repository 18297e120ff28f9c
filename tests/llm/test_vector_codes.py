"""Vector codes against brute force (every row and odd rows); the query has SQL (test_queries)."""

import hashlib
import math

import numpy as np
import pytest

from encore.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    whole = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
             if v and all(x is not None and math.isfinite(x) for x in v)]
    if not whole:
        return []
    width = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    seeds = {}
    for i, v, _ in whole:
        if i is not None:
            seeds[i] = min(v, seeds.get(i, v))
    books = [[cut(seeds[i], p) for i in sorted(seeds)[:entries]] for p in range(parts)]

    def nearest(p, x):
        far = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        held = [[[] for _ in books[p]] for p in range(parts)]
        for _, v, _ in whole:
            for p in range(parts):
                held[p][nearest(p, cut(v, p))[0]].append(cut(v, p))
        books = [[[sum(c) // len(h) for c in zip(*h, strict=True)] if h else old for h, old in zip(held[p], books[p], strict=True)]
                 for p in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, per_label = [], {}
    for i, v, label in whole:
        best = [nearest(p, cut(v, p)) for p in range(parts)]
        error = sum(d for _, d in best)
        per_label[label] = per_label.get(label, 0) + error
        out.append((i, label, "".join(f"{e:02x}" for e, _ in best), error))
    return sorted(((i, label, c, e, per_label[label], sha) for i, label, c, e in out), key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def rows(n, seed=0, width=32, copies=0):
    rng = np.random.default_rng(seed)
    made = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, width)], int(i) % 3) for i in rng.permutation(n)]
    return made + [(n + k, made[0][1], 0) for k in range(copies)]


@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_equals_brute_force_with_one_vector_held_by_a_third_of_the_rows(spark, rounds):
    data = rows(140, copies=70)
    got = vector_codes.compress(spark.createDataFrame(data, SCHEMA).repartition(3), rounds=rounds)
    assert collected(got) == brute(data, rounds=rounds)


def test_odd_rows(spark):
    good = rows(20, seed=1)
    nan, inf = float("nan"), float("inf")
    bad = [(50, None, 1), (51, [], 1), (52, [None] * 32, 1), (53, [nan] + [0.0] * 31, 1), (54, [0.0] * 31 + [-inf], None)]
    odd = [(None, good[0][1], None), (None, good[0][1], None), (3, good[2][1], None), (3, good[2][1], 2), (60, [1e5] * 32, 2), (61, [-3e6] * 32, 2)]
    df = spark.createDataFrame(good + bad + odd, SCHEMA).selectExpr("*", "'c' AS code", "1 AS entry", "'c' AS salt", "0 AS id")
    assert collected(vector_codes.compress(df)) == brute(good + odd)
    assert vector_codes.compress(df.where("vec_id between 50 and 54")).collect() == []
    assert vector_codes.compress(df.where("false")).collect() == []


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([(1, [0.0] * 32, 0), (2, [0.0] * 16, 0)], SCHEMA)
    with pytest.raises(ValueError, match="one length"):
        vector_codes.compress(df)
    with pytest.raises(ValueError, match="divisible"):
        vector_codes.compress(df.where("vec_id = 1"), parts=10)


def test_ties_go_to_the_lower_entry_and_large_numbers_stay_exact():
    book = np.array([[0, 0], [2, 0], [0, 0]])
    best, far = vector_codes.nearest(book, np.array([[1, 0], [0, 0], [2, 1]]))
    assert best.tolist() == [0, 0, 1] and far.tolist() == [1, 0, 1]
    big = 2 ** 30
    best, far = vector_codes.nearest(np.array([[big, 0], [big + 1, 0]]), np.array([[-big, 1], [big + 1, 1]]))
    assert best.tolist() == [0, 1] and far.tolist() == [4 * big * big + 1, 1]


def test_only_parts_that_change_entry_are_written_as_moved(spark, monkeypatch):
    seen = []
    keep = vector_codes.common.written_by

    def watched(df, name, column):
        out = keep(df, name, column)
        seen.append(out)
        return out

    monkeypatch.setattr(vector_codes.common, "written_by", watched)
    data = rows(400, seed=2)
    vector_codes.train(spark.createDataFrame(data, SCHEMA))
    (assigned,) = seen
    moved, stayed = (assigned.where(c).selectExpr("sum(weight) w").collect()[0]["w"] for c in ("moved", "not moved"))
    assert moved + stayed == 400 * 16 and 0 < moved < stayed
