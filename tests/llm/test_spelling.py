"""Spelling variants against brute force: the index, the search, the whole operator, hot halves and odd rows."""

import collections
import re
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from encore.llm import spelling


def near_in(words):
    """word → set of the words one edit apart."""
    letters = sorted({c for w in words for c in w})
    out = {}
    for w in words:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        made = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {
            a + c + b[1:] for a, b in cuts if b for c in letters}
        out[w] = (made & set(words)) - {w}
    return out


def brute(rows, least_length=6, least_count=5, factor=5):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = near_in(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items()}


def collected(df):
    rows = df.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


@given(st.lists(st.integers(0, 2), max_size=40))
@settings(max_examples=100, deadline=None)
def test_suffix_array(text):
    got = spelling.suffix_array(np.array(text, np.int32))
    assert list(got) == sorted(range(len(text) + 1), key=lambda i: text[i:])


@given(st.sets(st.text("abc", min_size=2, max_size=8), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_search_finds_each_near_word_once(words):
    words = sorted(words)
    index = spelling.FMIndex([np.array([" abc".index(c) for c in w], np.int32) for w in words], 3)
    asked = np.zeros((len(words), 8), np.int64)
    for i, w in enumerate(words):
        asked[i, :len(w)] = [" abc".index(c) for c in w]
    length = np.array([len(w) for w in words])
    pairs = []
    for right in (True, False):
        who, found = spelling.near_words(index, asked, length, right)
        pairs += list(zip(who.tolist(), found.tolist(), strict=True))
    want = near_in(words)
    assert sorted((words[a], words[b]) for a, b in pairs) == sorted((a, b) for a in words for b in want[a])


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = brute(rows)
    assert len(want) > 500 and any(v[2] for v in want.values())
    assert collected(E.queries()["op12_spelling_variants"](spark, SF_SMALL)) == want


@pytest.mark.parametrize("half_words", [1, 3])
def test_halves_of_many_words_are_split(spark, half_words):
    words = {"interest": 50, "interess": 4, "interes": 9, "interst": 9, "interests": 50, "interval": 7, "winterest": 2,
             "intereest": 3, "inerest": 2, "aaaaaa": 5, "aaaaa": 5, "aaaaaaa": 5, "abaaaa": 5}
    df = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in spelling.neighbours(df, index_chars=20, half_words=half_words).collect()}
    near = near_in(words)
    want = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            want[w] = (len(near[w]), best, words[best])
    assert got == want


def test_odd_rows(spark):
    long = "Überraschung " * 4000 + "x" * 600
    rows = [(1, None), (2, ""), (3, "12 ., 中文 a b"), (4, long), (4, long), (None, "Zürichsee " * 7), (5, "zurichsee " * 40),
            (6, "×÷ÀÿÀÿ " * 6), (7, "ZÜRICHSEE zÜrichsee " * 5), (8, ("x" * 599 + " ") * 5), (9, ("x" * 600 + " ") * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'c' AS word", "0 AS n", "'c' AS root")
    got = collected(spelling.variants(docs))
    want = brute(rows)
    assert got == want
    assert got["zürichsee"][2] == "zurichsee"
    assert spelling.variants(docs.where("false")).collect() == []


def test_very_long_words(spark):
    words = [("x" * 30_000, 5), ("x" * 30_001, 50), ("x" * 9_000 + "y" + "x" * 20_999, 7), ("xy" * 20_000, 9)]
    got = {r["word"]: (r["n_near"], r["form_n"]) for r in spelling.neighbours(spark.createDataFrame(words, "word string, n bigint")).collect()}
    assert got == {words[0][0]: (2, 50), words[1][0]: (1, 5), words[2][0]: (1, 5)}


def test_forms_lead_to_the_last(spark):
    rows = [(1, "abcdefgh " * 5), (2, "abcdefgx " * 25), (3, "abcdefyx " * 125), (4, "abcdezyx " * 625), (5, "abcdezyw " * 3125)]
    got = collected(spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute(rows)
    assert got["abcdefgh"][4] == "abcdezyw"
