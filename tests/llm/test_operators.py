"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import dataclasses
import random

import numpy as np
import public_tokenizers
from conftest import SF_MID, SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from encore.llm import bpe, chat, common, exact_dedup, langid, lm, mixing, near_dedup, quality, secrets
from encore.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


# ---- secrets: the ledger

def test_ledger_scans_only_unseen_pairs(spark):
    ledger = scratch_path(spark, "ledger")
    old = spark.createDataFrame([("a", 1, "token=abcdefg"), ("b", 1, "token=abcdefg"), ("c", 1, "nothing")], "path string, version int, text string")
    first = secrets.scan(old, ledger, ["path", "version"], rules=secrets.BASE_RULES).collect()
    assert {(r["path"], len(r["scans"][0]["spans"])) for r in first} == {("a", 1), ("b", 1), ("c", 0)}
    assert spark.read.parquet(ledger).count() == 2  # one row per blob, not per path
    new = old.union(spark.createDataFrame([("a", 2, "nothing"), ("d", 1, "secret: 1234567")], old.schema))
    secrets.scan(new, ledger, ["path", "version"], rules=secrets.BASE_RULES).collect()
    assert spark.read.parquet(ledger).count() == 3
    changed = (*secrets.BASE_RULES[1:], secrets.Rule("assign", 2, "nothing"))
    out = secrets.scan(new, ledger, ["path", "version"], rules=changed).collect()
    added = spark.read.parquet(ledger).where("scans[0].version = 2 and size(scans) = 1").count()
    assert added == 3  # only the changed rule ran again, once per blob
    assert {(r["path"], r["version"]) for r in out if any(s["kind"] == "assign" and s["spans"] for s in r["scans"])} == {("c", 1), ("a", 2)}


def test_base_rules_first_then_all_equal_one_scan(spark):
    texts = ["TOKEN=abcdefg", "x" + "0123456789abcdef" * 2, "0123456789ABCDEF" * 2, "AKIA" + "Q" * 16, "-----BEGIN PRIVATE KEY-----\nabc",
             "ftp://me:pw@host", "plain words only", "", None, "plain words only", "\u212aey tok\u212an=abcdefg"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    twice, once = scratch_path(spark, "ledger"), scratch_path(spark, "ledger")
    secrets.update_ledger(docs, twice, rules=secrets.BASE_RULES)
    got = secrets.with_digests(secrets.scan(docs, twice)).collect()
    assert sorted(got) == sorted(secrets.with_digests(secrets.scan(docs, once)).collect())
    runs = [sorted(s["kind"] for s in r["scans"]) for r in spark.read.parquet(twice).collect()]
    blobs = len({t or "" for t in texts})
    assert sorted(runs) == sorted([sorted(r.kind for r in rules) for rules in (secrets.BASE_RULES, secrets.MORE_RULES) for _ in range(blobs)])
    for row, text in zip(sorted(got), texts, strict=True):  # every rule over every text, whether screened out or not
        spans = [(s["start"], i, f"{r.kind}:{s['start']}:{s['stop']}") for i, r in enumerate(secrets.RULES)
                 for s in secrets.find(dataclasses.replace(r, hints=()), text or "", "")]
        assert row["spans"] == ",".join(x[2] for x in sorted(spans))


def test_a_pair_appended_twice_counts_once(spark):
    ledger = scratch_path(spark, "ledger")
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\n-----END RSA PRIVATE KEY-----"
    docs = spark.createDataFrame([(1, "token=abcdefg"), (2, f"x {key} y"), (3, "-----BEGIN PRIVATE KEY-----\nabc")], "doc_id bigint, text string")
    secrets.update_ledger(docs, ledger)
    once = spark.read.parquet(ledger).collect()
    spark.createDataFrame(once, secrets._LEDGER).write.mode("append").parquet(ledger)  # a second scanner, or a rerun
    assert spark.read.parquet(ledger).count() == 6
    out = {r["doc_id"]: r for r in secrets.with_digests(secrets.scan(docs, ledger)).collect()}
    assert (out[1]["n_assign"], out[1]["spans"]) == (1, "assign:0:13")
    assert out[2]["spans"] == f"private_key:2:{2 + len(key)}"
    assert out[3]["spans"] == "private_key:0:27"


# ---- exact dedup: the trie

@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(-5, 5)), max_size=60))
@settings(max_examples=100, deadline=None)
def test_trie_owners(rows):
    best, count = {}, collections.Counter()
    for key, rank in rows:
        best[key] = min(best.get(key, rank), rank)
        count[key] += 1
    want = sorted((k, best[k], count[k]) for k in best)
    trie = exact_dedup.RadixTrie()
    spilled = []
    for i, (key, rank) in enumerate(rows):
        trie.insert(key, rank)
        if i % 7 == 6 and trie.root.children:
            spilled += trie.spill_heaviest()
    merged = exact_dedup.RadixTrie()
    out = []
    for key, rank, n in sorted([*spilled, *trie.spill_all()]):
        merged.insert(key, rank, n)
        out += merged.spill_passed(key)
    assert sorted([*out, *merged.spill_all()]) == want


def test_exact_dedup_with_a_small_trie_budget(spark):
    docs = common.table(spark, SF_SMALL, "documents")
    a = exact_dedup.exact_duplicates(docs, keep="largest", trie_bytes=20_000).collect()
    b = exact_dedup.exact_duplicates(docs, keep="largest").collect()
    assert sorted(a) == sorted(b)


# ---- language model

def test_lm_order_three_against_brute_force(spark):
    texts = [r["text"] for r in common.table(spark, SF_SMALL, "documents").limit(30).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["row_id"]: r for r in lm.scores(df, order=3, block_bytes=20_000).collect()}
    words = [lm_words(t) for t in texts]
    counts = collections.Counter(tuple(w[i:i + m]) for w in words for m in (1, 2, 3) for i in range(len(w) - m + 1))
    total = sum(map(len, words))
    for i, w in enumerate(words):
        log_prob, backed = 0.0, 0
        for j in range(len(w)):
            penalty, longest = 0.0, min(3, j + 1)
            for m in range(longest, 0, -1):
                gram = tuple(w[j - m + 1:j + 1])
                if m == 1 or counts[gram] >= 2:
                    log_prob += penalty + np.log(counts[gram]) - np.log(counts[gram[:-1]] if m > 1 else total)
                    break
                backed += m == longest == 3
                penalty += np.log(lm.BACKOFF)
        assert abs(got[i]["log_prob"] - log_prob) < 1e-6 * max(1, abs(log_prob))
        assert got[i]["n_words"] == len(w)


def lm_words(text):
    return text.encode().lower().split()


# ---- quality

def test_quality_against_labels(spark):
    judged = quality.quality(common.table(spark, SF_MID, "documents")).where("not base_failed")
    joined = judged.join(common.table(spark, SF_MID, "labels"), "doc_id")
    got = {(r["quality"], r["kept"]): r["count"] for r in joined.groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) == 0  # clean documents stay
    assert got.get((0, True), 0) <= 0.05 * (got.get((0, True), 0) + got[(0, False)])


def test_em_posteriors_against_numpy(spark):
    rng = random.Random(3)
    rules = (("a", "x", "y"), ("b", "x", "y"), ("c", "x", "y"))
    rows = [tuple(rng.choice((0, 1, 2, 2)) for _ in rules) for _ in range(300)]
    got = {tuple(r[:3]): r["p_good"] for r in quality.posteriors(
        spark.createDataFrame(rows, "vote_a int, vote_b int, vote_c int"), rules, 5).collect()}
    n = collections.Counter(rows)
    b = 0.0
    w = np.log(np.array([[0.2, 1, 0.8]] * 3)) - np.log(np.array([[0.8, 1, 0.2]] * 3))
    post = lambda: {p: 1 / (1 + np.exp(-(b + sum(w[j, v] for j, v in enumerate(p))))) for p in n}
    for _ in range(5):
        q = post()
        good = sum(n[p] * q[p] for p in n)
        bad = sum(n[p] * (1 - q[p]) for p in n)
        b = np.log((good + 1) / (bad + 1))
        w = np.array([[np.log((sum(n[p] * q[p] for p in n if p[j] == v) + 1) / (good + 3))
                       - np.log((sum(n[p] * (1 - q[p]) for p in n if p[j] == v) + 1) / (bad + 3)) for v in range(3)] for j in range(3)])
    q = post()
    assert set(got) == set(q) and all(abs(got[p] - q[p]) < 1e-9 for p in q)


# ---- language

def test_language_held_out_accuracy(spark):
    docs = common.table(spark, SF_MID, "documents")
    test = docs.where(langid.held_out())
    found = langid.identify(test, langid.learn(docs.where(~langid.held_out()))).withColumnRenamed("lang", "pred")
    right = found.join(test, found.row_id == test.doc_id).agg(F.avg((F.col("pred") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.97


# ---- BPE

ALPHABET = ["a", "the", " ", "  ", "\n", "'", "'re", "'s", "1", "23", "é", "ß", "漢", "😀", "\x1c", "\xa0", "!!", "...", "aaaaaaa", " \n ", "ing", "’"]


@given(st.lists(st.sampled_from(ALPHABET), max_size=150), st.sampled_from([1, 2, 3, 5, 17, 40]))
@settings(max_examples=200, deadline=None)
def test_tree_concatenation_is_the_library(parts, size):
    c, text = bpe.codec(PATH), "".join(parts)
    plain = c.is_plain(text)
    ids = bpe.join_all(c, [bpe.leaf(c, text[i:i + size], plain) for i in range(0, len(text), size)], plain)
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert ids == want == c.encode(text)
    assert c.decode(ids) == text


def test_long_texts_in_spark(spark):
    texts = ["x" * 7000, "漢字 " * 900, "ab <|endoftext|>" * 300, "word " * 2000, "<|endoftext|>" * 500, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id bigint, text string")
    out = bpe.encode(df, PATH, long_chars=1000, piece_chars=300).collect()
    library = Tokenizer.from_file(PATH)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert sorted((r["row_id"], list(r["ids"])) for r in out) == sorted([(i, v) for i, v in want.items()] * 2)
    back = {r["row_id"]: r["text"] for r in bpe.decode(spark.createDataFrame(out[:20], "row_id bigint, ids array<int>"), PATH).collect()}
    assert all(back[i] == (texts[i] or "") for i in back)


# ---- mixing

def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [("d1", "en", "a", 10), ("d1", "en", "b", 1000), ("d1", "fr", "c", 1000), ("d2", "en", "d", 1000)]
    leaves = spark.createDataFrame(rows, "node_domain string, node_lang string, node_source string, leaf_tokens bigint").withColumn(
        "all_tokens", F.lit(3010))
    got = {r["node_source"]: r["leaf_budget"] for r in mixing.budgets(leaves, F.lit(800), 1, {}).collect()}
    assert got == {"a": 10, "b": 190, "c": 200, "d": 400}  # b, not c or d, takes what a lacks
    got = {r["node_source"]: r["leaf_budget"] for r in mixing.budgets(leaves, F.lit(3000), 1, {}).collect()}
    assert got == {"a": 10, "b": 990, "c": 1000, "d": 1000}  # all of d2 is used up: the rest goes to d1


def test_mixed_rows_follow_the_copies(spark):
    docs = common.table(spark, SF_SMALL, "documents")
    want = collections.Counter({r["doc_id"]: r["copies"] for r in mixing.mix(docs, max_epochs=3).collect() if r["copies"]})
    got = collections.Counter(r["doc_id"] for r in mixing.mixed(docs, max_epochs=3).collect())
    assert got == want


# ---- near duplicates

def shingle_set(text):
    w = (text or "").lower().encode().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                root[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), d), d)
    return {d: smallest[find(i)] for i, (d, _) in enumerate(rows)}


def near_rows():
    """A base text with copies of one to eight replaced words, truncated ones, and chains."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(150)]
        for n in range(60):
            text = list(base)
            for _ in range(n % 9):
                text[rng.randrange(150)] = word()
            rows.append(text[:150 - (n % 4) * 10])
    chain = [word() for _ in range(100)]
    for _ in range(12):
        chain = chain[6:] + [word() for _ in range(6)]
        rows.append(list(chain))
    rows += [[word() for _ in range(rng.randint(1, 40))] for _ in range(40)]
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def test_near_classes_against_brute_force(spark):
    rows = near_rows()
    got = {r["row_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)


def test_near_dedup_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, SF_SMALL, "documents").collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op8_near_dedup(spark, SF_SMALL).collect()}
    assert got == brute_classes(docs)


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    error = []
    for _ in range(20):
        e = rng.integers(0, 2 ** 63, 60).astype(np.uint64)
        a, b = rng.random(60) * 5 + 0.1, rng.random(60) * 5 + 0.1
        sig = near_dedup.dart_minhash(np.concatenate([e, e]), np.array([60, 60]), np.concatenate([a, b]), 480)
        error.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(error)) < 0.02


# ---- chat

def test_layouts_give_the_same_turns():
    records = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"system": "s", "prompt": "q", "response": "a"},
        {"system": "s", "instruction": "q", "input": "", "output": "a"},
    ]
    known = chat.registry()
    turns = [known[chat.fingerprint(chat.field_paths(r))].read(r) for r in records]
    assert all(t == [("system", "s"), ("user", "q"), ("assistant", "a")] for t in turns)
    assert chat.fingerprint(chat.field_paths({"other": 1})) not in known


@given(st.lists(st.tuples(st.text(alphabet="ab\n\\n<|im_endstart>", max_size=12), st.text(alphabet="ab\n\\<|im_endstart>", max_size=30)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_formatting_is_reversible(turns):
    formatted, spans = chat.write([(r, t) for r, t in turns] + [("assistant", "<|im_end|><\\|x")])
    assert chat.read_back(formatted) == [*turns, ("assistant", "<|im_end|><\\|x")]
    assert chat.unescape(formatted[spans[-1][0]:spans[-1][1]]) == "<|im_end|><\\|x"


def test_unknown_records_are_returned(spark):
    df = spark.createDataFrame([(1, '{"x": 1}'), (2, "not json"), (3, None), (4, "[1]")], "conv_id bigint, record string")
    out = {r["conv_id"]: (r["layout"], r["schema_sha256"] is None) for r in chat.format_records(df).collect()}
    assert out == {1: (None, False), 2: (None, True), 3: (None, True), 4: (None, True)}


# ---- pipeline

def test_pipeline_against_its_operators(spark):
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, SF_SMALL, "documents").collect()]
    kept = {r["doc_id"] for r in quality.op4_quality_rules(spark, SF_SMALL).collect() if r["kept"]}
    largest = {}
    for d, t in docs:
        if d in kept:
            key = exact_dedup.normalise(t)
            largest[key] = max(d, largest.get(key, d))
    rows = [(d, t) for d, t in docs if d in kept and largest[exact_dedup.normalise(t)] == d]
    classes = brute_classes(rows)
    stay = {d for d, c in classes.items() if d == c}
    left = common.table(spark, SF_SMALL, "documents").where(F.col("doc_id").isin(sorted(stay)))
    mixed = {r["doc_id"] for r in mixing.mix(left, budget_percent=corpus_pipeline.MIX_BUDGET_PERCENT, max_epochs=1).collect() if r["copies"]}
    out = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    library = Tokenizer.from_file(PATH)
    texts = dict(docs)
    assert set(out) == mixed
    assert all(out[d] == library.encode(texts[d], add_special_tokens=False).ids for d in out)
