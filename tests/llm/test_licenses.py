"""License notices wrapped over lines, against brute force over every block; notices of neighbouring licenses."""

import math
import random

from encore.llm import licenses

NOTICES = {
    "bsd": "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the",
    "mpl-2.0": " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not",
}


def brute(text):
    words, found, best = licenses._words(text), set(), 0.0
    for t in licenses.TEMPLATES:
        own = set(licenses._words(t.text))
        length = licenses.block_length(len(licenses._words(t.text)), licenses.THRESHOLD)
        for i, word in enumerate(words):
            block = set(words[i:i + length])
            if word in own and len(own & block) >= licenses.need(len(own), licenses.THRESHOLD) and block >= set(t.must) and not block & set(t.never):
                found.add(t.label)
                best = max(best, len(own & block) / len(own))
    return found, best


def labels(spark, texts):
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [set(filter(None, r["labels"].split(","))) for r in sorted(out, key=lambda r: r["doc_id"])]


def test_wrapped_notices_are_found_at_every_place(spark):
    texts = [(f"{label}-{k}", "alpha\n" * k + notice + "\nomega" * 5) for label, notice in NOTICES.items() for k in (0, 1, 40, *range(50, 70), 127, 128, 500)]
    out = licenses.scan(spark.createDataFrame(texts, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in out} == {name: name.rsplit("-", 1)[0] for name, _ in texts}
    assert {r["score"] for r in out} == {1.0}


def test_words_far_apart_are_no_notice(spark):
    far = "\n".join(f"{w} {'x ' * 30}" for w in ("all", "rights", "reserved"))
    one_line = f"all {'x ' * 5000} rights {'x ' * 5000} reserved"
    assert labels(spark, [far, one_line, "the rights are all reserved", "small formal anywhere usable 42 14"]) == [set()] * 4


def test_neighbouring_licenses_are_told_apart(spark):
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": {"gpl", "gpl-3.0"},
        "This work is licensed under the GNU General Public License, version 2.": {"gpl", "gpl-2.0"},
        "Licensed under the GNU Lesser General Public License, version 3.": {"lgpl-3.0"},
        "This work is licensed under the GNU Lesser General Public License, version 3": {"lgpl-3.0"},
        "Licensed under the GNU Affero General Public License, version 3.": {"agpl-3.0"},
        "Licensed under CC BY 4.0.": {"cc-by"},
        "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc-4.0"},
        "Licensed under CC BY-SA 4.0.": {"cc-by", "cc-by-sa-4.0"},
        "Licensed under CC BY-NC-SA 4.0.": {"cc-by"},
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": {"cc-by-4.0"},
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": set(),
        "Released under the MIT License.": {"mit"},
        "Licensed under the Apache License, Version 2.0": {"apache", "apache-2.0"},
        "All rights reserved.": {"all-rights-reserved"},
        "This work is released into the public domain.": {"public-domain"},
    }
    assert labels(spark, list(notices)) == list(notices.values())


def test_matches_brute_force(spark):
    rng = random.Random(3)
    words = sorted({w for t in licenses.TEMPLATES for w in (*licenses._words(t.text), *t.never)})
    texts = []
    for k in range(150):
        parts = []
        for _ in range(rng.randint(1, 12)):
            template = rng.choice(licenses.TEMPLATES).text.split()
            parts += [w for w in template if rng.random() > 0.1] if rng.random() < 0.6 else rng.choices(words, k=rng.randint(1, 30))
        texts.append((k, "".join(w + rng.choice([" "] * 6 + ["\n", "\n * "]) for w in parts)))
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, text in texts:
        found, best = brute(text)
        base = set(filter(None, out[k]["base_labels"].split(",")))
        assert set(filter(None, out[k]["labels"].split(","))) == found | base
        assert abs(out[k]["score"] - (1.0 if base else best)) < 1e-12


def test_the_sql_equals_brute_force(spark):
    import duckdb

    rng = random.Random(5)
    texts = [(k, "\n".join(rng.choice([*NOTICES.values(), *(t.text for t in licenses.TEMPLATES), "x y z", "all 2 3 nc"]) for _ in range(rng.randint(0, 4))))
             for k in range(80)] + [(80, None), (81, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    rel = con.sql(licenses.ORACLE_SQL)
    at = {c: i for i, c in enumerate(rel.columns)}
    rows = {r[at["doc_id"]]: r for r in rel.fetchall()}
    for k, text in texts:
        found, best = brute(text or "")
        base = set(filter(None, rows[k][at["base_labels"]].split(",")))
        assert set(filter(None, rows[k][at["labels"]].split(","))) == found | base
        assert abs(rows[k][at["score"]] - (1.0 if base else best)) < 1e-12
