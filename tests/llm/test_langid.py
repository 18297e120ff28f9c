"""Language identification: row by row against plain compression, ties, long texts, many languages."""

import re
import zlib

import zstandard

from encore.llm import common, langid

SF_SMALL = "/root/testdata/sf0.001"
EN = "the cat of the house is in the garden and it was for all. "
FR = "le chat de la maison est dans le jardin et il est pour nous. "


def test_a_language_with_only_long_texts(spark):
    rows = [(i, EN * 5, "en") for i in range(8)] + [(i, FR * 500, "fr") for i in range(8, 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(t) for _, t, lang in rows if lang == "fr") > langid.SAMPLE_CHARS
    contents = langid.learn(docs)
    assert sorted(contents) == ["en", "fr"]
    assert len(contents["fr"]) <= langid.DICT_BYTES
    found = {r["row_id"]: r["lang"] for r in langid.identify(docs, contents).collect()}
    assert found == {i: lang for i, _, lang in rows}


def test_more_languages_than_dictionaries_are_planned_for(spark):
    texts = {f"l{i}": " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for w in ("olo", "ura", "est", "inga", "pom") * 12) for i in range(12)}
    rows = [(i * 10 + k, text, lang) for i, (lang, text) in enumerate(texts.items()) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = langid.learn(docs, max_languages=3, sample_docs=4, dict_bytes=4096)
    assert set(learned) == set(texts) and max(map(len, learned.values())) <= 1024
    found = {r["row_id"]: r["lang"] for r in langid.identify(docs, learned).collect()}
    assert all(found[i] == lang for i, _, lang in rows)


def test_query_against_plain_compression(spark):
    docs = common.table(spark, SF_SMALL, "documents")
    contents = langid.learn(docs.where(~langid.held_out()))
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"], r["rejected"]) for r in langid.op5_language_id(spark, SF_SMALL).collect()}
    want = {}
    for row in docs.collect():
        words = re.sub(r"[\W\d_]+", " ", (row["text"] or "").lower()).encode("utf-8")
        size = {}
        for lang, content in contents.items():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)
            size[lang] = sum(len(coder.compress(words[i:i + langid.BLOCK_BYTES])) for i in range(0, len(words), langid.BLOCK_BYTES))
        best, second = sorted((n, lang) for lang, n in size.items())[:2]
        margin = 1.0 - best[0] / second[0] if words.strip() else 0.0
        want[row["doc_id"]] = (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0, best[1] if words.strip() else "und", margin, margin < langid.NARROW)
    assert got == want


def test_equal_sizes_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, EN), (1, EN), (None, "12 .")], "doc_id bigint, text string")
    same = langid.identify(docs, {"xx": EN.encode(), "aa": EN.encode()}).collect()
    assert sorted((r["lang"], r["margin"], r["rejected"]) for r in same) == [("aa", 0.0, True), ("aa", 0.0, True), ("und", 0.0, True)]
