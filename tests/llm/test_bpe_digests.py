"""The digests of op6 and the pipeline's last stage against the tokenizers library, row by row."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from encore.llm import bpe, common

SF_SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_query_digests(spark):
    library = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, SF_SMALL, "documents").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op6_bpe(spark, SF_SMALL).collect()}
    assert got == {d: wanted(library, t) for d, t in texts.items()}


def test_encoded_documents_on_odd_rows(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "café \U0001f600 <|im_end|>"), (4, "café \U0001f600 <|im_end|>"), (None, "x"), (5, "ab " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'c' AS ids", "1 AS `a.b`", "2 AS row_id")
    got = [(r["doc_id"], r["n_tokens"], sha(",".join(map(str, r["ids"]))), r["decoded_sha256"]) for r in bpe.encoded_documents(docs, PATH).collect()]
    assert sorted(got, key=str) == sorted(((d, *wanted(library, t)) for d, t in rows), key=str)
    assert bpe.encoded_documents(docs.where("false"), PATH).collect() == []
