"""The exact rest by counts: similar bags whose sets of shingles differ."""

from encore.llm import near_dedup


def test_rest_keeps_pairs_that_are_similar_by_counts(spark):
    passage = "a b c d e " * 60
    texts = {b"1": passage + "p q r s t u v w x y", b"2": passage + "f g h i j k l m n o"}
    shingler = near_dedup.Shingler()
    alike = lambda by_count: near_dedup.similarity(*[near_dedup._profile(shingler, t, by_count) for t in texts.values()])
    assert alike(True) >= 0.8 > 0.5 > alike(False)
    nodes = spark.createDataFrame([(bytearray(k), bytearray(k), True, t) for k, t in texts.items()], "node binary, root binary, failed boolean, text string")
    pairs = lambda by_count: [(bytes(r["a"]), bytes(r["b"])) for r in near_dedup.rest_pairs(nodes, by_count=by_count).collect()]
    assert pairs(True) == [(b"1", b"2")]
    assert pairs(False) == []
