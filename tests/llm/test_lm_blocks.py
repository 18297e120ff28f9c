"""op3's blocks: batches of texts count and score as one, and a block keeps hashes only."""

import tracemalloc

import numpy as np
import pyarrow as pa

from encore.llm import lm


def test_batches_count_and_score_as_one():
    texts = ["a b a b c", None, "", "b a B a", "  x\ty ", "a " * 50]
    one, cut = lm.Block([texts], 3, keep=True), lm.Block(([t] for t in texts), 3, keep=True)
    for a, b in zip([*one.distinct, *one.counts], [*cut.distinct, *cut.counts], strict=True):
        assert (a == b).all()
    for a, b in zip(one.score(0.4, 2), cut.score(0.4, 2), strict=True):
        assert np.array_equal(a, b) and len(a) == len(texts)
    asked = [np.concatenate(x) for x in zip(*one.asks(), strict=True)]
    assert len(asked[0]) == 1 + sum(map(len, one.distinct)) and asked[1].sum() == one.n_words + sum(c.sum() for c in one.counts)


def test_totals_replace_counts_in_every_order():
    block = lm.Block([["a b", "a b c"]], 2, keep=True)
    grams, counts = (np.concatenate(x) for x in zip(*block.asks(), strict=True))
    block.take_totals(grams[::-1], counts[::-1] * 10)
    assert block.n_words == 50 and sorted(block.counts[0]) == [10, 20, 20] and sorted(block.counts[1]) == [10, 20]


def test_a_block_keeps_no_texts():
    """Before, a block took all its texts at once, and several arrays of all orders together."""
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(500)]

    def batches():
        for _ in range(40):
            yield [" ".join(vocabulary[i] for i in rng.integers(0, 500, 500)) for _ in range(20)]

    tracemalloc.start()
    block = lm.Block(batches(), 2)
    for _ in block.asks():
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert block.n_words == 400_000 and peak < 45 * block.n_words


def test_answers_hold_no_hashes_and_a_byte_a_count():
    """Before, an answer held its n-gram's hash, and the answers took about as much disk as the questions."""
    blocks = [["a b c"] * 300 + ["d e"], ["b c d"] * 10 + ["", None, "f"], [None]]
    bits = 3
    rows = []  # part, gram, block, n
    for i, texts in enumerate(blocks):
        for grams, counts in lm.Block([texts], 2).asks():
            rows += zip(lm._parts(grams, bits).tolist(), grams.view(np.int64).tolist(), [i] * len(grams), counts.tolist(), strict=True)
    total = {}
    for _, gram, _, n in rows:
        total[gram] = total.get(gram, 0) + n
    rows = sorted((part, gram, i, total[gram]) for part, gram, i, _ in rows)
    names, types = ["part", "gram", "block", "total"], [pa.int32(), pa.int64(), pa.int32(), pa.int64()]

    def batches(size):
        for a in range(0, len(rows), size):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a:a + size], strict=True), types, strict=True)], names)

    found = [r for b in lm._answer(batches(100)) for r in b.to_pylist()]
    assert found == [r for b in lm._answer(batches(1)) for r in b.to_pylist()]
    assert not list(lm._answer(iter([])))
    assert len({(r["part"], r["block"]) for r in found}) == len(found)
    assert sum(len(r["small"]) for r in found) == len(rows) and max(total.values()) > 255
    whole = lm.Block([[t for texts in blocks for t in texts]], 2, keep=True).score(0.4, 2)
    scored = []
    for i, texts in enumerate(blocks):
        block = lm.Block([texts], 2, keep=True)
        block.take_parts([(r["part"], r["small"], np.array(r["large"], np.int64)) for r in found if r["block"] == i], bits)
        scored.append(block.score(0.4, 2))
    for a, b in zip(zip(*scored, strict=True), whole, strict=True):
        assert np.array_equal(np.concatenate(a), b)
