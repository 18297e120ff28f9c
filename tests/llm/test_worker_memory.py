"""Tasks give unused memory back: Python workers stay, several beside one executor."""

import inspect

import pyarrow as pa

from encore.llm import bpe, common, exact_dedup, near_dedup


def test_unused_arrow_memory_is_given_back():
    """Before, a worker held what its largest batches had taken."""
    parts = [pa.RecordBatch.from_arrays([pa.array([i])], ["a"]) for i in range(3)]
    trims = []

    def run(batches):
        for b in batches:
            trims.append(len(calls))
            yield b

    calls, trim = [], common.trim
    common.trim = lambda: calls.append(trim())
    try:
        assert list(common.trimmed(run)(iter(parts))) == parts
        assert not list(common.trimmed(run)(iter([])))
    finally:
        common.trim = trim
    assert trims == [0, 1, 2] and len(calls) == 5  # after each batch and at each end


def test_operators_of_the_pipeline_give_it_back():
    for module in (bpe, exact_dedup, near_dedup):
        source = inspect.getsource(module)
        assert source.count(".mapInArrow(common.trimmed(") == source.count(".mapInArrow(") - source.count("``mapInArrow")
