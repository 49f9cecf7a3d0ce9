"""Text blocks and the memory that they give back."""

import pyarrow as pa
import pytest

from vecpress.llm.blocks import text_blocks, tidied


def test_blocks_hold_every_row_in_order():
    texts = ["a" * 10, None, "", "b" * 50, "c", "é" * 7]
    batches = [pa.record_batch({"text": pa.array(texts[i : i + 2], pa.string())}) for i in (0, 2, 4)]
    got = [t.column("text").to_pylist() for t in text_blocks(batches, limit=20)]
    assert [x for block in got for x in block] == [x or "" for x in texts]
    assert len(got) > 1
    assert list(text_blocks([])) == []


def test_tidied_hands_on_results_and_errors():
    table = pa.table({"x": [1, 2]})
    assert tidied(lambda t: t.slice(1))(table).column("x").to_pylist() == [2]
    with pytest.raises(ZeroDivisionError):
        tidied(lambda t: 1 / 0)(table)
