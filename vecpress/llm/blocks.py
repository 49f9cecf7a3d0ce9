"""Arrow text blocks: bounded slices of a partition's documents, and the words in them.

All functions run in Python workers on Arrow data; a block holds about ``BLOCK_BYTES`` of text, or
one longer document. Blocks depend on the order of rows alone, not on the sizes of the batches in
which Spark hands them over.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text after which a block is closed.
BLOCK_BYTES = 24 << 20


@cache
def _malloc_trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)  # C libraries other than glibc lack it


def give_back() -> None:
    """Return freed memory to the system. A Python worker serves one stage after another, and would
    hold on to the most that any of them took, beside the workers of other tasks."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def tidied(run: Callable[[pa.Table], pa.Table]):
    """A function of a group, after which memory is given back."""

    def tidy(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return tidy


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Tables of consecutive rows; null texts become empty. A block ends with the row that fills it.
    Memory is given back before the first block and after each."""
    give_back()
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        i = t.schema.get_field_index(column)
        t = t.set_column(i, column, pc.fill_null(t.column(i).cast(pa.string()), ""))
        n = pc.binary_length(t.column(i)).to_numpy()
        start = 0
        while start < len(t):
            ends = np.cumsum(n[start:])
            cut = start + int(np.searchsorted(ends, limit - size)) + 1
            if cut <= len(t):
                held.append(t.slice(start, cut - start))
                yield pa.concat_tables(held).combine_chunks()
                held, size = [], 0
                give_back()
            else:
                held.append(t.slice(start))
                size += int(ends[-1])
            start = cut
    if held:
        yield pa.concat_tables(held).combine_chunks()
        give_back()


def one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """The column as a single array without offset."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space (bytes 9-13 and 32): distinct words, a code for each word in
    order, and the offsets of each text's words. Empty words at a text's ends may occur."""
    lists = pc.ascii_split_whitespace(text)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), offsets - offsets[0]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start..start+length-1 of every span, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n, e = starts[full], lengths[full], ends[full]
    out[0] = s[0]
    out[e[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def unused(name: str, columns: Iterable[str]) -> str:
    """A column name that none of ``columns`` has, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
