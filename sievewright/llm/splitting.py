"""Split the texts of an Arrow column into words, a bounded portion at a time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that are split at a time; a longer text is a portion of its own.
PORTION = 1 << 23


def byte_table(separators: bytes) -> bytes:
    """For ``bytes.translate``: A-Z in lower case, ``separators`` as blanks."""
    table = bytearray(range(256))
    table[ord("A") : ord("Z") + 1] = bytes(range(ord("a"), ord("z") + 1))
    for b in separators:
        table[b] = ord(" ")
    return bytes(table)


def portions(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    """The column in slices of about `PORTION` bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + PORTION, side="right")))
        yield texts.slice(start, stop - start)
        start = stop
        pa.default_memory_pool().release_unused()


def split(texts: pa.StringArray, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(row of every word, its place in the list of distinct words, distinct words), words in their order.

    NULL has no words.
    """
    if not len(texts):
        return np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    own = data.slice(ends[0], ends[-1] - ends[0]).to_pybytes().translate(table) if data else b""
    known = None if texts.null_count == 0 else texts.is_valid().to_numpy(zero_copy_only=False)
    plain = pa.StringArray.from_buffers(
        len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(own),
        None if known is None else pa.py_buffer(np.packbits(known, bitorder="little")),
    )
    lists = pc.ascii_split_whitespace(plain)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()  # what stands before a leading blank
    if empty >= 0:
        some = codes != empty
        rows, codes = rows[some], codes[some]
    return rows, codes, words


def hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit identities of words, equal in every task."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False).view(np.int64)
