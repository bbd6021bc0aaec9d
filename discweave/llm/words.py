"""Words of many texts at once: codes of their distinct spellings, made by Arrow kernels.

What an operator does for a word it then does once for each spelling in a group of texts, and
deals the results back to the texts by ``take`` or by index.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a group of its own.
GROUP_BYTES = 2 << 20


def tidy() -> None:
    """Give freed memory back to the system, after a batch or a task: workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def whole(texts: pa.Array) -> pa.Array:
    """The texts, null ones empty."""
    return pc.fill_null(texts, "")


def row_groups(texts: pa.Array, most_bytes: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have ``most_bytes`` of text together at most, or are one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield at, stop
        at = stop


@dataclass
class Words:
    """``codes``: the place in ``spelled`` of every word, text after text; ``ends``: where the words
    of each text end."""

    codes: np.ndarray
    ends: np.ndarray
    spelled: list[str]

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def coded(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, ends, spellings) of lists of strings; no list is null."""
    offsets = parts.offsets.to_numpy()
    found = parts.flatten().dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), (offsets[1:] - offsets[0]).astype(np.int64), found.dictionary.to_pylist()


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """The words of texts (none null), ``[^\\x20\\x09-\\x0D]+``; ``lower``: A-Z lowered."""
    codes, ends, spelled = coded(pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts))
    if "" in spelled:  # before, after and between white space
        kept = codes != spelled.index("")
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        codes = codes[kept]
    return Words(codes, ends, spelled)


class Remembered(dict):
    """``cache[word]`` computes what is missing and keeps two generations of ``limit`` words of up
    to 200 characters, so its memory is bounded. A worker makes one for a task and drops it with
    the task."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(word) <= 200:
            self[word] = value
        return value


def dealt(values: list[bytes], codes: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of ``values[c]`` for every code in a row, and where each ends."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(codes))
    if not len(codes):
        return memoryview(b""), np.zeros(0, np.int64)
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(codes) + 1)
    return memoryview(taken.buffers()[2])[: int(ends[-1])], ends[1:]
