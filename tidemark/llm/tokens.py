"""Runs of bytes of whole Arrow texts, found with lookup tables instead of a pattern for each text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTE = np.arange(256)
#: Bytes of a word: all but ASCII white space.
WORD_BYTES = ~np.isin(_BYTE, [0x20, *range(0x09, 0x0E)])
#: Bytes of a term: ASCII letters and digits, and every byte of other characters.
TERM_BYTES = (_BYTE >= 0x80) | np.isin(_BYTE, np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
#: Every byte as it is, A-Z as a-z.
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 0x20, _BYTE).astype(np.uint8)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece has at most `most` bytes of text, or one row."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


@dataclass
class Texts:
    """The bytes of some texts in a row, and where each starts; a null text is empty."""

    raw: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        whole = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = whole.buffers()
        starts = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
        return cls(raw, starts - starts[0])

    def totals(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        before = np.r_[0, np.cumsum(marked)]
        return before[self.starts[1:]] - before[self.starts[:-1]]

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The number of the text that holds each byte position."""
        return np.searchsorted(self.starts, at, "right") - 1

    def runs(self, inside: np.ndarray, mapped: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
        """The maximal runs of bytes that `inside` marks, as strings of bytes mapped by `mapped`, and the text of each."""
        on = inside[self.raw]
        first = on.copy()
        fresh = np.zeros(len(on) + 1, bool)
        fresh[self.starts] = True
        first[1:] &= ~on[:-1] | fresh[1:-1]
        kept = self.raw[on]
        kept = kept if mapped is None else mapped[kept]
        return strings(kept, np.flatnonzero(first[on])), self.owner(np.flatnonzero(first))


def strings(kept: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The strings that start at these places of `kept`, which is valid UTF-8; each reaches to the next."""
    offsets = np.r_[starts, len(kept)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])


def codes(found: pa.Array) -> tuple[np.ndarray, int]:
    """A number for each string, equal for equal ones, and how many there are."""
    coded = found.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
