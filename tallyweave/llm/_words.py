"""Words of many texts at once, as spans of Arrow's own bytes: where they lie, 64-bit codes, and exact comparison."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time (a longer text is worked on alone, whole).
SLICE_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
#: A-Z in lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Spans(NamedTuple):
    """Byte ranges of ``data``; ``owner`` is the number of the text that a range is in."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    owner: np.ndarray


def flags(byte_values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(byte_values)] = True
    return out


SPACES = flags(b" \t\n\x0b\x0c\r")


def sliced_bytes(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES of the text in column ``at``."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + SLICE_BYTES, "right")))
            yield batch.slice(row, end - row)
            row = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes one after another, and where each begins (with the end of the last); null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8, bounds[-1] - bounds[0], bounds[0]), bounds - bounds[0]


def spans_of(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> Spans:
    """The longest runs of bytes that are ``inside`` (a flag for each byte of ``data``), none across two texts."""
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[first] = False
    after[(bounds[1:] - 1)[bounds[:-1] < bounds[1:]]] = False
    start = np.flatnonzero(inside & ~before)
    return Spans(data, start, np.flatnonzero(inside & ~after) + 1 - start, np.searchsorted(bounds, start, "right") - 1)


def words_of(texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = False) -> tuple[Spans, np.ndarray]:
    """The words of the texts (runs without ``separators``), and the texts' bounds."""
    data, bounds = text_bytes(texts)
    data = LOWER[data] if lower else data
    return spans_of(data, bounds, ~separators[data]), bounds


def _eights(data: np.ndarray) -> np.ndarray:
    """From every byte on, eight bytes as a number (zeros beyond the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def joined(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Code of a sequence, from the code of all its words but one and that of the last."""
    return mixed(context * _ODD + last + np.uint64(1))


def codes_of(words: Spans, seed: int = 0) -> np.ndarray:
    """A 64-bit code of each span's bytes and length."""
    eights, out = _eights(words.data), mixed(words.length.astype(np.uint64) * _ODD + np.uint64(seed))
    todo, done = np.arange(len(words.start)), 0
    while len(todo):
        left = words.length[todo] - done
        out[todo] = mixed(out[todo] * _ODD + (eights[words.start[todo] + done] & _KEEP[np.minimum(left, 8)]))
        done += 8
        todo = todo[left > 8]
    return out


def counted_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different codes, where each first occurs, how often it occurs), by hashing."""
    which, found = pd.factorize(codes)
    first = np.zeros(len(found), np.int64)
    first[which[::-1]] = np.arange(len(codes))[::-1]
    return found, first, np.bincount(which, minlength=len(found))


def same_bytes(words: Spans, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether span ``one[i]`` has the same bytes as span ``other[i]``."""
    eights, same = _eights(words.data), words.length[one] == words.length[other]
    todo, done = np.flatnonzero(same), 0
    while len(todo):
        left = words.length[one[todo]] - done
        keep = _KEEP[np.minimum(left, 8)]
        equal = (eights[words.start[one[todo]] + done] & keep) == (eights[words.start[other[todo]] + done] & keep)
        same[todo[~equal]] = False
        todo = todo[equal & (left > 8)]
        done += 8
    return same


def first_of_kind(words: Spans) -> np.ndarray:
    """True for one span of each kind (same owner, same bytes): a hash table of spans, every match verified byte by byte.

    Open addressing, all spans at once: each looks at its slot, one of those that meet at a free slot takes it, those with
    the holder's bytes are done, all others go on to the next slot. Equal spans see the same slots in turn, so they always meet.
    """
    codes = joined(words.owner.astype(np.uint64), codes_of(words))
    size = 1 << max(4, int(2 * len(codes)).bit_length())
    slots, new = np.full(size, -1, np.int64), np.zeros(len(codes), bool)
    todo, at = np.arange(len(codes)), (codes & np.uint64(size - 1)).astype(np.int64)
    while len(todo):
        free = slots[at] < 0
        slots[at[free]] = todo[free]
        held = slots[at]
        won = held == todo
        new[todo[won]] = True
        match = ~won & (codes[held] == codes[todo]) & (words.owner[held] == words.owner[todo])
        maybe = np.flatnonzero(match)
        match[maybe] = same_bytes(words, held[maybe], todo[maybe])
        on = ~(won | match)
        todo, at = todo[on], (at[on] + 1) & (size - 1)
    return new


def taken(words: Spans, which: np.ndarray) -> pa.Array:
    """The bytes of the spans numbered ``which``, as binary values."""
    start, length = words.start[which], words.length[which]
    ends = np.cumsum(length)
    if not len(which):
        return pa.array([], pa.large_binary())
    where = np.repeat(start - (ends - length), length) + np.arange(ends[-1])
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words.data[where]))])
