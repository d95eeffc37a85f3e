"""Word and shingle hashing over Arrow text columns, vectorised in numpy.

A *word* is a maximal run of bytes other than space and the controls 09-0D; A-Z
are lower-cased, every other byte is kept as it is.  Texts are handled whole.
Words get a 64-bit polynomial hash, shingles a mix of the hashes of their words.
Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_P = 0x9E3779B97F4A7C17 & ~0x3 | 0x3
_MASK = (1 << 64) - 1
_PINV = pow(_P, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element-wise."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE = _BYTE[_LOWER]
_BYTE[_SEP] = 0
#: Bytes that are hashed at once, with the powers of the hash's base and of its inverse for them.
STEP = 1 << 16
with np.errstate(over="ignore"):
    _POWER, _INVERSE = (np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(STEP, _U(base & _MASK), _U)])) for base in (_P, _PINV))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word data[start : end], some 64 KB at a time, so that memory doesn't follow the size of a batch or a word."""
    out = np.empty(len(start), _U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            base = start[i]
            j = int(np.searchsorted(end, base + STEP, side="right"))
            if j > i:
                values = _BYTE[data[base : end[j - 1]]]
                values *= _POWER[: len(values)]
                begin = start[i:j] - base
                out[i:j] = np.add.reduceat(values, begin) * _INVERSE[begin]
                i = j
            else:  # a word of more than STEP bytes
                total, scale = _U(0), _U(1)
                for at in range(base, end[i], STEP):
                    part = _BYTE[data[at : min(at + STEP, end[i])]]
                    total += (part * _POWER[: len(part)]).sum(dtype=_U) * scale
                    scale *= _POWER[STEP]
                out[i] = total
                i += 1
    return mix(out)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of about `most` bytes of text, as arrays over each byte take many times that."""
    group = text_buffers(batch.column(column))[1][:-1] // most
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist() if len(group) else []
    for i, j in zip(cut, [*cut[1:], len(group)][: len(cut)], strict=True):
        yield batch.slice(i, j - i)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of concatenated texts, and where each text's words begin.

    start and end are byte positions in data; the last array has one more entry than texts.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, np.zeros(len(offsets), np.int64)
    sep = _SEP[data]
    begins = ~sep
    ends = begins.copy()
    first = np.zeros(n, dtype=bool)
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = True
    first[0] = True
    begins[1:] &= sep[:-1] | first[1:]
    ends[:-1] &= sep[1:] | first[1:]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    per_text = np.searchsorted(start, offsets)
    if len(start) == 0:
        return np.zeros(0, _U), start, end, per_text
    return _word_hashes(data, start, end), start, end, per_text


def shingles(hashed: np.ndarray, per_text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in order, and where each text's shingles begin.

    A text of fewer than k words, but one at least, has its whole sequence as its one shingle.
    """
    counts = np.diff(per_text)
    n_out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(n_out)])
    total = int(begin[-1])
    if total == 0:
        return np.zeros(0, _U), begin
    m = len(hashed)
    rolled = np.zeros(m, _U)
    a = _U(0xD6E8FEB86659FD93)
    for j in range(min(k, m)):
        rolled[: m - j] = rolled[: m - j] * a + hashed[j:] + _U(1)
    rolled = mix(rolled)
    position = np.arange(total, dtype=np.int64) + np.repeat(per_text[:-1] - begin[:-1], n_out)
    out = rolled[position]
    for t in np.flatnonzero((counts > 0) & (counts < k)):
        x = _U(0)
        with np.errstate(over="ignore"):
            for h in hashed[per_text[t] : per_text[t + 1]]:
                x = x * a + h + _U(1)
            out[begin[t]] = mix(np.array([x + _U(int(counts[t]) << 32)], _U))[0]
    return out, begin


def distinct_sets(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and where they begin."""
    n = len(begin) - 1
    counts = np.diff(begin)
    owner = np.repeat(np.arange(n), counts)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=n))]).astype(np.int64)
