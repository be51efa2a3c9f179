"""Vectorised text helpers for use inside Arrow tasks: words, hashes and shingles over whole batches of UTF-8 text.

All functions work on one contiguous byte buffer with row offsets, the layout in which Arrow hands strings over,
so the cost per row is a few numpy calls shared by the whole slice. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a single longer row forms a slice of its own.
SLICE_BYTES = 1 << 17

#: White space of the text contracts: \x20 and \x09-\x0D.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = np.ones(1, dtype=np.uint64)
_inverse_powers = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        for name, base in (("_powers", BASE), ("_inverse_powers", BASE_INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _powers, _inverse_powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values, so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def grouped(f, *args):
    """f(*args, table) as a function of the group's table alone, as applyInArrow takes it."""

    def run(table: pa.Table) -> pa.Table:
        return f(*args, table)

    return run


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its len + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to, bytes, offsets) of at most `most` bytes, or one longer row."""
    data, offsets = text_buffer(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from prefix sums of a polynomial over per-byte random values."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUE[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows with A-Z lower-cased, and each row's first word index."""
    lower = LOWER[data]
    starts, ends, first = word_spans(lower, offsets)
    return hash_words(lower, starts, ends), first


def hash_runs(columns: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive hashes of the rows that these columns of hashes form."""
    out = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for c in columns:
        out = mix(out * BASE + c)
    return out


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k successive words, over row ends too; the caller leaves those out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return hash_runs([words[j : j + n] for j in range(k)])


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct k-word shingle hashes. A row of fewer words has its whole sequence as one; one without words has none."""
    runs = combine(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        else:
            yield combine(words[a:b], b - a) if b > a else runs[:0]
