"""Benchmark decontamination: passages of documents that are near copies of benchmark items.

A document window as long as an item (in words) is contaminated where the weighted Jaccard similarity of their word shingles, weights being how often a shingle occurs, is at least
the threshold. Windows are found by SimHash:

* Every text gets 64-bit SimHash fingerprints of windows as long as each item, a fifth of the item apart. Sums over windows are differences of running sums.
* Fingerprints of windows and items are compared by a multi-index: two fingerprints within radius 23 agree within 2 bits in at least one of eight blocks of eight bits, so the blocks' tables
  give every item within the radius.
* Around candidates, all windows are verified by exact weighted similarity, after a bound: how many of their shingles occur in any item at all.

At similarity 0.8 fingerprints of windows that lie half a step apart differ in 13 bits on average with a deviation of 3, so that the radius loses one or two windows in a thousand at the very
threshold and practically none above it; the tests hold this against brute force.

Text is lower-cased and ASCII punctuation separates words, for items and documents alike. Items with fewer words than a shingle are one shingle of all their words; items or
documents without words (or null) match nothing; a document shorter than an item is one window. Repeated rows are treated alike; of equally similar windows the first is given; empty tables
give empty results. A long text is worked on whole, which takes about 200 bytes a word. The benchmark is a query set: it goes to the tasks in blocks of at most
about `block_items` items and `block_bytes` bytes, so that what is broadcast has a fixed bound, and each block is held against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.arrays import combine, hash_words, mix, slices, word_spans

RADIUS, BLOCKS = 23, 8
BLOCK_ITEMS, BLOCK_BYTES = 5000, 8 << 20
#: Windows of an item's length are this part of it apart.
STEP = 5
#: Bytes of text that are worked on at once.
SLICE = 1 << 18
_SEPARATE = np.arange(256, dtype=np.uint8)
_SEPARATE[[b for b in range(33, 128) if not chr(b).isalnum()]] = 32
_ONES = np.array([v.bit_count() for v in range(256)], dtype=np.uint8)


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts and each row's first word index."""
    data = _SEPARATE[data]
    starts, ends, first = word_spans(data, offsets)
    return hash_words(data, starts, ends), first


def running_ones(shingles: np.ndarray, most: int) -> np.ndarray:
    """How many of the shingles before each have each of 64 bits, modulo what windows of at most `most` shingles need."""
    ones = np.zeros((len(shingles) + 1, 64), dtype=np.uint8 if most < 256 else np.uint32)
    np.cumsum(np.unpackbits(mix(shingles).view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=ones.dtype, out=ones[1:])
    return ones


def fingerprints(ones: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of the shingles starts .. starts + sizes: the bits that more than half of them have."""
    inside = ones.take(starts + sizes, axis=0)
    inside -= ones.take(starts, axis=0)  # wraps round like the sums
    half = (sizes // 2).astype(ones.dtype)
    return np.packbits(inside > (half[0] if len(half) and (half == half[0]).all() else half[:, None]), axis=1).view(np.uint64).ravel()


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller weights over sum of larger ones; a, b: shingles with repeats."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


class MultiIndex:
    """Fingerprints by their blocks: tables of which of 64 fingerprints are near each value of a block."""

    def __init__(self, prints: np.ndarray) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        values = np.arange(256, dtype=np.uint8)
        for a in range(0, len(prints), 64):
            own = prints[a : a + 64]
            near = _ONES[values[None, :, None] ^ own.view(np.uint8).reshape(-1, BLOCKS).T[:, None, :]] <= RADIUS // BLOCKS
            self.parts.append((own, (near.astype(np.uint64) << np.arange(len(own), dtype=np.uint64)).sum(axis=2, dtype=np.uint64)))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, fingerprint) of all pairs within the radius."""
        blocks, found = prints.view(np.uint8).reshape(-1, BLOCKS), []
        for nth, (own, tables) in enumerate(self.parts):
            candidates = tables[0].take(blocks[:, 0])
            for b in range(1, BLOCKS):
                candidates |= tables[b].take(blocks[:, b])
            for j, p in enumerate(own):
                at = np.flatnonzero((candidates & np.uint64(1 << j) > 0) & (np.bitwise_count(prints ^ p) <= RADIUS))
                found.append((at, np.full(len(at), 64 * nth + j)))
        return tuple(map(np.concatenate, zip(*found, strict=True)))


class Items:
    """A block of benchmark items: shingles, and an index of the fingerprints of each length in words."""

    def __init__(self, ids: list[int], texts: list[str], k: int) -> None:
        raw = [t.encode() for t in texts]
        words, first = plain_words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))
        self.ids, self.lengths, self.k = ids, np.diff(first), k
        self.shingles = [combine(words[a:b], min(k, b - a)) if b > a else words[:0] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.by_length: dict[int, tuple[np.ndarray, MultiIndex]] = {}
        for n in np.unique(self.lengths[self.lengths > 0]).tolist():
            own = np.flatnonzero(self.lengths == n)
            size = len(self.shingles[own[0]])
            prints = np.concatenate([fingerprints(running_ones(self.shingles[i], size), np.zeros(1, np.int64), np.array([size])) for i in own])
            self.by_length[n] = own, MultiIndex(prints)
        self.seen = {m: np.zeros(1 << 20, dtype=bool) for m in {min(k, n) for n in self.by_length}}
        for s, n in zip(self.shingles, self.lengths.tolist(), strict=True):
            if n:
                self.seen[min(k, n)][(s >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, words: np.ndarray, first: np.ndarray, at_least: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of the most similar window of each row and item, the first of equals."""
        sizes = np.diff(first)
        for m, seen in self.seen.items():
            runs = combine(words, m)
            if not len(runs):
                continue
            lengths = [n for n in self.by_length if min(self.k, n) == m]
            ones = running_ones(runs, max(lengths) - m + 1)
            known = np.concatenate([[0], np.cumsum(seen[(runs >> np.uint64(44)).astype(np.int64)])])
            for n in lengths:
                yield from self._of_length(n, m, runs, ones, known, first, sizes, at_least)

    def _of_length(self, n: int, m: int, runs: np.ndarray, ones: np.ndarray, known: np.ndarray, first: np.ndarray, sizes: np.ndarray, at_least: float) -> Iterator[tuple[int, int, float, int, int]]:
        own, index = self.by_length[n]
        step, need = max(1, n // STEP), math.ceil(at_least * (n - m + 1) - 1e-9)
        rows = np.flatnonzero(sizes - m + 1 >= need)
        last = np.maximum(sizes[rows] - n, 0)  # last start in the row
        count = -(-last // step) + 1
        row = np.repeat(rows, count)
        start = first[row] + np.minimum((np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step, np.repeat(last, count))
        if not len(start):
            return
        size = np.minimum(sizes[row], n) - m + 1
        at, item = index.within(fingerprints(ones, start, size))
        # the window and all up to a step away have too few shingles of any item: none of them can be similar
        low, high = np.maximum(start[at] - step, first[row[at]]), np.minimum(start[at] + step, first[row[at]] + np.maximum(sizes[row[at]] - n, 0))
        good = known[high + size[at]] - known[low] >= need
        best: dict[tuple[int, int], tuple[float, int]] = {}
        tried: set[tuple[int, int]] = set()
        for r, i, w, a, b in zip(*(x[good].tolist() for x in (row[at], own[item], size[at], low, high)), strict=True):
            for p in range(a, b + 1):
                if (i, p) in tried or known[p + w] - known[p] < need:
                    continue
                tried.add((i, p))
                similar = weighted_similarity(runs[p : p + w], self.shingles[i])
                if similar >= at_least:
                    best[r, i] = max(best.get((r, i), (0.0, 0)), (similar, -p))
        for (r, i), (similar, p) in sorted(best.items()):
            yield r, i, similar, -p - int(first[r]), int(min(sizes[r], n))


HITS = "doc_id long, item_id long, similarity double, first_word long, n_words long"
_hits = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])
_built: dict[tuple[int, int], Items] = {}


def _items(block, k: int) -> Items:
    if (block.id, k) not in _built:
        _built.clear()
        _built[block.id, k] = Items(*block.value, k)
    return _built[block.id, k]


def _search(batches: Iterator[pa.RecordBatch], block, k: int, at_least: float) -> Iterator[pa.RecordBatch]:
    items = _items(block, k)
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for a, _, data, offsets in slices(batch.column(1), SLICE):
            out = [(ids[a + row], items.ids[item], *found) for row, item, *found in items.matches(*plain_words(data, offsets), at_least)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _hits, strict=True)], schema=_hits)


class _Block:
    """A broadcast block with a name that workers remember it by."""

    def __init__(self, spark, value) -> None:
        self.sent = spark.sparkContext.broadcast(value)
        self.id = self.sent._jbroadcast.id()

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}

    @property
    def value(self):
        return self.sent.value


def _blocks(benchmark: DataFrame, block_items: int, block_bytes: int) -> Iterator[_Block]:
    items = benchmark.select(F.col("item_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text"))
    count, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, math.ceil(count / block_items), math.ceil(size / block_bytes))
    for b in range(n):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()  # one block, about
        yield _Block(benchmark.sparkSession, ([r[0] for r in own], [r[1] or "" for r in own]))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, at_least: float = 0.8, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of docs and benchmark item with a similar window: doc_id, item_id, similarity, first_word, n_words of the best window."""
    rows = docs.select(F.col(id_column).cast("long"), F.lower(F.col(text_column).cast("string")))
    found = [rows.mapInArrow(lambda it, block=block: _search(it, block, k, at_least), HITS) for block in _blocks(benchmark, block_items, block_bytes)]
    return reduce(DataFrame.unionByName, found)


def _clean(batches: Iterator[pa.RecordBatch], block: _Block, k: int, at_least: float, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Whole rows; the last column, the lower-cased text, is for the search alone."""
    items = _items(block, k)
    for batch in batches:
        keep = np.ones(batch.num_rows, dtype=bool)
        for a, _, data, offsets in slices(batch.column(batch.num_columns - 1), SLICE):
            for row, *_ in items.matches(*plain_words(data, offsets), at_least):
                keep[a + row] = False
        yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=list(names)).filter(pa.array(keep))


def without_contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, at_least: float = 0.8, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, text_column: str = "text") -> DataFrame:
    """The rows of docs without a contaminated passage, with the same columns. Row by row: ids don't matter, and nothing is shuffled."""
    for block in _blocks(benchmark, block_items, block_bytes):
        by_place = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        with_text = by_place.withColumn("lower", F.lower(F.col(f"c{docs.columns.index(text_column)}").cast("string")))
        docs = with_text.mapInArrow(lambda it, block=block, names=tuple(docs.columns): _clean(it, block, k, at_least, names), docs.schema)
    return docs
