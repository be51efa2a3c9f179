"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and read from sorted hash arrays.

Counting is one chain of shuffles, an order each, from the highest down. A task sums the n-grams of its rows and sends them to buckets as packed, compressed arrays. A bucket sums
them, writes its arrays and sends on the next lower order, whose counts are the numbers of distinct words before an n-gram. An n-gram's bucket follows from its middle words, so that its context is
whole in one bucket and few n-grams of the lower order are counted in two; where these words are frequent, from the context, and where all of that is frequent, from the whole n-gram. In
the last case the context's sums are added up over buckets. No frequent word makes a bucket larger than others.

A bucket's arrays are one file in the shared folder: n-grams and their counts, contexts with total and how many of their continuations have count 1, 2 and more, both sorted by hash. Of a
hash 24 bits are stored, others say where to look, so that about one look-up in five million finds what isn't there. Workers map files into memory, so that the model is neither sent through the driver nor held by any
process. A slice's look-ups are put in order of their files, and files with few of them share numpy's calls but for the reading. The folder has to be mounted where tasks run; a worker that doesn't see the model's mark in it raises.

p_k(w | u) = max(c(uw) - D(c(uw)), 0) / c(u.) + (D1 N1(u.) + D2 N2(u.) + D3 N3+(u.)) / c(u.) * p_{k-1}(w | u'), down to 1 / (V + 1) below unigrams;
an unseen context passes to the next lower order whole. A text's first words see begin marks as context, which are never predicted.
D_j = j - (j + 1) Y n_{j+1} / n_j with Y = n_1 / (n_1 + 2 n_2), of each order's counts; where that can't be formed or is out of range, it is 0.5 j.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; each text ends with one end token. A null text is empty: just its end. An empty training set gives 1 / (V + 1) for all.
Repeated rows count as often as they occur, null ids are in fold 0, other columns aren't read, and a long text takes no more memory than its own words.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.arrays import grouped, hash_runs, hashed_words, slices, table_of
from tarnlake.llm.staging import new_path, parts, staged, text_bytes

BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x38B34AE5E6546B64)
#: Words that a task gathers before it sums and sends them.
GATHERED = 3 << 19
#: n-grams whose hashes and buckets are worked out at once; the steps between take several times their space.
CHUNK = 1 << 16
#: Bytes of text whose look-ups are sorted together.
SCORED_BYTES = 1 << 21
#: Hashes that are compared with stored keys at once.
COMPARED = 1 << 14
MARK = "complete"


def _tokens(data: np.ndarray, offsets: np.ndarray, begins: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with `begins` begin marks before and one end token after each text, and where each text begins (one more at the end)."""
    words, first = hashed_words(data, offsets)
    n = np.diff(first)
    at = np.concatenate([[0], np.cumsum(n + begins + 1)])
    out = np.full(at[-1], BEGIN, dtype=np.uint64)
    out[at[1:] - 1] = END
    row = np.repeat(np.arange(len(n)), n)
    out[at[row] + begins + np.arange(len(words)) - first[row]] = words
    return out, at


def _firsts(h: np.ndarray) -> np.ndarray:
    """Where sorted values differ from the one before."""
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)


def _sorted(h: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal numbers of so many bits are neighbours, and the numbers in it.

    Numbers are sorted with their places as lowest bits, several times faster than argsort. Where bits had to give way to these and were all that numbers differ in, argsort serves."""
    low = np.uint64(len(h).bit_length())
    place = (np.uint64(1) << low) - np.uint64(1)
    fit = bits + int(low) <= 64
    both = (h.astype(np.uint64) << low) if fit else h & ~place
    both |= np.arange(len(h), dtype=np.uint64)
    both.sort()
    if fit:
        order = (both & place).view(np.int64)
        both >>= low
        return order, both
    alike = np.zeros(max(len(h) - 1, 0), dtype=bool)
    for own in _chunks(len(alike)):
        alike[own] = (both[own.start + 1 : own.stop + 1] ^ both[:-1][own]) <= place
    both &= place
    order = both.view(np.int64)
    ordered = h[order]
    if np.any(alike & (ordered[1:] != ordered[:-1])):
        order = np.argsort(h)
        ordered = h[order]
    return order, ordered


def _coded(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, and which of them each one is."""
    order, ordered = _sorted(words)
    new = _firsts(ordered)
    code = np.empty(len(words), np.int64)
    code[order] = np.repeat(np.arange(len(new)), np.diff(new, append=len(words)))
    return ordered[new], code


def _sum(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of n words each and their summed counts."""
    order, h = _sorted(ngram_hash(rows))
    new = _firsts(h)
    del h
    return rows[order[new]], np.add.reduceat(counts[order], new) if len(order) else counts


def _chunks(n: int) -> Iterator[slice]:
    return (slice(a, a + CHUNK) for a in range(0, n, CHUNK))


def ngram_hash(rows: np.ndarray) -> np.ndarray:
    """Of an (m, n) array of word hashes; all empty n-grams are one."""
    out = np.zeros(len(rows), np.uint64)
    if rows.shape[1]:
        for own in _chunks(len(rows)):
            out[own] = hash_runs([rows[own, j] for j in range(rows.shape[1])])
    return out


def _by_bucket(bucket: np.ndarray) -> np.ndarray:
    """Order of buckets; numbers of 16 bits are sorted by their digits."""
    return np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")


def _is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """among: sorted."""
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def context_keys(contexts: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each context is dealt by, and whether it is split over buckets instead. frequent: sorted words, the begin mark among them."""
    often = [_is_in(contexts[:, j], frequent) for j in range(contexts.shape[1])]
    if len(often) < 2:
        return ngram_hash(contexts), np.logical_and.reduce([np.ones(len(contexts), bool), *often])
    key, whole = ngram_hash(contexts[:, 1:]), np.logical_and.reduce(often[1:])
    own = np.flatnonzero(whole)
    key[own] = ngram_hash(contexts[own])
    return key, whole & often[0]


def _range_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def places(rows: np.ndarray, frequent: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram's bucket, and whether its context is split over buckets."""
    bucket, split = np.empty(len(rows), np.int64), np.empty(len(rows), bool)
    for own in _chunks(len(rows)):
        key, split[own] = context_keys(rows[own, :-1], frequent)
        apart = np.flatnonzero(split[own])
        key[apart] = ngram_hash(rows[own][apart])
        bucket[own] = _range_of(key, buckets)
    return bucket, split


_packed = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("numbers", pa.list_(pa.int64()))])
PACKED = "bucket int, kind int, data binary, numbers array<long>"
#: Kinds of messages: n-grams of this width or, from there on, what passes through to the end.
SPLIT, TOTAL = 100, 200


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compresses better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _of_planes(data: bytes, at: int, n: int, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(f"<u{size}").reshape(n)


def _least_type(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * int(t[2])))


def pack(rows: np.ndarray, counts: np.ndarray) -> tuple[bytes, list[int]]:
    """n-grams as numbers of their distinct words, the most frequent ones first, sorted and compressed, and what it takes to read them."""
    width = rows.shape[1]
    words, code = _coded(rows.reshape(-1))
    rank = np.lexsort((words, -np.bincount(code)))
    to = np.empty(len(rank), np.int64)
    to[rank] = np.arange(len(rank))
    code, words = to[code.reshape(rows.shape)], words[rank]
    if len(words) ** width < 1 << 62:
        key = np.zeros(len(rows), np.int64)
        for j in [*range(1, width - 1), 0, *[width - 1] * (width > 1)]:
            key = key * len(words) + code[:, j]
        order, _ = _sorted(key.astype(np.uint64), (len(words) ** width).bit_length())
        code, counts = code[order], counts[order]
    code, counts = _least_type(code), _least_type(counts)
    data = _planes(np.diff(words, prepend=np.uint64(0))) + b"".join(_planes(np.ascontiguousarray(code[:, j])) for j in range(width)) + _planes(counts)
    return pa.compress(data, "zstd", asbytes=True), [len(rows), len(words), code.itemsize, counts.itemsize, len(data)]


def unpack(data: bytes, numbers: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    n, words, code, count, size = numbers
    data = pa.decompress(data, size, "zstd", asbytes=True)
    own = np.cumsum(_of_planes(data, 0, words, 8))
    rows = np.stack([own[_of_planes(data, 8 * words + j * n * code, n, code)] for j in range(width)], axis=1)
    return rows, _of_planes(data, 8 * words + width * n * code, n, count).astype(np.int64)


def _deal(rows: np.ndarray, counts: np.ndarray, frequent: np.ndarray, buckets: int) -> list[tuple]:
    """A message of n-grams for each bucket."""
    bucket, _ = places(rows, frequent, buckets)
    order = _by_bucket(bucket)
    cut = _firsts(bucket[order])
    return [(int(bucket[order[a]]), rows.shape[1], *pack(rows[order[a:b]], counts[order[a:b]])) for a, b in zip(cut, [*cut[1:], len(order)], strict=True)]


def _count(batches: Iterator[pa.RecordBatch], order: int, frequent: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """n-grams of whole texts; a text's n-grams end at each of its words and its end."""
    held: list[np.ndarray] = []  # words, then begin marks after the last one

    def close() -> Iterator[pa.RecordBatch]:
        grams = np.lib.stride_tricks.sliding_window_view(np.concatenate(held), order)  # of the words' own space
        held.clear()
        # an n-gram begins wherever its last word isn't a begin mark
        starts = np.flatnonzero(grams[:, -1] != BEGIN)
        by, h = _sorted(ngram_hash(grams)[starts])
        new = _firsts(h)
        starts, counts = starts[by[new]], np.diff(np.concatenate([new, [len(by)]]))
        del h, by, new
        rows = grams[starts]
        del grams, starts
        yield from table_of(_deal(rows, counts, frequent, buckets), _packed).to_batches()

    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            tokens, _ = _tokens(data, offsets, order - 1)
            while len(tokens):
                room = GATHERED - sum(map(len, held))
                held.append(tokens[:room])
                if len(tokens) < room:
                    break
                yield from close()
                tokens = tokens[room - order + 1 :] if len(tokens) > room else tokens[:0]
    if held:
        yield from close()


def _local(path: str) -> str:
    """The path as the operating system has it; arrays are mapped, so the shared folder must be mounted."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: model arrays are mapped into memory, so spark.checkpoint.dir must be a mounted folder (file://)")
    return path


def _save(path: str, arrays: list[np.ndarray]) -> None:
    """All arrays in one file, put in place whole, so that a task that runs twice leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    mine = f"{path}.{uuid.uuid4().hex}"
    with open(mine, "wb") as f:
        f.write(np.array([[a.itemsize, len(a)] for a in arrays], "<i8").tobytes())
        for a in arrays:
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(mine, path)


#: A mapped file then needs no open one, of which a process has few.
_UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}


def _load(path: str, n: int) -> list[np.ndarray] | None:
    try:
        with open(path, "rb") as f:
            data = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_UNTRACKED), np.uint8)
    except FileNotFoundError:
        return None
    at, out = 16 * n, []
    for size, length in data[:at].view("<i8").reshape(n, 2).tolist():
        out.append(data[at : at + size * length].view(f"<u{size}"))
        at += -(-size * length // 8) * 8
    return out


#: Bits of a key that are stored; those above say where to look.
STORED = 24
#: Keys in a place on average, and bits of the number of places of which the first one's begin is stored whole; the others count on from it.
LOAD, GROUP = 3, 5


def _place(h: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Which of about n / LOAD places a key is in; the highest bits of a hash say in which bucket."""
    return ((((h >> np.uint64(STORED)) & np.uint64(0xFFFFFF)) * np.asarray(n // LOAD + 1, np.uint64)) >> np.uint64(24)).astype(np.int64)


def _sorted_keys(h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the keys, and where each place begins and the stored bits in this order."""
    place = _place(h, len(h))
    begin = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(h) // LOAD + 1))])
    whole = begin[:: 1 << GROUP].astype("<u4")
    on = _least_type(begin - whole[np.arange(len(begin)) >> GROUP])
    del begin
    key = place.view(np.uint64) << np.uint64(STORED)
    del place
    key |= h & np.uint64((1 << STORED) - 1)
    order, key = _sorted(key, STORED + (len(h) // LOAD + 1).bit_length())
    return order, [whole, on, (key & np.uint64(0xFFFF)).astype("<u2"), ((key >> np.uint64(16)) & np.uint64(0xFF)).astype("<u1")]


def _by_key(h: np.ndarray, columns: list[np.ndarray], plain: np.ndarray) -> list[np.ndarray]:
    """Sorted arrays: keys of rows that are all ones (plain); keys and columns of the others, in bytes, and where these don't do, the row and whole numbers."""
    ones, others = np.flatnonzero(plain), np.flatnonzero(~plain)
    _, out = _sorted_keys(h[ones])
    order, keys = _sorted_keys(h[others])
    order = others[order]
    large = np.flatnonzero(np.logical_or.reduce([c[order] > 254 for c in columns]))
    return [*out, *keys, *(np.minimum(c[order], 255).astype("<u1") for c in columns), large.astype("<u4"), *(c[order[large]].astype("<u8") for c in columns)]


def _taken(arrays: list[np.ndarray], cut: list[int], index: np.ndarray, kind: type) -> np.ndarray:
    """What each file's array has at its part of the index's last axis; a number where that is beyond the end, too."""
    out = np.zeros(index.shape, kind)
    for array, a, b in zip(arrays, cut, cut[1:], strict=False):
        if a < b and len(array):
            out[..., a:b] = array.take(index[..., a:b], mode="clip")
    return out


def _found(files: list[list[np.ndarray]], cut: list[int], h: np.ndarray) -> np.ndarray:
    """Where each hash is in its file's sorted keys, or -1; it is compared with the keys in its place, the first ones of all places first."""
    whole, on, low, high = zip(*files, strict=True)
    place = _place(h, np.repeat(np.array([len(x) for x in low], np.uint64), np.diff(cut)))
    place = np.stack([place, place + 1])
    begin, end = _taken(whole, cut, place >> GROUP, np.int64) + _taken(on, cut, place, np.int64)
    own_low, own_high, out = h.astype(np.uint16), (h >> np.uint64(16)).astype(np.uint8), np.full(len(h), -1, dtype=np.int64)
    at = begin + np.arange(LOAD)[:, None]
    hit = (_taken(low, cut, at, np.uint16) == own_low) & (_taken(high, cut, at, np.uint8) == own_high) & (at < end)
    for which, x in zip(hit, at, strict=True):
        np.copyto(out, x, where=which)
    begin += LOAD
    left = np.flatnonzero((begin < end) & (out < 0))
    if len(left):
        n = end[left] - begin[left]
        which = left.repeat(n)
        at = (begin[left] - np.cumsum(n) + n).repeat(n) + np.arange(len(which))
        cut = np.searchsorted(which, cut).tolist()
        hit = (_taken(low, cut, at, np.uint16) == own_low[which]) & (_taken(high, cut, at, np.uint8) == own_high[which])
        out[which[hit]] = at[hit]
    return out


def _groups(pieces: list[tuple[int, int, list[np.ndarray]]]) -> Iterator[list[tuple[int, int, list[np.ndarray]]]]:
    """Pieces cut to COMPARED hashes at most, and of small ones as many together."""
    group: list[tuple[int, int, list[np.ndarray]]] = []
    for start, stop, arrays in pieces:
        for a in range(start, stop, COMPARED):
            b = min(stop, a + COMPARED)
            if group and b - group[0][0] > COMPARED:
                yield group
                group = []
            group.append((a, b, arrays))
    if group:
        yield group


def _in_files(pieces: list[tuple[int, int, list[np.ndarray]]], h: np.ndarray, n: int) -> list[np.ndarray]:
    """The n columns of each hash, 0 where it isn't there. pieces: from, to and the arrays of the file where these hashes may be.

    With many files each has few hashes, so that numpy's calls are shared between files but for the reading itself."""
    out = [np.zeros(len(h), dtype=np.int64) for _ in range(n)]
    for group in _groups(pieces):
        start, files = group[0][0], [arrays for _, _, arrays in group]
        own, cut = h[start : group[-1][1]], [0, *(b - start for _, b, _ in group)]
        plain = _found([x[:4] for x in files], cut, own) >= 0
        for j in _ONES[n]:
            out[j][start : start + len(own)] = plain
        missing = np.flatnonzero(~plain)
        at = _found([x[4:8] for x in files], np.searchsorted(missing, cut).tolist(), own[missing])
        hit = np.flatnonzero(at >= 0)
        missing, at = missing[hit], at[hit]
        cut, beyond = np.searchsorted(missing, cut).tolist(), np.zeros(len(at), dtype=bool)
        for j, c in enumerate(out):
            stored = _taken([x[8 + j] for x in files], cut, at, np.uint8)
            c[start + missing] = stored
            beyond |= stored == 255
        beyond = np.flatnonzero(beyond)
        if len(beyond):
            cut = np.searchsorted(beyond, cut).tolist()
            for arrays, a, b in zip(files, cut, cut[1:], strict=False):
                if a < b:
                    row = np.searchsorted(arrays[8 + n], at[beyond[a:b]])
                    for j, c in enumerate(out):
                        c[start + missing[beyond[a:b]]] = arrays[9 + n + j][row]
    return out


def _looked_up(arrays: list[np.ndarray], h: np.ndarray, n: int) -> list[np.ndarray]:
    """The n columns of each hash in one file's arrays."""
    return _in_files([(0, len(h), arrays)], h, n)


#: Which columns of a plain row are 1: an n-gram's count; a context's total, continuations of count 1 and all continuations.
_ONES = {1: (0,), 4: (0, 1, 3)}
_N_ARRAYS = {1: 11, 4: 17}
#: The arrays of no rows.
_NOTHING = {n: _by_key(np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * n, np.zeros(0, bool)) for n in _ONES}


def _written(rows: np.ndarray, counts: np.ndarray, path: str, frequent: np.ndarray, buckets: int) -> list[tuple]:
    """Writes n-grams and contexts; gives the sums of split contexts."""
    arrays = _by_key(ngram_hash(rows), [counts], counts == 1)
    by, context = _sorted(ngram_hash(rows[:, :-1]))
    new = _firsts(context)
    own, first = context[new], by[new]
    del context
    whole = ~places(rows[first], frequent, buckets)[1]
    ordered = counts[by]
    del by, first
    sums = [np.add.reduceat(x, new, dtype=np.int64) for x in (ordered, ordered == 1, ordered == 2)] + [np.diff(new, append=len(ordered))]
    del ordered, new
    apart = np.flatnonzero(~whole)
    split = [(int(to), SPLIT + rows.shape[1], own[i].tobytes(), [int(x[i]) for x in sums]) for i, to in zip(apart.tolist(), _range_of(own[apart], buckets), strict=True)]
    if len(apart):
        own = own[whole]
        for j, x in enumerate(sums):
            sums[j] = x[whole]
        del x
    _save(path, arrays + _by_key(own, sums, sums[0] == 1))
    return split


def _ngrams(order: int, folder: str, frequent: np.ndarray, buckets: int, table: pa.Table) -> pa.Table:
    """Writes a bucket's n-grams and contexts; gives the next lower order's n-grams, sums of split contexts and a row of totals. What isn't an n-gram of this order passes through."""
    kinds = table.column("kind").to_pylist()
    every, out, at = table.column("numbers").to_pylist(), [], 0
    bucket = table.column("bucket")[0].as_py()
    total = sum(numbers[0] for kind, numbers in zip(kinds, every, strict=True) if kind == order)
    rows, counts = np.empty((total, order), np.uint64), np.empty(total, np.int64)
    for kind, data, numbers in zip(kinds, table.column("data"), every, strict=True):
        if kind == order:
            rows[at : at + numbers[0]], counts[at : at + numbers[0]] = unpack(data.as_py(), numbers, order)
            at += numbers[0]
        else:
            out.append((bucket, kind, data.as_py(), numbers))
    if total:
        rows, counts = _sum(rows, counts)
        out += _written(rows, counts, f"{folder}/{order}/{bucket:08d}", frequent, buckets)
        out.append((bucket, TOTAL + order, b"", [int((counts == j).sum()) for j in (1, 2, 3, 4)]))
        del counts
        if order > 1:
            lower = _sum(rows[:, 1:], np.ones(len(rows), np.int64))
            del rows
            out += _deal(*lower, frequent, buckets)
    return table_of(out, _packed)


def _split_contexts(folder: str, buckets: int, table: pa.Table) -> pa.Table:
    """Writes the sums of contexts that were split."""
    h = np.array([int.from_bytes(x.as_py(), "little") for x in table.column("data")], np.uint64)
    sums = [table.column(f"n{j}").to_numpy() for j in range(4)]
    bucket = table.column("bucket")[0].as_py()
    _save(f"{folder}/{table.column('kind')[0].as_py() - SPLIT}split/{bucket:08d}", _by_key(h, sums, np.zeros(len(h), bool)))
    return pa.table({"done": pa.array([bucket], pa.int32())})


@dataclass(frozen=True)
class NgramModel:
    """Where the arrays are and the few numbers that all texts share."""

    order: int
    folder: str
    buckets: int
    train_tokens: int
    types: int
    discounts: tuple[tuple[float, float, float], ...] = field(default=())  # of order 1, 2, ...
    frequent: tuple[int, ...] = ()  # sorted words that don't make a bucket alone


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    found = [j - (j + 1) * y * above / own if own else 0.5 * j for j, own, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(d if 0 < d < j else 0.5 * j for j, d in zip((1, 2, 3), found, strict=True))


def _plain(folder: str, often: int, table: pa.Table) -> pa.Table:
    """Writes a bucket's word counts; gives their sum and number, and its words of `often` occurrences or more."""
    both = [unpack(d.as_py(), n, 1) for d, n in zip(table.column("data"), table.column("numbers").to_pylist(), strict=True)]
    rows, counts = _sum(*map(np.concatenate, zip(*both, strict=True)))
    _save(f"{folder}/plain/{table.column('bucket')[0].as_py():08d}", _by_key(ngram_hash(rows), [counts], counts == 1))
    many = np.flatnonzero(counts >= often)
    return table_of([(int(counts.sum()), len(counts), rows[many, 0].view(np.int64).tolist(), counts[many].tolist())], _words)


_words = pa.schema([("tokens", pa.int64()), ("types", pa.int64()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def fit(texts: DataFrame, text_column: str = "text", order: int = 3, bucket_bytes: int = 12 << 20, often: int = 1 << 18, most_frequent: int = 1 << 16) -> NgramModel:
    """Counts every text and writes the model to the shared folder. Only sums of a few numbers come to the driver.

    Words of `often` occurrences or more don't make a bucket alone, the `most_frequent` most frequent ones of these at most."""
    spark = texts.sparkSession
    folder = _local(new_path(spark, "ngrams"))
    texts = texts.select(F.col(text_column).cast("string"))
    buckets = parts(text_bytes(texts, text_column), bucket_bytes)
    none = np.array([BEGIN])
    plain = texts.mapInArrow(lambda it: _count(it, 1, none, buckets), PACKED).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(grouped(_plain, folder, often), "tokens long, types long, words array<long>, counts array<long>")
    plain = staged(plain, "words")
    tokens, types = plain.agg(F.sum("tokens"), F.sum("types")).first()
    found = plain.select(F.inline(F.arrays_zip("words", "counts"))).orderBy(F.desc("counts"), "words").limit(most_frequent).collect()
    frequent = np.unique(np.array([int(BEGIN), *(r[0] % (1 << 64) for r in found)], np.uint64))
    counted = texts.mapInArrow(lambda it: _count(it, order, frequent, buckets), PACKED)
    for width in range(order, 0, -1):
        counted = counted.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(grouped(_ngrams, width, folder, frequent, buckets), PACKED)
    counted = staged(counted, "ngram-totals")
    sums = [F.sum(F.col("numbers")[j]).alias(f"n{j}") for j in range(4)]
    n_of = {r["kind"] - TOTAL: [r[f"n{j}"] for j in range(4)] for r in counted.filter(F.col("kind") >= TOTAL).groupBy("kind").agg(*sums).collect()}
    split = counted.filter(F.col("kind") < TOTAL).groupBy("kind", "bucket", "data").agg(*sums)
    split.groupBy("kind", "bucket").applyInArrow(grouped(_split_contexts, folder, buckets), "done int").agg(F.count("done")).collect()
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{MARK}", "wb"):
        pass
    return NgramModel(order, folder, buckets, int(tokens or 0), int(types or 0), tuple(discounts(*n_of.get(w, (0, 0, 0, 0))) for w in range(1, order + 1)), tuple(frequent.tolist()))


class Files:
    """A model's files as this process has them mapped."""

    #: Files that are mapped at once; a process may not map any number.
    MOST = 1 << 14 if _UNTRACKED else 1 << 12

    def __init__(self, model: NgramModel) -> None:
        if not os.path.exists(f"{model.folder}/{MARK}"):
            raise FileNotFoundError(f"{model.folder}: the model isn't visible here; spark.checkpoint.dir must be mounted where tasks run")
        self.model, self.open, self.frequent = model, {}, np.array(model.frequent, np.uint64)

    def part(self, name: str, n: int) -> list[np.ndarray] | None:
        """The arrays of a bucket, None if nothing fell there."""
        if name not in self.open:
            if len(self.open) >= self.MOST:
                self.open.clear()
            self.open[name] = _load(f"{self.model.folder}/{name}", n)
        return self.open[name]

    def _find(self, folder: str, bucket: np.ndarray, h: np.ndarray, first: int, n: int, n_arrays: int) -> list[np.ndarray]:
        """n columns of each hash, 0 where it isn't there; first: which array of the file they begin with."""
        out = [np.zeros(len(h), dtype=np.int64) for _ in range(n)]
        if not len(h):
            return out
        order = _by_bucket(bucket)
        bucket = bucket[order]
        cut, pieces = _firsts(bucket), []
        for a, b, k in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], bucket[cut].tolist(), strict=True):
            arrays = self.part(f"{folder}/{k:08d}", n_arrays)
            pieces.append((a, b, _NOTHING[n] if arrays is None else arrays[first : first + _N_ARRAYS[n]]))
        for c, found in zip(out, _in_files(pieces, h[order], n), strict=True):
            c[order] = found
        return out

    def plain(self, words: np.ndarray) -> np.ndarray:
        rows = words.reshape(-1, 1)
        return self._find("plain", places(rows, self.frequent, self.model.buckets)[0], ngram_hash(rows), 0, 1, _N_ARRAYS[1])[0]

    def counts(self, rows: np.ndarray) -> np.ndarray:
        return self._find(f"{rows.shape[1]}", places(rows, self.frequent, self.model.buckets)[0], ngram_hash(rows), 0, 1, sum(_N_ARRAYS.values()))[0]

    def contexts(self, rows: np.ndarray) -> list[np.ndarray]:
        """Total, ones, twos and all of each context."""
        width, h = rows.shape[1] + 1, ngram_hash(rows)
        key, split = context_keys(rows, self.frequent)
        out = [np.zeros(len(rows), dtype=np.int64) for _ in range(4)]
        for which, key, folder, first, n_arrays in ((~split, key, f"{width}", _N_ARRAYS[1], sum(_N_ARRAYS.values())), (split, h, f"{width}split", 0, _N_ARRAYS[4])):
            own = np.flatnonzero(which)
            for c, found in zip(out, self._find(folder, _range_of(key[own], self.model.buckets), h[own], first, 4, n_arrays), strict=True):
                c[own] = found
        return out


_models: dict[str, Files] = {}


def _files(model: NgramModel) -> Files:
    if model.folder not in _models:
        _models.clear()
        _models[model.folder] = Files(model)
    return _models[model.folder]


def log10_probabilities(model: NgramModel, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log10 probability and the plain count of each token that isn't a begin mark, in order; tokens: with order - 1 begin marks before each text.

    Each distinct n-gram of the tokens is looked up once."""
    files, n = _files(model), model.order
    inside = np.ones(len(tokens), dtype=bool)
    for j in range(n - 1):
        inside[at[:-1] + j] = False
    ends = np.flatnonzero(inside)
    words, code = _coded(tokens)
    # number of the (width - 1)-gram that ends at each token; these n-grams and their probabilities
    grams, rows, p = np.zeros(len(tokens), np.int64), np.zeros((1, 0), np.uint64), np.full(1, 1 / (model.types + 1))
    for width in range(1, n + 1):
        d = np.array([0.0, *model.discounts[width - 1]])
        total, ones, twos, every = files.contexts(rows)
        left = d[1] * ones + d[2] * twos + d[3] * (every - ones - twos)
        if width == 1:
            number, first = code, np.empty(len(words), np.int64)
            first[code] = np.arange(len(code))
        else:
            key = code.copy()
            key[1:] += grams[:-1] * len(words)
            by, ordered = _sorted(key.view(np.uint64), (len(rows) * len(words)).bit_length())
            new = _firsts(ordered)
            first, number = by[new], np.empty(len(by), np.int64)
            number[by] = np.repeat(np.arange(len(new)), np.diff(new, append=len(by)))
        context, shorter = grams[np.maximum(first - 1, 0)], p[grams[first]]
        rows, grams = np.stack([tokens[np.maximum(first - width + 1 + j, 0)] for j in range(width)], axis=1), number
        c, total = files.counts(rows), total[context]
        p = np.where(total > 0, (np.maximum(c - d[np.minimum(c, 3)], 0) + left[context] * shorter) / np.maximum(total, 1), shorter)
        if width == 1:
            plain = files.plain(rows)
    return np.log10(p)[grams[ends]], plain[code[ends]]


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"
_scores = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(batches: Iterator[pa.RecordBatch], model: NgramModel) -> Iterator[pa.RecordBatch]:
    try:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1), SCORED_BYTES):
                tokens, at = _tokens(data, offsets, model.order - 1)
                logs, c = log10_probabilities(model, tokens, at)
                begin = at - (model.order - 1) * np.arange(len(at))  # in the tokens without begin marks
                base = np.log10((c + 0.5) / (model.train_tokens + 0.5 * (model.types + 1)))
                sums = [np.add.reduceat(x, begin[:-1]) for x in ((c > 0).astype(np.int64), base, logs)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(np.diff(begin)), *map(pa.array, sums)], schema=_scores)
    finally:
        _models.clear()  # a worker that lives on keeps no files mapped


def score(docs: DataFrame, model: NgramModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score, sums of log10 probabilities, of each row. Perplexity is 10 ** (-score / n_tokens)."""
    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    return rows.mapInArrow(lambda it: _score(it, model), SCORES)


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds, F.lit(0).cast("long"))


def held_out_scores(docs: DataFrame, order: int = 3, folds: int = 5, held_out: int = 1, **fitting) -> DataFrame:
    """Scores of every row under a model of those outside the held-out fold; fitting: parameters of fit."""
    out = fold("doc_id", folds) == held_out
    model = fit(docs.filter(~out), order=order, **fitting)
    return score(docs, model).withColumns({"held_out": out, "train_tokens": F.lit(model.train_tokens).cast("long")}).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
