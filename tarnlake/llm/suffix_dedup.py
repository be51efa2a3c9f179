"""Repeated substrings by enhanced suffix arrays, and their removal from all documents but the first.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Strings are judged on the input; matches never cross documents.

Spark deals the suffixes out so that equal strings meet and unique ones never travel:

1. Every start of a `length`-byte string belongs to the smallest k-gram hash in that string (its minimiser). Successive starts with one minimiser are a
   segment; equal strings have equal minimisers wherever they are. Documents are in blocks, and a packed exchange (see exchange.py) tells each block which of its minimisers
   another document has too, and which have many different segments.
2. Segments of shared minimisers go, once per block and content with the smallest id, to the bucket of their minimiser. A passage that a third of all documents
   share thus arrives once per block.
3. A minimiser with many different segments, such as a short phrase that a third of all documents have with other text around it, isn't one group: its strings are dealt singly by their own
   hash, and of those only the ones that a second exchange finds in another document travel.
4. A bucket collapses equal segments. Where a minimiser has several different ones it builds an enhanced suffix array over them (sorted suffixes, common prefix lengths),
   scans the prefix lengths with a stack for the interval tree, and keeps the intervals whose occurrences have different bytes on their left: the maximal repeats, each
   with all its occurrences. Every occurrence learns the smallest document of its group. Strings inside a maximal repeat occur exactly where it does, or belong to a group of their own.
5. The answers return to the blocks by the segments' places there, and the blocks remove bytes.

Hashes only decide what meets: equality is always of bytes. Memory follows block and bucket sizes, whatever the length of a text beyond its own bytes.

Null texts are empty, and an empty table gives an empty result. Ids that repeat are one document to the comparison, each row of which is treated alike, repeated rows too; null ids come after
all others. Other columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.arrays import BASE, BYTE_VALUE, grouped, hash_words, mix, table_of, text_buffer
from tarnlake.llm.exchange import ANSWERS, ENTRIES, answer, answers_schema, block_of, bucket_cuts, classed, dealt, entries, entries_schema
from tarnlake.llm.staging import parts, text_bytes

LENGTH, GRAM = 50, 24
#: Starts in a segment at most; longer ones (of periodic text) are cut.
MOST_STARTS = 64
BLOCK_BYTES, BUCKET_BYTES, MESSAGE_BYTES = 4 << 20, 16 << 20, 1 << 20
#: Bytes that are hashed at once.
CHUNK = 1 << 17
#: A minimiser with more different segments in a block, or more different marks of segments over all blocks, has its strings dealt singly.
MOST_DIFFERENT = 64
#: In a message's lengths: a single string of such a minimiser.
SINGLE = 1 << 15
LAST = np.iinfo(np.int64).max


# ---------------------------------------------------------------- enhanced suffix array


def suffix_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[start:end] and the common prefix length of each with the one before it (the first has 0)."""
    n = len(starts)
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    words = padded[: len(data) + 8]
    for shift in (1, 2, 4):  # big-endian words of 8 bytes at every byte
        words = (words[: len(words) - shift] << np.uint64(8 * shift)) | words[shift:]
    rest = ends - starts

    def word(which: np.ndarray, j: int) -> np.ndarray:
        left = rest[which] - 8 * j
        at = np.minimum(starts[which] + 8 * j, len(words) - 1)
        cut = (8 * (8 - np.clip(left, 0, 8))).astype(np.uint64)
        return np.where(left <= 0, np.uint64(0), (words[at] >> np.minimum(cut, np.uint64(63))) << np.minimum(cut, np.uint64(63)))

    order = np.arange(n)
    group = np.zeros(n, dtype=np.int64)  # of the suffix at each place of order; equal so far
    places = np.arange(n)  # of order, where suffixes are still tied
    most = -(-int(rest.max()) // 8) if n else 0
    for j in range(most):
        if not len(places):
            break
        w = word(order[places], j)
        by = np.lexsort((w, group[places]))
        order[places] = order[places][by]
        w, g = w[by], group[places]
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (g[1:] != g[:-1])])
        group[places] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        tied = np.zeros(len(places), dtype=bool)
        tied[1:] = ~new[1:]
        tied[:-1] |= ~new[1:]
        places = places[tied]
    if len(places):
        by = np.lexsort((rest[order[places]], group[places]))
        order[places] = order[places][by]
    prefix = np.zeros(n, dtype=np.int64)
    live = np.arange(1, n)
    for j in range(most):
        if not len(live):
            break
        differ = word(order[live], j) ^ word(order[live - 1], j)
        same = differ == 0
        prefix[live] += np.where(same, 8, 0)
        odd, x = live[~same], differ[~same]
        lead = np.zeros(len(x), dtype=np.int64)  # equal bytes at the front
        for b in range(7):
            lead += (x >> np.uint64(56 - 8 * b)) == 0
        prefix[odd] += lead
        live = live[same]
    prefix[1:] = np.minimum(prefix[1:], np.minimum(rest[order[1:]], rest[order[:-1]]))
    return order, prefix


def interval_tree(prefix: np.ndarray, low: int, high: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan of places low..high: (length, first place, last place) of every interval with a common prefix of `least` or more, children before parents."""
    stack: list[tuple[int, int]] = []
    values = prefix[low + 1 : high + 1].tolist()
    for at, value in enumerate([*values, 0], low + 1):
        left = at - 1
        while stack and stack[-1][0] > value:
            length, left = stack.pop()
            yield length, left, at - 1
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, left))


def maximal_repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, suffixes) of each maximal repeat of `least` bytes or more: all suffixes that begin with it, of which at least two have different bytes on their left.

    left: the byte before each suffix, or a negative number of its own where its text begins."""
    order, prefix = suffix_array(data, starts, ends)
    joined = np.flatnonzero(prefix >= least)
    if not len(joined):
        return
    before = left[order]
    change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])  # so far, places whose left byte isn't the one before's
    cut = np.flatnonzero(np.concatenate([[True], np.diff(joined) > 1]))
    lows, highs = joined[cut] - 1, joined[np.concatenate([cut[1:] - 1, [len(joined) - 1]])]
    diverse = change[highs] > change[lows]  # else whatever they share is part of a longer repeat
    for low, high in zip(lows[diverse].tolist(), highs[diverse].tolist(), strict=True):
        if high == low + 1:
            yield int(prefix[high]), order[low : high + 1]
            continue
        for length, a, b in interval_tree(prefix, low, high, least):
            if change[b] > change[a]:
                yield length, order[a : b + 1]


# ---------------------------------------------------------------- segments


def minimisers(data: np.ndarray, length: int, k: int) -> np.ndarray:
    """The smallest k-gram hash of each `length`-byte string of data, by its start."""
    # k-gram hashes by doubling
    h, size, grams, got = BYTE_VALUE[data], 1, None, 0
    power = BASE
    left = k
    while left:
        if left & 1:
            if grams is None:
                grams, got = h, size
            else:
                m = len(data) - (got + size) + 1
                grams = grams[:m] * power + h[got : got + m]
                got += size
        left >>= 1
        if left:
            m = len(h) - size
            h = h[:m] * power + h[size : size + m]
            power = np.uint64(int(power) ** 2 % 2**64)
            size *= 2
    window, size, span = mix(grams), 1, length - k + 1
    while 2 * size <= span:
        window = np.minimum(window[: len(window) - size], window[size:])
        size *= 2
    if size < span:
        window = np.minimum(window[: len(window) - (span - size)], window[span - size :])
    return window


def segments(data: np.ndarray, offsets: np.ndarray, length: int, k: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, starts, minimiser, content hash) of each segment of the rows of a buffer, in order. Chunks cut segments, so that a long text needs no more memory than others."""
    found = []
    for a in range(0, len(data) - length + 1, chunk):
        b = min(a + chunk, len(data) - length + 1)
        part = data[a : b + length - 1]
        # rows whose starts are in this chunk
        x, y = np.searchsorted(offsets, [a, b - 1], side="right") - 1
        edges = np.clip(offsets[x : y + 2], a, b)
        begin, end = edges[:-1] - a, np.minimum(edges[1:], np.maximum(offsets[x + 1 : y + 2] - length + 1, edges[:-1])) - a
        inside = spread(begin, end - begin)
        if not len(inside):
            continue
        value, row = minimisers(part, length, k)[inside], np.repeat(np.arange(x, y + 1), end - begin)
        first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])]))
        count = np.diff(np.concatenate([first, [len(value)]]))
        pieces = -(-count // MOST_STARTS)
        if pieces.max() > 1:
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = np.repeat(first, pieces) + nth * MOST_STARTS
            count = np.minimum(np.repeat(count, pieces) - nth * MOST_STARTS, MOST_STARTS)
        start = inside[first]
        found.append((row[first], start + a, count, mix(value[first]), hash_words(part, start, start + count + length - 1)))
    none = np.zeros(0, np.int64)
    # minima are small numbers; mixed, they deal out evenly
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (none, none, none, none.astype(np.uint64), none.astype(np.uint64))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... up to sizes[i] numbers, for each i in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[a[i] : a[i] + sizes[i]] equals data[b[i] : b[i] + sizes[i]]; no size is 0."""
    ends = np.cumsum(sizes)
    out = np.zeros(len(sizes), dtype=bool)
    for x, y in _runs(ends - sizes, CHUNK):
        out[x:y] = np.logical_and.reduceat(data[spread(a[x:y], sizes[x:y])] == data[spread(b[x:y], sizes[x:y])], ends[x:y] - sizes[x:y] - (ends[x] - sizes[x]))
    return out


def equal_contents(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each segment the one of equal bytes with the smallest document."""
    order = np.lexsort((docs, sizes, hashes))
    h, n = hashes[order], sizes[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (n[1:] != n[:-1])])) if len(order) else np.zeros(0, np.int64)
    first = np.empty(len(order), dtype=np.int64)
    first[order] = order[np.repeat(new, np.diff(np.concatenate([new, [len(order)]])))] if len(order) else order
    others = np.flatnonzero(first != np.arange(len(first)))
    unlike = others[~same_bytes(data, starts[others], starts[first[others]], sizes[others])]
    if len(unlike):  # one hash, several contents
        seen: dict[bytes, int] = {}
        for i in unlike[np.argsort(docs[unlike], kind="stable")].tolist():
            first[i] = seen.setdefault(data[starts[i] : starts[i] + sizes[i]].tobytes(), i)
    return first


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Bytes, offsets, ids for comparison and ids of a block's texts, in an order that doesn't depend on how they came."""
    table = table.sort_by([("id", "ascending"), ("text", "ascending")])
    shown = table.column("id").to_pylist()
    return *text_buffer(table.column("text")), np.array([LAST if v is None else v for v in shown], dtype=np.int64), shown


_sent = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("different", pa.binary()), ("marks", pa.binary())])
SENT = "block int, bucket int, keys binary, docs binary, different binary, marks binary"


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _send(length: int, k: int, buckets: int, table: pa.Table) -> pa.Table:
    """A block's minimisers, for each bucket: in how many documents each is, how many different segments it has (255: that or more), and a mark of one of them."""
    data, offsets, ids, _ = _block(table)
    block = table.column("block")[0].as_py()
    row, _, _, value, content = segments(data, offsets, length, k)
    key, docs = dealt(value, buckets), ids[row]
    order = np.lexsort((docs, key))
    at = _firsts(key[order], docs[order])
    unique, in_docs = np.unique(key[order][at], return_counts=True)
    # which of its segments gives the mark is up to the block, so that no segment stands for others everywhere
    drawn = mix(content ^ mix(np.full(1, block, np.uint64)))
    order = np.lexsort((drawn, key))
    at = _firsts(key[order], drawn[order])
    different = np.unique(key[order][at], return_counts=True)[1]
    mark = content[order][_firsts(key[order])].astype(np.uint8)
    few = [np.minimum(x, 255).astype(np.uint8) for x in (in_docs, different)] + [mark]
    low = (unique & np.uint64(0xFFFFFFFF)).astype("<u4")
    return table_of([(block, bucket, *(x[a:b].tobytes() for x in (low, *few))) for bucket, a, b in bucket_cuts(unique)], _sent)


def _kinds(table: pa.Table) -> pa.Table:
    """Of each key: 0 in one document, 1 in several, 2 in several with many different segments."""
    keys, docs, different, marks = ([np.frombuffer(x.as_buffer(), t) for x in table.column(c)] for c, t in (("keys", "<u4"), ("docs", "u1"), ("different", "u1"), ("marks", "u1")))
    ends = np.cumsum([len(x) for x in keys])
    every, docs, different, marks = map(np.concatenate, (keys, docs, different, marks))
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    new = _firsts(ordered)
    size = np.diff(np.concatenate([new, [len(ordered)]]))
    kinds = (np.add.reduceat(docs[order].astype(np.int64), new) > 1).astype(np.uint8)
    kinds[np.maximum.reduceat(different[order], new) > MOST_DIFFERENT] *= 2
    for i in np.flatnonzero((size > MOST_DIFFERENT) & (kinds == 1)).tolist():
        if np.count_nonzero(np.bincount(marks[order[new[i] : new[i] + size[i]]], minlength=256)) > MOST_DIFFERENT:
            kinds[i] = 2
    out = np.empty(len(every), dtype=np.uint8)
    out[order] = np.repeat(kinds, size)
    return table_of([(b, p, out[e - n : e].tobytes()) for b, p, n, e in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), map(len, keys), ends.tolist(), strict=True)], answers_schema)


def _single_starts(data: np.ndarray, start: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, hash) of every string of these segments."""
    which, at = np.repeat(np.arange(len(start)), count), spread(start, count)
    hashes = [hash_words(part := data[at[a] : at[b - 1] + length], at[a:b] - at[a], at[a:b] - at[a] + length) for a, b in _runs(at, CHUNK)]
    return which, at, np.concatenate([np.zeros(0, np.uint64), *hashes])


def _runs(at: np.ndarray, most: int):
    """Ranges of increasing positions that span at most `most`."""
    a = 0
    while a < len(at):
        b = int(np.searchsorted(at, at[a] + most, side="left"))
        yield a, max(b, a + 1)
        a = max(b, a + 1)


def _sending_starts(length: int, k: int, buckets: int):
    def run(texts: pa.Table, kinds: pa.Table) -> pa.Table:
        """The block's strings of minimisers with many different segments."""
        if not texts.num_rows or not any(b"\2" in x.as_py() for x in kinds.column("classes")):
            return table_of([], entries_schema)
        data, offsets, ids, _ = _block(texts)
        row, start, count, value, _ = segments(data, offsets, length, k)
        key = dealt(value, buckets)
        unique = np.unique(key)
        many = np.flatnonzero(answer(unique, kinds)[np.searchsorted(unique, key)] == 2)
        which, _, h = _single_starts(data, start[many], count[many], length)
        key, docs = dealt(h, buckets), ids[row[many]][which]
        order = np.lexsort((docs, key))
        at = _firsts(key[order], docs[order])
        return entries(texts.column("block")[0].as_py(), *np.unique(key[order][at], return_counts=True))

    return run


_message = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("lengths", pa.binary()), ("places", pa.binary()), ("docs", pa.binary()), ("data", pa.binary())])
MESSAGES = "block int, bucket int, keys binary, lengths binary, places binary, docs binary, data binary"


def _sending_segments(length: int, k: int, buckets: int, message_buckets: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """answers: of the block's minimisers (single: false) and of its single strings (single: true)."""
        if not texts.num_rows or not answers.num_rows:
            return table_of([], _message)
        data, offsets, ids, _ = _block(texts)
        row, start, count, value, content = segments(data, offsets, length, k)
        key = dealt(value, buckets)
        unique = np.unique(key)
        kind = answer(unique, answers.filter(pc.invert(answers.column("single"))))[np.searchsorted(unique, key)]
        own, many = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        # places are starts; a block has fewer than 2 ** 32 bytes
        found = [(value[own], content[own], start[own], count[own], ids[row[own]])]
        if len(many):
            which, at, h = _single_starts(data, start[many], count[many], length)
            key = dealt(h, buckets)
            unique = np.unique(key)
            shared = answer(unique, answers.filter(answers.column("single")))[np.searchsorted(unique, key)] > 0
            found.append((h[shared], h[shared], at[shared], np.ones(shared.sum(), np.int64), ids[row[many]][which[shared]]))
        single = np.repeat(np.array([0, SINGLE], "<u2")[: len(found)], [len(f[0]) for f in found])
        value, content, start, count, doc = map(np.concatenate, zip(*found, strict=True))
        size = count + length - 1
        first = np.flatnonzero(equal_contents(data, start, size.astype(np.int64), content ^ mix(single.astype(np.uint64)), doc) == np.arange(len(start)))
        key = dealt(value[first], message_buckets)
        order = np.argsort(key, kind="stable")
        first, key = first[order], key[order]
        low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
        out, block = [], texts.column("block")[0].as_py()
        for bucket, a, b in bucket_cuts(key):
            i = first[a:b]
            out.append((block, bucket, low[a:b].tobytes(), (size[i].astype("<u2") | single[i]).tobytes(), start[i].astype("<u4").tobytes(), doc[i].tobytes(), pa.compress(data[spread(start[i], size[i])].tobytes(), "zstd", asbytes=True)))
        return table_of(out, _message)

    return run


_reply = pa.schema([("block", pa.int32()), ("places", pa.binary()), ("lengths", pa.binary()), ("runs", pa.binary()), ("starts", pa.binary()), ("firsts", pa.binary())])
REPLIES = "block int, places binary, lengths binary, runs binary, starts binary, firsts binary"


def first_documents(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For every start of every segment, the smallest document in which the string there starts. Segments: data[offsets[i]:offsets[i + 1]], equal ones just once."""
    count = np.diff(offsets) - length + 1
    base = np.cumsum(count) - count
    out = np.repeat(docs, count)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    several = np.zeros(len(keys), dtype=bool)
    several[order[1:][same]] = several[order[:-1][same]] = True
    own = np.flatnonzero(several)
    if not len(own):
        return out
    # only these segments' bytes go on
    size = np.diff(offsets)[own]
    ends = np.cumsum(size)
    data = data[spread(offsets[own], size)]
    n = count[own]
    which = np.repeat(np.arange(len(own)), n)
    nth = spread(np.zeros(len(n), np.int64), n)
    starts = (ends - size)[which] + nth
    left = np.where(nth > 0, data[np.maximum(starts - 1, 0)].astype(np.int64), -1 - np.arange(len(starts)))
    segment = own[which]
    place = base[segment] + nth
    for repeat, members in maximal_repeats(data, starts, ends[which], left, length):
        least = docs[segment[members]].min()
        for p in place[members].tolist():
            span = out[p : p + repeat - length + 1]
            np.minimum(span, least, out=span)
    return out


def _bucket(length: int, table: pa.Table) -> pa.Table:
    keys, sizes, docs = ([np.frombuffer(x.as_buffer(), t) for x in table.column(c)] for c, t in (("keys", "<u4"), ("lengths", "<u2"), ("docs", "<i8")))
    data = np.frombuffer(b"".join(pa.decompress(x.as_py(), int((n & (SINGLE - 1)).sum()), "zstd", asbytes=True) for x, n in zip(table.column("data"), sizes, strict=True)), np.uint8)
    of_message, size, key, doc = [len(x) for x in keys], (np.concatenate(sizes) & (SINGLE - 1)).astype(np.int64), np.concatenate(keys), np.concatenate(docs)
    start = np.cumsum(size) - size
    content = np.concatenate([hash_words(data[start[a] : start[b - 1] + size[b - 1]], start[a:b] - start[a], start[a:b] - start[a] + size[a:b]) for a, b in _runs(start, CHUNK)])
    first = equal_contents(data, start, size, content, doc)
    one, which = np.unique(first, return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(size[one])])
    found = first_documents(data[spread(start[one], size[one])], offsets, key[one], doc[one], length)
    # successive starts of a segment with one first document are a run
    count = size[one] - length + 1
    base = np.cumsum(count) - count
    new = np.ones(len(found), dtype=bool)
    new[1:] = found[1:] != found[:-1]
    new[base] = True
    at = np.flatnonzero(new)
    runs = np.add.reduceat(new.astype(np.int64), base)
    run_base, run_starts, run_firsts = np.cumsum(runs) - runs, np.diff(np.concatenate([at, [len(found)]])), found[at]
    out, a = [], 0
    for block, n, places, lengths in zip(table.column("block").to_pylist(), of_message, table.column("places").to_pylist(), table.column("lengths").to_pylist(), strict=True):
        w = which[a : a + n]
        rows = spread(run_base[w], runs[w])
        out.append((block, places, lengths, runs[w].astype(np.uint8).tobytes(), run_starts[rows].astype(np.uint8).tobytes(), run_firsts[rows].tobytes()))
        a += n
    return table_of(out, _reply)


_result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"


def _replied(replies: pa.Table) -> tuple[np.ndarray, ...]:
    """Place, bytes, first run and runs of each segment that was answered, and the runs' starts and first documents."""
    columns = [np.concatenate([np.zeros(0, t), *(np.frombuffer(x.as_buffer(), t) for x in replies.column(c))]) for c, t in (("places", "<u4"), ("lengths", "<u2"), ("runs", "u1"), ("starts", "u1"), ("firsts", "<i8"))]
    place, size, runs, starts = (x.astype(np.int64) for x in columns[:4])
    return place, size, np.cumsum(runs) - runs, runs, starts, columns[4]


def _mark(gone: np.ndarray, data: np.ndarray, ids: np.ndarray, replied: tuple, which: np.ndarray, found: tuple, length: int) -> None:
    """Counts in gone where removed strings begin and end. found: (row, first start, starts, content hash) of segments, in order; those with the bytes of one that was answered (which) get its answer."""
    place, _, first_run, runs, run_starts, run_firsts = replied
    row, start, count, content = found
    total = count + length - 1
    own = np.searchsorted(start, place[which])
    order = np.argsort(content[own], kind="stable")
    own, run_at, run_n = own[order], first_run[which][order], runs[which][order]
    at, last = np.searchsorted(content[own], content), np.searchsorted(content[own], content, side="right")
    left = np.flatnonzero(at < last)
    while len(left):  # more than once only where different contents have one hash
        to = own[at[left]]
        same = total[to] == total[left]
        same[same] = same_bytes(data, start[to[same]], start[left[same]], total[left[same]])
        hit = left[same]
        n = run_n[at[hit]]
        r = spread(run_at[at[hit]], n)
        before = np.cumsum(run_starts[r]) - run_starts[r]
        p = np.repeat(start[hit], n) + before - np.repeat(before[np.cumsum(n) - n], n)
        earlier = run_firsts[r] < np.repeat(ids[row[hit]], n)
        np.add.at(gone, p[earlier], 1)
        np.add.at(gone, (p + run_starts[r] + length - 1)[earlier], -1)
        left = left[~same]
        at[left] += 1
        left = left[at[left] < last[left]]


def _removing(length: int, k: int):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return table_of([], _result)
        data, offsets, ids, shown = _block(texts)
        gone = np.zeros(len(data) + 1, dtype=np.int32)
        if replies.num_rows:
            row, start, count, value, content = segments(data, offsets, length, k)
            replied = _replied(replies)
            single = replied[1] & SINGLE > 0
            _mark(gone, data, ids, replied, ~single, (row, start, count, content), length)
            if single.any():  # all strings of minimisers that were dealt so
                own = np.searchsorted(start, replied[0][single], side="right") - 1
                many = np.flatnonzero(np.isin(value, value[own]))
                which, at, h = _single_starts(data, start[many], count[many], length)
                _mark(gone, data, ids, replied, single, (row[many][which], at, np.ones(len(at), np.int64), h), length)
        removed, out = np.cumsum(gone[:-1]) > 0, []
        for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            mask = removed[x:y]
            if not mask.any():
                out.append((shown[i], y - x, 0, 0, hashlib.sha256(data[x:y].tobytes()).hexdigest(), []))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).reshape(-1, 2)
            out.append((shown[i], y - x, int(mask.sum()), len(edges), hashlib.sha256(data[x:y][~mask].tobytes()).hexdigest(), edges.tolist()))
        return table_of(out, _result)

    return run


def removed_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans ([from, to) in bytes, in order) of each row of docs."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    total = text_bytes(texts, "text")
    blocks, buckets = parts(total, BLOCK_BYTES), parts(total, BUCKET_BYTES)
    texts = texts.select(block_of("id", blocks).alias("block"), "id", "text")
    by_block = texts.groupBy("block")
    kinds = by_block.applyInArrow(grouped(_send, length, gram, buckets), SENT).groupBy("bucket").applyInArrow(_kinds, ANSWERS)
    singles = classed(by_block.cogroup(kinds.groupBy("block")).applyInArrow(_sending_starts(length, gram, buckets), ENTRIES), (1,))
    answers = kinds.withColumn("single", F.lit(False)).unionByName(singles.withColumn("single", F.lit(True)))
    messages = by_block.cogroup(answers.groupBy("block")).applyInArrow(_sending_segments(length, gram, buckets, parts(total, MESSAGE_BYTES)), MESSAGES)
    replies = messages.groupBy("bucket").applyInArrow(grouped(_bucket, length), REPLIES)
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(_removing(length, gram), RESULT)
