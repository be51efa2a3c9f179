"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Tokenising is per row in Arrow tasks. Packing needs only how many pieces there are of each length, at most `capacity` numbers whatever the
corpus size: equal lengths are interchangeable. Bins of equal content are one pattern with a count, so the local search works on patterns. It starts from bins
that each hold pieces of one length, as many as fit, and makes the packing by moving and exchanging pieces between underfull bins; on
10,000 documents of the test data these start as 6324 sequences and end as 4937, where their tokens need 4936. What is left underfull is then packed anew, with some full bins, by best fit and searched again.

The plan gives each length's pieces, in rank order, their sequences and places; ranks come from a salted,
distributed count, so that a length that a third of all pieces share is ranked by many tasks. Pieces meet the plan by length and block of ranks, an ordinary join.

Null texts are empty: just the end id. Repeated rows, also of one id, are documents of their own; which of equal pieces gets which place isn't defined. An empty table gives an empty
result. A long text needs memory for its own ids. Other columns aren't read.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.staging import staged

CAPACITY = 2048
#: Parts that the pieces of one length are ranked in.
SALTS = 64
#: Ranks of a length that meet the plan together.
RANKS = 4096


class PieceTokenizer:
    """Ids of byte-level BPE, the same as the tokenizers library gives: whole texts go through tiktoken, over the merge ranks of the same tokenizer file.

    Words aren't remembered: where most of a text's words are new, the memory cost more time than it saved, and space for each worker.

    added_tokens: tokens that the file adds, such as the end of a text, are one id where they occur in a text, as in the library's default setting; else they are text."""

    def __init__(self, path: str, added_tokens: bool = False) -> None:
        import tiktoken
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: only byte-level BPE without normaliser or prefix space is read here")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        assert set(pre_tokenizers.ByteLevel.alphabet()) == set(to_byte)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if added_tokens and any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: only added tokens that match as they are, anywhere, are read here")
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        import public_tokenizers

        self.encode = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = {token: np.array([i], dtype="<u4").tobytes() for token, i in special.items()} if added_tokens else {}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _ids(self, text: str) -> bytes:
        return np.array(array("I", self.encode(text)), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.at_added and self.at_added.search(text):
            return b"".join(self.added[part] if nth % 2 else self._ids(part) for nth, part in enumerate(self.at_added.split(text)))
        return self._ids(text)


_tokenizers: dict[str, PieceTokenizer] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool, short_first: bool = False) -> Iterator[pa.RecordBatch]:

    encode = _tokenizers.get(path) or _tokenizers.setdefault(path, PieceTokenizer(path, added_tokens=True))
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = PIECE_SCHEMA.append(pa.field("ids", pa.binary())) if with_ids else PIECE_SCHEMA
    for batch in batches:
        out: list[tuple] = []
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py() or "") + end
            n = len(ids) // 4
            cuts = [0, *range((n % capacity if short_first else 0) or capacity, n, capacity), n]
            for piece, (start, stop) in enumerate(itertools.pairwise(cuts)):
                own = ids[4 * start : 4 * stop]
                out.append((ident, piece, start, len(own) // 4, zlib.crc32(own), *([own] if with_ids else [])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, short_first: bool = False) -> DataFrame:
    """Each document's ids and the end id in pieces of `capacity`, the last one, or with short_first the first one, with the rest; with_ids adds the ids themselves."""
    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    return rows.mapInArrow(lambda it: _pieces(it, tokenizer_path, capacity, end_id, with_ids, short_first), PIECES + ", ids binary" * with_ids)


Pattern = tuple[int, ...]


def best_fit_patterns(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing over lengths with counts: bins that fill alike are one pattern with a count.

    For each length, longest first, pieces go to the fullest bins that still take them; bins with equal room and content fill together."""
    open_bins: dict[int, Counter[Pattern]] = defaultdict(Counter)  # room left: patterns
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in open_bins or not open_bins[room]:
            insort(rooms, room)
        open_bins[room][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and (i := bisect_left(rooms, length)) < len(rooms):
            room = rooms[i]
            pattern, n = next(iter(open_bins[room].items()))
            # a bin that takes one piece and still is the fullest that takes another gets more at once
            used = min(n, left)
            del open_bins[room][pattern]
            if not open_bins[room]:
                rooms.pop(i)
            if n > used:
                put(room, pattern, n - used)
            put(room - length, (*pattern, length), used)
            left -= used
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                put(capacity - each * length, (length,) * each, full)
            if rest:
                put(capacity - rest * length, (length,) * rest, 1)
    return Counter({p: n for by in open_bins.values() for p, n in by.items() if n})


def _removable(pattern: Pattern) -> set[int]:
    """What a bin can give back at once: nothing, one piece or two."""
    many = Counter(pattern)
    sizes = sorted(many)
    return {0, *sizes, *(2 * y for y in sizes if many[y] > 1), *(y + z for i, y in enumerate(sizes) for z in sizes[i + 1 :])}


def _taken(pattern: Pattern, total: int) -> Pattern:
    """The fewest pieces of the pattern, two at most, that sum to total."""
    if not total:
        return ()
    many = Counter(pattern)
    if total in many:
        return (total,)
    return next((y, total - y) for y in many if (many[total - y] > 1 if total == 2 * y else many[total - y]))


class _Underfull:
    """Patterns with room. For each sum that they can give back and each limit, top has the largest fill up to it at which one can (else -1); capacity squared numbers."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.count = capacity, Counter()
        self.top = np.full((capacity + 1, capacity + 1), -1, dtype=np.int16 if capacity < 1 << 15 else np.int32)
        self.at: dict[tuple[int, int], dict[Pattern, None]] = defaultdict(dict)

    def add(self, pattern: Pattern, n: int) -> None:
        fill = sum(pattern)
        if pattern not in self.count:
            for back in _removable(pattern):
                if not self.at[back, fill]:
                    row = self.top[back, fill:]
                    np.maximum(row, fill, out=row)
                self.at[back, fill][pattern] = None
        self.count[pattern] += n
        if not self.count[pattern]:
            del self.count[pattern]
            for back in _removable(pattern):
                own = self.at[back, fill]
                del own[pattern]
                if not own:
                    del self.at[back, fill]
                    row = self.top[back, fill:]
                    row[row == fill] = self.top[back, fill - 1]

    def best(self, a: Pattern) -> tuple[int, Pattern, int] | None:
        """(piece of a, pattern that takes it, sum that comes back) with the largest gain in squared fill."""
        fill, found, most = sum(a), None, 0
        flat = self.top.reshape(-1)
        for x in sorted(set(a), reverse=True):
            if x * (self.capacity - fill) <= most:
                break  # even a bin that it fills to the brim gains no more
            to = flat[self.capacity - x :: self.capacity + 2][:x].astype(np.int64)  # fullest that x fits into, by what comes back
            d = x - np.arange(x)
            gains = np.where(to >= 0, d * (to - fill + d), 0)  # half of each gain
            while gains[back := int(gains.argmax())] > most:
                b = next((p for p in self.at[back, int(to[back])] if p != a or self.count[a] > 1), None)
                if b is not None:
                    found, most = (x, b, back), int(gains[back])
                    break
                to[back] = self.top[back, to[back] - 1]  # that was only the bin itself
                gains[back] = d[back] * (to[back] - fill + d[back]) if to[back] >= 0 else 0
        return found


def improve(patterns: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """Swap-based local search over all underfull bins, raising the sum of squared fills until no move does or bins are as few as their tokens need.

    The emptiest bins are dissolved first: a piece moves to a bin with room, or changes place with one or two shorter ones. Bins of one pattern are alike, so a move between
    two patterns is made for as many pairs of their bins as there are, and the work depends on the number of patterns. A bin that loses all pieces is gone."""
    done: Counter[Pattern] = Counter()
    loose = _Underfull(capacity)

    def put(pattern: Pattern, n: int) -> None:
        if sum(pattern) == capacity:
            done[pattern] += n
        elif pattern:
            loose.add(pattern, n)

    for p, n in patterns.items():
        put(tuple(sorted(p, reverse=True)), n)
    bins, tokens = sum(loose.count.values()), sum(sum(p) * n for p, n in loose.count.items())
    moved = True
    while moved:
        moved = False
        for start in sorted(loose.count, key=lambda p: (sum(p), p)):
            todo = [start]
            while todo and bins > -(-tokens // capacity):
                a = todo[-1]
                move = loose.best(a) if a in loose.count else None
                if move is None:
                    todo.pop()
                    continue
                x, b, back = move
                n = loose.count[a] // 2 if a == b else min(loose.count[a], loose.count[b])
                came = _taken(b, back)
                after_a = tuple(sorted((Counter(a) - Counter((x,)) + Counter(came)).elements(), reverse=True))
                after_b = tuple(sorted((Counter(b) - Counter(came) + Counter((x,))).elements(), reverse=True))
                loose.add(a, -n)
                loose.add(b, -n)
                put(after_a, n)
                put(after_b, n)
                moved = True
                if not after_a:
                    bins -= n
                if sum(after_b) == capacity:
                    bins, tokens = bins - n, tokens - n * capacity
                todo.append(after_a)
    return done + loose.count


def alike_patterns(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Bins of one length each, as many pieces as fit."""
    out: Counter[Pattern] = Counter()
    for length, n in counts.items():
        each = capacity // length
        out[(length,) * each] += n // each
        out[(length,) * (n % each)] += 1
    return Counter({p: n for p, n in out.items() if p and n})


def packed(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Bins of all pieces: local search from bins of one length each; then what is in underfull bins and in a share of the full ones is packed anew by best fit and searched again, with
    larger shares, up to all, as long as bins are more than their tokens need."""
    bins = improve(alike_patterns(counts, capacity), capacity)
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    for share in (8, 2, 1):
        if sum(bins.values()) <= least:
            break
        again, loose = Counter(), Counter()
        for p, n in bins.items():
            some = n if sum(p) < capacity else -(-n // share)
            again[p] = n - some
            for x in p:
                loose[x] += some
        again.update(improve(best_fit_patterns(loose, capacity), capacity))
        if sum(again.values()) < sum(bins.values()):
            bins = Counter({p: n for p, n in again.items() if n})
    return bins


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, first sequence, offset): the r-th piece of a length, from <= r < to, is in sequence first + r - from."""
    ranks, out, base = dict.fromkeys(counts, 0), [], 0
    for pattern, n in sorted(packed(counts, capacity).items()):
        for length, offset in zip(pattern, itertools.accumulate(pattern, initial=0), strict=False):
            out.append((length, ranks[length], ranks[length] + n, base, offset))
            ranks[length] += n
        base += n
    assert ranks == counts
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. An empty table gives an empty result; repeated rows are pieces of their own."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    by_salt = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    sizes: dict[int, dict[int, int]] = defaultdict(dict)  # at most capacity * SALTS numbers, whatever the input
    for r in by_salt.collect():
        sizes[r["length"]][r["salt"]] = r["n"]
    before = [(length, salt, sum(by[s] for s in by if s < salt)) for length, by in sizes.items() for salt in by]
    slots = plan({length: sum(by.values()) for length, by in sizes.items()}, capacity)
    ranked = salted.join(F.broadcast(spark.createDataFrame(before, "length long, salt int, before long")), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / RANKS))
    slot_rows = spark.createDataFrame(slots, "length long, low long, high long, first long, offset long")
    slot_rows = slot_rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / RANKS), F.floor((F.col("high") - 1) / RANKS))))
    placed = ranked.join(slot_rows, ["length", "block"]).filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("low")).drop("salt", "before", "rank", "block", "low", "high", "first")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, short_first: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of docs.

    A null text is empty: just the end id. A document of over `capacity` ids is cut into full pieces and a last, or with short_first a first, shorter one; full pieces are sequences of their own."""
    pieces = staged(token_pieces(docs, tokenizer_path, capacity, end_id, short_first=short_first), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
