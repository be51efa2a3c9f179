"""Exact deduplication by Grace hashing.

Two passes, both with bounded memory:

1. Within each input partition, equal texts collapse: a run of rows shares an open-addressing table that compares
   complete content, and is closed when the table's content reaches a byte limit. One row per distinct content and run carries the
   text on; every row remembers that leader. A group of copies that holds a third of all rows
   therefore sends at most one text per run into the shuffle, and no key needs salting.
2. Leaders are dealt by content hash. Each task partitions what it gets to spill files, again and again with another slice of the
   hash, until a bucket fits an open-addressing table, which compares complete content; a class gets its best row.

A last join brings each class back to its rows by leader, whose groups are no longer than a run.

Equality ignores every character of [\\x20\\x09-\\x0D]; null text equals empty text. Of equal texts the one with the most code points in
the original, then the smallest id, stays; of repeated rows with one id, just one row stays. A null id sorts last. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.arrays import SPACE_BYTES
from tarnlake.llm.staging import rows_that_stay, staged

#: Content bytes that one open-addressing table may hold.
TABLE_BYTES = 48 << 20
#: Spill files that a bucket is dealt to at each level.
FANOUT = 16


class ContentTable:
    """Open addressing with linear probing. A slot holds an entry's index; equality compares the complete content, never only its hash."""

    def __init__(self) -> None:
        self.slots, self.hashes, self.contents, self.bytes = [-1] * 1024, [], [], 0

    def place(self, digest: int, content: bytes) -> tuple[int, bool]:
        """The entry of this content, and whether it is new."""
        mask = len(self.slots) - 1
        at = digest & mask
        while (i := self.slots[at]) >= 0:
            if self.hashes[i] == digest and self.contents[i] == content:
                return i, False
            at = (at + 1) & mask
        self.slots[at] = len(self.contents)
        self.hashes.append(digest)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return len(self.contents) - 1, True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for i, digest in enumerate(self.hashes):
            at = digest & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def _key(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=False)


ROWS = "row_key string, id long, n_code_points long, leader string, sha string, content binary, best_points long, best_id long, best_row string, size long"
ROW_SCHEMA = pa.schema([("row_key", pa.string()), ("id", pa.int64()), ("n_code_points", pa.int64()), ("leader", pa.string()), ("sha", pa.string()), ("content", pa.binary()), ("best_points", pa.int64()), ("best_id", pa.int64()), ("best_row", pa.string()), ("size", pa.int64())])


def _better(points: int, ident: int | None, row: str, than: tuple) -> bool:
    """More code points, then the smaller id (null last), then the row key."""
    return (-points, ident is None, ident or 0, row) < (-than[0], than[1] is None, than[1] or 0, than[2])


def _collapse(batches: Iterator[pa.RecordBatch], table_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in runs; the leader's row carries content, the run's best row and the run's count."""
    from pyspark import TaskContext

    part, row = TaskContext.get().partitionId(), 0
    table, rows, best, sizes = ContentTable(), [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal table, rows, best, sizes
        leader_of: list = [None] * len(sizes)
        out: list = []
        held = 0
        for key, ident, points, entry, sha in rows:
            if leader_of[entry] is None:
                leader_of[entry] = key
                out.append((key, ident, points, key, sha, table.contents[entry], *best[entry], sizes[entry]))
                held += len(table.contents[entry])
            else:
                out.append((key, ident, points, leader_of[entry], sha, None, None, None, None, None))
            if len(out) == 4096 or held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), ROW_SCHEMA, strict=True)], schema=ROW_SCHEMA)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), ROW_SCHEMA, strict=True)], schema=ROW_SCHEMA)
        table, rows, best, sizes = ContentTable(), [], [], []

    for batch in batches:
        for ident, points, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            content = (text.as_py() or b"").translate(None, SPACE_BYTES)
            digest = hashlib.sha256(content)
            entry, new = table.place(_key(digest.digest()), content)
            key = f"{part}-{row}"
            row += 1
            if new:
                best.append((points, ident, key))
                sizes.append(1)
            else:
                sizes[entry] += 1
                if _better(points, ident, key, best[entry]):
                    best[entry] = (points, ident, key)
            rows.append((key, ident, points, entry, digest.hexdigest()))
            if table.bytes >= table_bytes or len(rows) >= 200_000:
                yield from close()
    yield from close()


CLASS_SCHEMA = pa.schema([("leader", pa.string()), ("keep_id", pa.int64()), ("keep_row", pa.string()), ("group_size", pa.int64())])
CLASSES = "leader string, keep_id long, keep_row string, group_size long"


def _grace(batches: Iterator[pa.RecordBatch], table_bytes: int, fanout: int) -> Iterator[pa.RecordBatch]:
    """Classes of one hash partition's leaders. Spill files live in the task's own temporary folder and are gone when it ends."""

    def rows_of(batches):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)

    def rows_in(path: str):
        with open(path, "rb") as f:
            load = pickle.Unpickler(f).load
            while True:
                try:
                    yield load()
                except EOFError:
                    return

    folder = tempfile.mkdtemp(prefix="grace-")

    def solve(rows, level: int, prefix: str):
        """Rows whose distinct content fits one table are classed there; others are dealt to files by the next slice of the hash. Equal content never parts."""
        table, held, files = ContentTable(), [], {}
        for r in rows:
            if files:
                _spill(r, level, files, prefix)
                continue
            entry, _ = table.place(_key(bytes.fromhex(r[1][:16])), r[2])
            held.append((entry, (*r[:2], table.contents[entry], *r[3:])))
            if table.bytes > table_bytes and len(table.contents) > 1 and level < 60:
                for _, h in held:
                    _spill(h, level, files, prefix)
                table, held = ContentTable(), []
        yield from _classes(held)
        for f, _ in files.values():
            f.close()
        for slot, (f, _) in files.items():
            yield from solve(rows_in(f.name), level + 1, f"{prefix}.{slot}")
            os.unlink(f.name)

    def _spill(r, level: int, files: dict, prefix: str) -> None:
        slot = int(r[1][-1 - level : len(r[1]) - level], 16) % fanout if level < 60 else 0
        if slot not in files:
            files[slot] = [open(f"{folder}/b{prefix}.{slot}", "wb"), 0]  # noqa: SIM115
        pickle.dump(r, files[slot][0], protocol=pickle.HIGHEST_PROTOCOL)
        files[slot][1] += len(r[2])

    try:
        out: list = []
        for r in solve(rows_of(batches), 0, ""):
            out.append(r)
            if len(out) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), CLASS_SCHEMA, strict=True)], schema=CLASS_SCHEMA)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), CLASS_SCHEMA, strict=True)], schema=CLASS_SCHEMA)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _classes(held: list[tuple]) -> Iterator[tuple]:
    """For each leader its class's best row and size; held: (entry, row)."""
    best: dict[int, tuple] = {}
    sizes: dict[int, int] = {}
    for entry, (_, _, _, points, ident, row, size) in held:
        sizes[entry] = sizes.get(entry, 0) + size
        if entry not in best or _better(points, ident, row, best[entry]):
            best[entry] = (points, ident, row)
    for entry, r in held:
        yield r[0], best[entry][1], best[entry][2], sizes[entry]


def _points(text_column: str) -> Column:
    return F.coalesce(F.length(text_column), F.lit(0)).cast("long")


def _matched(docs: DataFrame, id_column: str, text_column: str, table_bytes: int, fanout: int) -> DataFrame:
    """exact_duplicates with n_code_points."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), _points(text_column).alias("n"))
    rows = staged(rows.mapInArrow(lambda it: _collapse(it, table_bytes), ROWS), "dedup-runs")
    leaders = rows.filter("content is not null").select("leader", "sha", "content", "best_points", "best_id", "best_row", "size")
    classes = leaders.repartition(F.col("sha")).mapInArrow(lambda it: _grace(it, table_bytes, fanout), CLASSES)
    return (
        rows.select("row_key", "id", "leader", "sha", "n_code_points").join(classes, "leader")
        .select(F.col("id").alias("doc_id"), F.col("keep_id"), "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), "n_code_points")
    )


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. See the module's text for what equals what and which row stays."""
    return _matched(docs, id_column, text_column, table_bytes, fanout).drop("n_code_points")


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with just the row of each group of equal texts that exact_duplicates keeps; ids may repeat or be null."""
    content = F.sha2(F.translate(F.coalesce(F.col(text_column).cast("string"), F.lit("")), " \t\n\v\f\r", ""), 256)
    keys = {"id": F.col(id_column).cast("long"), "sha": content, "points": _points(text_column)}
    rows = _matched(docs, id_column, text_column, TABLE_BYTES, FANOUT)
    return rows_that_stay(docs, keys, rows.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), F.col("n_code_points").alias("points"), F.col("kept").alias("stays")))
