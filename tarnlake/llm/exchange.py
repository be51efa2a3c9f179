"""How many texts have each of the corpus's keys (hashes), told back to the texts, without a row for each key.

Texts are dealt to blocks by id. A block sends its distinct keys, sorted, as one packed row for each bucket, a range of hashes; a key that
all texts share thus arrives once per block. A bucket counts, and answers each block with a class for each of its keys in the same order. Blocks have a bounded size in bytes, and so have
buckets, so that both numbers follow the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.arrays import grouped, table_of

ENTRIES = "block int, bucket int, keys binary, counts binary"
entries_schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERS = "block int, bucket int, classes binary"
answers_schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("classes", pa.binary())])


def block_of(id_column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_column)), F.lit(blocks)).cast("int")


def dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes as keys that sort by bucket: the bucket in the upper half, the hash's lower 32 bits in the lower one."""
    return ((((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def bucket_cuts(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys."""
    if not len(keys):
        return []
    bucket = keys >> np.uint64(32)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cut, [*cut[1:], len(keys)], strict=True)]


def entries(block: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    """A block's message: sorted distinct keys and in how many of its texts each occurs (255: that or more)."""
    low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
    few = np.minimum(counts, 255).astype(np.uint8)
    return table_of([(block, bucket, low[a:b].tobytes(), few[a:b].tobytes()) for bucket, a, b in bucket_cuts(keys)], entries_schema)


def _classes(bounds: tuple[int, ...], table: pa.Table) -> pa.Table:
    keys = [np.frombuffer(x.as_py(), "<u4") for x in table.column("keys")]
    counts = [np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], new)
    classes = np.searchsorted(np.array(bounds), total).astype(np.uint8)
    out = np.empty(len(every), dtype=np.uint8)
    out[order] = np.repeat(classes, np.diff(np.concatenate([new, [len(every)]])))
    ends = np.cumsum([len(k) for k in keys])
    return table_of([(b, p, out[e - len(k) : e].tobytes()) for b, p, k, e in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), keys, ends, strict=True)], answers_schema)


def classed(sent: DataFrame, bounds: tuple[int, ...]) -> DataFrame:
    """Answers to messages: a key's class is how many of the bounds its number of texts exceeds."""
    return sent.groupBy("bucket").applyInArrow(grouped(_classes, bounds), ANSWERS)


def answer(keys: np.ndarray, answers: pa.Table) -> np.ndarray:
    """The classes of a block's sorted distinct keys."""
    by = dict(zip(answers.column("bucket").to_pylist(), answers.column("classes"), strict=True))
    out = np.zeros(len(keys), dtype=np.uint8)
    for bucket, a, b in bucket_cuts(keys):
        out[a:b] = np.frombuffer(by[bucket].as_py(), np.uint8)
    return out
