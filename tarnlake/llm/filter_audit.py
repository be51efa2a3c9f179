"""Filter interaction audit: what each filter of a chain removes, in every order of the filters, by contractions of contingency tensors.

One scan forms a document's failures of the filters that look at its own text, and its text's SHA-256. Copies are found by that digest on narrow rows, pre-aggregated by
(digest, part, failures, labels), so that a text of a third of all rows is a few rows. Per part the counts of the 32 combinations of pass (0) and fail (1) are a 2x2x2x2x2
tensor, one each for all, good and toxic documents. Each step of each order is a selector of pass, fail or all along each axis, and einsum contracts the tensors of a part with all selectors at
once. Shapley sums are over the orders of the same numbers.

Defined cases: null texts count as empty (A and, having no words, not B); null parts are the part "". A null id is no smaller and no larger than any, so such a row never fails E and
makes no other fail it. Rows of one id and one text fail E together or pass together. A document is good or toxic if any row of labels for its id says so; labels without a document count nowhere.
Very long texts are split into words as one array. Ties don't occur: results are counts. Other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.staging import quoted

#: The axes of a tensor, in order.
FILTERS = "ABCDE"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> list[Column]:
    """Failures of A to D as expressions over a text that isn't null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.length(text)
    capitals = n - F.length(F.translate(text, CAPITALS, ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 3 * n, text.rlike(r"[#$%&*|]")]


def code_of(failures: list[Column]) -> Column:
    """Failures as one number, the first one its highest bit: the place in a flattened tensor."""
    code = F.lit(0)
    for f in failures:
        code = code * 2 + f.cast("int")
    return code


def coded(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """(part, code, n, good, toxic): documents by part and combination of failures."""
    text = F.coalesce(F.col(quoted(text_column)), F.lit(""))
    seen = docs.select(F.col(quoted(id_column)).alias("id"), F.coalesce(F.col(quoted(part_column)).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    seen = seen.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), code_of(text_failures(F.col("text"))).alias("own"))
    seen = seen.groupBy("id", "digest", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    # A null id has no label: its key is the digest, which is no number, so that such rows spread.
    seen = seen.withColumn("key", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.hex("digest"))))
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = seen.join(said, "key", "left").select("id", "digest", "part", "own", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # Of each (digest, part, labels): all rows, the smallest id and how many rows have it, and those without an id.
    groups = rows.groupBy("digest", "part", "own", "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", F.when(F.col("id").isNotNull(), F.col("id"))).alias("at_first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = F.min("first").over(Window.partitionBy("digest"))
    groups = groups.withColumn("passing", F.col("unnamed") + F.when(F.col("first") == least, F.col("at_first")).otherwise(0))
    both = groups.select("part", "good", "toxic", F.explode(F.array(F.struct((F.col("own") * 2).alias("code"), F.col("passing").alias("n")), F.struct((F.col("own") * 2 + 1).alias("code"), (F.col("n") - F.col("passing")).alias("n")))).alias("x"))
    n = F.col("x.n")
    return both.filter(n > 0).groupBy("part", F.col("x.code").alias("code")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def selectors(filters: str = FILTERS) -> tuple[list[str], dict[str, np.ndarray]]:
    """All orders, and for each quantity the selectors (orders x steps, axes, 2) of its documents."""
    orders = ["".join(p) for p in permutations(filters)]
    kinds: dict[str, list] = {"kept": [], "removed": [], "failing": [], "unique_fails": []}
    for order in orders:
        for step in range(len(filters)):
            earlier, own = set(order[:step]), order[step]
            kinds["kept"].append([PASS if f in earlier or f == own else ALL for f in filters])
            kinds["removed"].append([FAIL if f == own else PASS if f in earlier else ALL for f in filters])
            kinds["failing"].append([FAIL if f == own else ALL for f in filters])
            kinds["unique_fails"].append([FAIL if f == own else PASS for f in filters])
    return orders, {k: np.array(v, dtype=np.int64) for k, v in kinds.items()}


def contracted(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """tensors (m, 2, 2, 2, 2, 2) and selectors (s, 5, 2): the counts (m, s) that each selector picks. Integers throughout."""
    return np.einsum("mabcde,sa,sb,sc,sd,se->ms", tensors, *chosen.transpose(1, 0, 2), optimize=True)


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step; see the module's text."""
    counts = coded(docs, labels, id_column, text_column, part_column)
    per = counts.groupBy("part").agg(F.collect_list(F.struct("code", "n", "good", "toxic")).alias("cells"))  # 32 cells at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, chosen = selectors()
        of = {order[step]: [] for order in orders[:1] for step in range(len(order))}
        places = [(o, s) for o in range(len(orders)) for s in range(len(FILTERS))]
        for at, (o, s) in enumerate(places):
            of[orders[o][s]].append(at)
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = np.zeros((3, 2 ** len(FILTERS)), dtype=np.int64)
                for cell in cells:
                    flat[:, cell["code"]] = cell["n"], cell["good"], cell["toxic"]
                tensors = flat.reshape(3, *[2] * len(FILTERS))
                removed, good, toxic = contracted(tensors, chosen["removed"])
                kept, failing, unique = (contracted(tensors[:1], chosen[k])[0] for k in ("kept", "failing", "unique_fails"))
                shapley = np.zeros_like(removed)
                for own in of.values():
                    shapley[own] = removed[own].sum()
                columns = [kept, removed, failing - removed, unique, good, toxic, shapley]
                names = [part] * len(places)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([orders[o] for o, _ in places], pa.string()), pa.array([s + 1 for _, s in places], pa.int32()), *[pa.array(c, pa.int64()) for c in columns]], names=["part", "filter_order", "step", *COUNTS])

    return per.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
