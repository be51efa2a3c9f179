"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

1. Statistics of each whole text: lengths, shares of kinds of characters, repetition.
2. A random forest is fitted to labelled rows; each path from a root to a node is a rule, a conjunction of bounds on statistics.
3. Lasso logistic regression weighs the rules; most get no weight.
4. Rules with weight compile into one Spark column expression, which scores every row.

The fit uses a sample of labelled rows of at most `most_labels` (a documented bound, chosen by hash of the id); scores are for every row.
Labels, language, source and id are never inputs. A null text is empty and its statistics are 0. Labels that repeat an id count once, with the smallest label;
null labels don't count. With labels of one kind only, that kind is every row's score; without labels the score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.arrays import hash_words, slices, word_spans
from tarnlake.llm.staging import quoted, staged, unused

MOST_LABELS = 20_000

STATISTICS = (
    "n_words", "n_bytes", "n_lines", "mean_word", "longest_word", "distinct_words", "repeated_words", "top_word", "distinct_lines",
    "upper", "digits", "symbols", "pipes", "bangs", "stops", "non_ascii", "ends_in_symbol", "short_words",
)

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#$%&*+<=>@\\^_`{}~/[]", "pipes": b"|", "bangs": b"!?", "stops": b".", "lines": b"\n"}
_IS = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()} | {"non_ascii": np.arange(256) >= 128}


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text of the buffer."""
    n = len(offsets) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    starts, ends, first = word_spans(data, offsets)
    words = hash_words(data, starts, ends)
    lengths = ends - starts
    n_words, n_bytes = np.diff(first).astype(float), np.diff(offsets).astype(float)
    of_words = lambda mask: (lambda s: (s[first[1:]] - s[first[:-1]]).astype(float))(np.concatenate([[0], np.cumsum(mask)]))
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][first[:-1] < len(words)]] = False
    over = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    count = {k: per_row(mask[data]) for k, mask in _IS.items()}
    distinct, top, longest, lines = np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n)
    for i in np.flatnonzero(n_words):
        own = np.sort(words[first[i] : first[i + 1]])
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        distinct[i], top[i], longest[i] = len(edges) - 1, np.diff(edges).max(), lengths[first[i] : first[i + 1]].max()
        if count["lines"][i]:
            rows = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
            lines[i] = len(set(rows)) / len(rows)
    by = {
        "n_words": n_words, "n_bytes": n_bytes, "n_lines": count["lines"] + (n_bytes > 0), "mean_word": over(of_words(lengths), n_words), "longest_word": longest,
        "distinct_words": over(distinct, n_words), "repeated_words": over(of_words(same), n_words), "top_word": over(top, n_words), "distinct_lines": np.where(n_words > 0, lines, 0),
        "ends_in_symbol": over(of_words(_IS["symbols"][last] | _IS["bangs"][last]), n_words), "short_words": over(of_words(lengths <= 2), n_words),
    } | {k: over(count[k], n_bytes) for k in ("upper", "digits", "symbols", "pipes", "bangs", "stops", "non_ascii")}
    return np.stack([by[k] for k in STATISTICS], axis=1)


def with_statistics(docs: DataFrame, text_column: str = "text", name: str = "__statistics", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all of them, if None) and a struct of the text's statistics."""
    keep = docs.columns if keep is None else keep
    fields = ", ".join(f"{s}: double" for s in STATISTICS)
    shape = docs.select(*[F.col(quoted(c)) for c in keep], F.lit(None).cast(f"struct<{fields}>").alias(name)).schema
    at = docs.columns.index(text_column)
    kept = [docs.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(at).cast(pa.string()).fill_null("")):
                found = statistics(data, offsets)
                struct = pa.StructArray.from_arrays([pa.array(found[:, j]) for j in range(len(STATISTICS))], list(STATISTICS))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(a, b - a) for j in kept), struct], names=[*keep, name])

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, shape)


Rule = tuple[tuple[str, str, float], ...]


@dataclass(frozen=True)
class RuleModel:
    """intercept and weighted rules; constant: the score of every row where nothing could be fitted."""

    intercept: float
    rules: tuple[tuple[float, Rule], ...]
    constant: float | None = None

    def score(self, statistics_column: str) -> Column:
        """The compiled ensemble as one column expression, 0 to 1."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        z = F.lit(self.intercept)
        for weight, rule in self.rules:
            z = z + F.when(holds(rule, statistics_column), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def holds(rule: Rule, statistics_column: str) -> Column:
    out = F.lit(True)
    for name, sign, bound in rule:
        value = F.col(f"{statistics_column}.{name}")
        out = out & (value <= bound if sign == "<=" else value > bound)
    return out


def tree_rules(debug: str) -> set[Rule]:
    """Every root-to-node path of a tree's text form, with just the tightest bounds of each statistic."""
    found, path = set(), []
    for line in debug.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, STATISTICS[int(m[3])], m[4], float(m[5]))]
        tight: dict[tuple[str, str], float] = {}
        for _, name, sign, bound in path:
            tight[name, sign] = (min if sign == "<=" else max)(bound, tight.get((name, sign), bound))
        found.add(tuple(sorted((name, sign, bound) for (name, sign), bound in tight.items())))
    return found


def fit_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", most_labels: int = MOST_LABELS, trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """A model of the labelled rows of docs; see the module's text."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    chosen = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(label_column).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(id_column), id_column).limit(most_labels).select(F.col(id_column).alias("__id"), "label")
    rows = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text")).join(F.broadcast(chosen), "__id").dropDuplicates(["__id"])  # most_labels rows at most
    shown = with_statistics(rows, "__text", keep=["label"])
    vector = array_to_vector(F.array(*[F.col(f"__statistics.{s}") for s in STATISTICS]))
    train = staged(shown.select("label", "__statistics").coalesce(4), "quality-sample").withColumn("features", vector).persist()
    kinds = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(kinds) < 2:
        train.unpersist()
        return RuleModel(0.0, (), constant=next(iter(kinds), 0.5))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.8, minInstancesPerNode=5).fit(train)
    rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in forest.trees)))
    if not rules:
        train.unpersist()
        return RuleModel(0.0, (), constant=kinds.get(1.0, 0) / sum(kinds.values()))
    hits = train.select("label", array_to_vector(F.array(*[holds(r, "__statistics").cast("double") for r in rules])).alias("features")).persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(hits)
    for df in (hits, train):
        df.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), tuple((float(w), r) for w, r in zip(weights, rules, strict=True) if w))


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds, F.lit(0).cast("long"))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, at_least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of the held-out fold are not learnt from."""
    model = fit_rules(docs, labels.filter(fold("doc_id", folds) != held_out))
    shown = with_statistics(docs.select("doc_id", "text"), keep=["doc_id"])
    return shown.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), model.score("__statistics").alias("score")).withColumn("predicted", (F.col("score") >= at_least).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, at_least: float = 0.7, folds: int = 4, held_out: int = 2) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with the same columns."""
    model = fit_rules(docs, labels.filter(fold("doc_id", folds) != held_out))
    name = unused(docs, "statistics")
    return with_statistics(docs, name=name).filter(model.score(name) >= at_least).drop(name)
