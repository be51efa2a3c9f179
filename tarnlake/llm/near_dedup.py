"""N-gram Jaccard join with token-combination prefixes, and the groups that its links form.

A text's set is its distinct k-word shingles (here: tokens). Two texts link when shared tokens are at least the threshold's share of all their tokens. The join is exact on
64-bit shingle hashes:

1. Texts with equal sets collapse to one representative, so that copies cost one row each whatever their number.
2. All representatives' tokens are counted; a token in up to `rare_most` of them is rare, others are frequent. Tokens order rare before frequent, then by hash.
3. Of a set of n tokens at most p = n - ceil(t n) can be missing from a linked set. Prefixes are extended to p + c tokens, c = 1 + n / 10, so that of linked sets each has c tokens of its prefix in the
   other, and both prefixes share the smaller c. A set with fewer than c tokens in its prefix that occur elsewhere links with nothing; this leaves out sets that meet others by chance.
4. Rare tokens of the prefix are indexed singly. A set whose prefix reaches into the frequent class indexes combinations of frequent tokens as well: the prefix is extended over all of them,
   which are dealt by hash to m classes, and the tokens in one class form one combination. If linked sets share fewer rare tokens than they must, both reach into the frequent class, whose tokens
   differ in at most d; m > d classes leave a class that is alike in both. d and m follow from ranges of set sizes, and each set takes part in its range and the next, so that linked sets
   always meet in one. A set with so few non-empty classes that none need be alike indexes its prefix's frequent tokens singly; linked sets do so both or not at all.
5. Sets that share an index entry are candidates. Pairs within an entry are not listed: each entry links its members to a hub, candidates are verified on whole
   sets, and verified links form components. In a last round every pair that shares enough entries and still is in different components is verified, so that no link is lost
   that could join two components: pairs of single entries, which have `rare_most` members at most, from those entries; sets that combined entries connect in tiles, see _family_links.

A text with fewer than k words has its whole sequence as one token; one without words (or null) links with nothing. Repeated rows and rows of the same set are in one group.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.arrays import grouped, hashed_words, mix, shingle_sets, slices, table_of
from tarnlake.llm.components import components
from tarnlake.llm.exchange import ENTRIES, answer, block_of, classed, dealt, entries, entries_schema
from tarnlake.llm.staging import parts, rows_that_stay, staged, text_bytes

#: A token in more representatives than this is frequent.
RARE_MOST = 16
#: Bytes of text in a block and of messages in a bucket, about.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 24 << 20


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([mix(tokens).sum(dtype=np.uint64), mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)], dtype=">u8").tobytes()


_summary = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("text_sha", pa.string())])


def _summaries(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1)):
            sets = list(shingle_sets(*hashed_words(data, offsets), k))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), batch.column(2).slice(a, b - a)], schema=_summary)


def _sets(k: int, texts: pa.Table, nodes: pa.Table) -> tuple[list[bytes], list[np.ndarray]]:
    """The block's representatives and their sets. nodes: id and node of those that have their least id in the block; other texts are left out."""
    wanted: dict[tuple, bool] = {}
    for ident, node in zip(nodes.column("id").to_pylist(), nodes.column("node").to_pylist(), strict=True):
        if node is not None:
            wanted[ident, node] = True
    names, sets, ids = [], [], texts.column("id").to_pylist()
    for a, _, data, offsets in slices(texts.column("text")):
        for i, tokens in enumerate(shingle_sets(*hashed_words(data, offsets), k)):
            if len(tokens) and wanted.pop((ids[a + i], node := set_key(tokens)), False):
                names.append(node)
                sets.append(tokens)
    return names, sets


def _sending(k: int, buckets: int):
    def run(texts: pa.Table, nodes: pa.Table) -> pa.Table:
        if not texts.num_rows or not nodes.num_rows:
            return table_of([], entries_schema)
        _, sets = _sets(k, texts, nodes)
        keys, counts = np.unique(dealt(np.concatenate(sets), buckets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return entries(texts.column("block")[0].as_py(), keys, counts)

    return run


class Signer:
    """Index entries of sets under a threshold num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.lows = num, den, [1]

    def size_range(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.lows.append(self.lows[-1] * self.den // self.num + 1)
        return bisect_right(self.lows, n) - 1

    def missing(self, n: int) -> int:
        """p: the most tokens of n that a linked set can lack."""
        return n - -(-self.num * n // self.den)

    def least_shared(self, n: int) -> int:
        """c: the tokens that prefixes are extended by, less one; as many of its prefix a set shares with a linked one."""
        return 1 + n // 10

    def entries(self, tokens: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single and combined entries. tokens: sorted hashes; classes: 0 in this set only, 1 rare, 2 frequent."""
        least = self.least_shared(len(tokens))
        prefix = self.missing(len(tokens)) + least
        rare = np.flatnonzero(classes < 2)[:prefix]
        single = tokens[rare[classes[rare] == 1]]
        if len(single) + min(prefix - len(rare), int((classes == 2).sum())) < least:
            return single[:0].view(np.int64), single[:0].view(np.int64)
        out = [single[:0]]
        if len(rare) < prefix:
            frequent = tokens[classes == 2]
            own = self.size_range(len(tokens))
            short = False
            for q in (own, own + 1):
                self.size_range(self.lows[-1])  # extends the table by one range
                while len(self.lows) < q + 2:
                    self.size_range(self.lows[-1])
                d = (self.den - self.num) * (self.lows[q + 1] - 1) // self.num
                m = d + d // 4 + 2
                to = mix(frequent ^ np.uint64(q)) % np.uint64(m)
                order = np.argsort(to, kind="stable")
                to, dealt_out = to[order], mix(frequent)[order]
                new = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
                if len(new):
                    out.append(mix(np.add.reduceat(dealt_out, new) ^ mix(to[new] + np.uint64(q << 32))))
                short |= len(new) <= d
            if short:
                out.append(mix(frequent[: prefix - len(rare)] ^ np.uint64(0x5BD1E995)))
        return np.unique(mix(single)).view(np.int64), np.unique(np.concatenate(out)).view(np.int64)


_signed = pa.schema([("node", pa.binary()), ("n", pa.int64()), ("singles", pa.list_(pa.int64())), ("combined", pa.list_(pa.int64())), ("tokens", pa.binary())])
SIGNED = "node binary, n long, singles array<long>, combined array<long>, tokens binary"


def _signing(k: int, buckets: int, num: int, den: int):
    def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
        """notes: the block's representatives and the answers to its message."""
        if not texts.num_rows or not notes.num_rows:
            return table_of([], _signed)
        nodes, sets = _sets(k, texts, notes)
        if not sets:
            return table_of([], _signed)
        every = dealt(np.concatenate(sets), buckets)
        keys = np.unique(every)
        classes = answer(keys, notes.filter(pc.is_valid(notes.column("classes"))))[np.searchsorted(keys, every)]
        signer, out, a = Signer(num, den), [], 0
        for node, tokens in zip(nodes, sets, strict=True):
            single, combined = signer.entries(tokens, classes[a : a + len(tokens)])
            a += len(tokens)
            if len(single) or len(combined):
                out.append((node, len(tokens), single, combined, tokens.astype("<u8").tobytes()))
        return table_of(out, _signed)

    return run


_linked = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            keep.append(den * both >= num * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_linked).filter(pa.array(keep, pa.bool_()))


def _near_size(num: int, den: int) -> Column:
    return F.least("n", "other_n") * den >= F.greatest("n", "other_n") * num


def verified(pairs: DataFrame, signed: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones of pairs (a, b)."""
    sets = signed.select("node", "tokens")
    whole = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return whole.select("a", "b", "x", "y").mapInArrow(lambda it: _verify(it, num, den), "a binary, b binary")


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _labelled(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """rows with each node's component so far."""
    return rows.withColumn("component", F.col("node")) if found is None else rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _to_hubs(own: DataFrame, turn: int) -> DataFrame:
    """Each entry's members with its hub, another one each turn, where their components differ."""
    hubs = own.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(F.struct("node", "n", "component"), F.xxhash64("node", F.lit(turn))).alias("hub")).filter("low <> high")
    hubs = hubs.select("entry", F.col("hub.node").alias("other"), F.col("hub.n").alias("other_n"), F.col("hub.component").alias("other_component"))
    return own.join(hubs, "entry").filter(F.col("component") != F.col("other_component"))


def _sharing_singles(own: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of different components that share as many single entries as they must. A single entry has at most rare_most members."""
    a = own.filter("not combined").select("entry", "node", "n", "component")
    b = a.select("entry", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("component").alias("other_component"))
    near = a.join(b, "entry").filter((F.col("node") < F.col("other")) & (F.col("component") != F.col("other_component")) & _near_size(num, den))
    must = F.min(1 + F.floor(F.least("n", "other_n") / 10))
    return near.groupBy(F.col("node").alias("a"), F.col("other").alias("b")).agg(F.count(F.lit(1)).alias("shared"), must.alias("must")).filter("shared >= must").select("a", "b")


#: Sets of a family that are held against as many others at once.
TILE = 256


def _tile_links(num: int, den: int, table: pa.Table) -> pa.Table:
    """Links that join components between a tile's left and right side; as few as connect them."""
    left = np.array(table.column("is_left").to_pylist(), dtype=bool)
    nodes, component = table.column("node").to_pylist(), table.column("component").to_pylist()
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("tokens")]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    value, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    several = np.bincount(at)[at] > 1
    row, at = row[several], np.unique(at[several], return_inverse=True)[1] if several.any() else at[:0]
    i, j = np.flatnonzero(left), np.flatnonzero(~left) if (~left).any() else np.flatnonzero(left)
    both = np.zeros((len(i), len(j)), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        own = slice(*np.searchsorted(at, [start, start + 4096]))
        dense = np.zeros((len(sets), 4096), dtype=np.float32)
        dense[row[own], at[own] - start] = 1
        both += dense[i] @ dense[j].T
    linked = np.argwhere(den * both >= num * (size[i][:, None] + size[j][None, :] - both))
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := parent.get(x, x)) != x:
            x = y
        return x

    out = []
    for x, y in linked.tolist():
        a, b = root(component[i[x]]), root(component[j[y]])
        if a != b:
            parent[a] = b
            out.append((nodes[i[x]], nodes[j[y]]))
    return table_of(out, _linked)


def _family_links(own: DataFrame, signed: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components of sets that share a combined entry.

    Sets that such entries connect are a family, however long an entry's list is. Within a family the members outside its largest component are held against each other and against that component in
    tiles: a set is copied once per tile, never once per pair, and only links leave a tile."""
    combined = own.filter("combined").select("entry", "node", "component")
    hubs = combined.groupBy("entry").agg(F.min("node").alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
    families = components(combined.join(hubs, "entry").select(F.col("node").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct()).withColumnRenamed("component", "family")
    members = combined.select("node", "component").distinct().join(families, "node")
    sizes = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("c"))
    whole = sizes.groupBy("family").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("in_main"), (F.sum("c") - F.max("c")).alias("outside")).filter("outside > 0")
    placed = members.join(whole, "family").withColumns({"is_main": F.col("component") == F.col("main"), "tiles_in": F.ceil(F.col("in_main") / TILE).cast("int"), "tiles_out": F.ceil(F.col("outside") / TILE).cast("int")})
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("tiles_in")).otherwise(F.col("tiles_out"))).cast("int"))
    # outside tiles are the left side of all pairs with main tiles (numbered from tiles_out) and with later outside tiles
    last = F.col("tiles_in") + F.col("tiles_out") - 1
    as_left = F.transform(F.sequence(F.col("tile"), last), lambda t: F.struct(F.col("tile").alias("left"), t.alias("right"), F.lit(True).alias("is_left")))
    as_right_out = F.filter(F.transform(F.sequence(F.lit(0), F.col("tile")), lambda t: F.struct(t.alias("left"), F.col("tile").alias("right"), F.lit(False).alias("is_left"))), lambda k: k["left"] < k["right"])
    as_right_main = F.transform(F.sequence(F.lit(0), F.col("tiles_out") - 1), lambda t: F.struct(t.alias("left"), (F.col("tile") + F.col("tiles_out")).alias("right"), F.lit(False).alias("is_left")))
    keys = F.when(F.col("is_main"), as_right_main).otherwise(F.concat(as_left, as_right_out))
    dealt_out = placed.select("family", "node", "component", F.inline(keys))
    with_sets = dealt_out.join(signed.select("node", "tokens"), "node")
    return with_sets.groupBy("family", "left", "right").applyInArrow(grouped(_tile_links, num, den), "a binary, b binary")


def linked_components(signed: DataFrame, num: int, den: int, rounds: int = 2) -> DataFrame:
    """node and component of the representatives that have a link. signed: node, n, singles, combined, tokens."""
    spark = signed.sparkSession
    kinds = F.transform("singles", lambda e: F.struct(e.alias("entry"), F.lit(False).alias("combined"))), F.transform("combined", lambda e: F.struct(e.alias("entry"), F.lit(True).alias("combined")))
    rows = signed.select("node", "n", F.inline(F.concat(*kinds)))
    shared = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("entry")
    rows = staged(rows.join(shared, "entry"), "index")
    links = spark.createDataFrame([], "a binary, b binary")
    found = None
    for turn in range(rounds + 1):
        own = _labelled(rows, found)
        if turn < rounds:
            pairs = _pairs(_to_hubs(own, turn).filter(_near_size(num, den)))
            new = verified(staged(pairs, "candidates"), signed, num, den)
        else:
            new = verified(staged(_sharing_singles(own, num, den), "candidates"), signed, num, den).unionByName(_family_links(own, signed, num, den))
        new = staged(new, "links", narrow=True)
        if not new.isEmpty():
            links = links.unionByName(new)
            found = staged(components(links), "components", narrow=True)
    return found if found is not None else spark.createDataFrame([], "node binary, component binary")


def _grouped_rows(docs: DataFrame, k: int, threshold: tuple[int, int], rare_most: int, id_column: str, text_column: str) -> DataFrame:
    """id, n_shingles, text_sha, component (null without words) and component_id of each row of docs."""
    num, den = threshold
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = staged(texts.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).mapInArrow(lambda it: _summaries(it, k), "id long, n_shingles long, node binary, text_sha string"), "sets")
    nodes = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("id").alias("least_id"))
    total = text_bytes(texts, "text")
    blocks, buckets = parts(total, BLOCK_BYTES), parts(total, BUCKET_BYTES)
    texts = texts.select(block_of("id", blocks).alias("block"), "id", "text")
    chosen = nodes.select(block_of("least_id", blocks).alias("block"), F.col("least_id").alias("id"), "node")
    sent = texts.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(_sending(k, buckets), ENTRIES)
    notes = chosen.withColumns({"bucket": F.lit(None).cast("int"), "classes": F.lit(None).cast("binary")}).unionByName(classed(sent, (1, rare_most)).withColumns({"id": F.lit(None).cast("long"), "node": F.lit(None).cast("binary")}))
    signed = staged(texts.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(_signing(k, buckets, num, den), SIGNED), "signed")
    found = linked_components(signed, num, den)
    grouped_nodes = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = grouped_nodes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_node = grouped_nodes.join(ids, "component").select("node", "component", "component_id")
    return rows.join(by_node, "node", "left")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), rare_most: int = RARE_MOST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that links lead to, of each row of docs. threshold: links have 100 * shared >= 80 * all, and so on."""
    out = _grouped_rows(docs, k, threshold, rare_most, id_column, text_column)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with just one row of each group, the one with the smallest id (null last), then text hash, and all rows without words; ids may repeat or be null."""
    rows = staged(_grouped_rows(docs, k, threshold, RARE_MOST, "doc_id", "text").filter("n_shingles > 0").select("id", "text_sha", "component"), "groups")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_sha")
    rows = rows.join(rows.groupBy("component").agg(F.min(place).alias("first")), "component").select("id", "text_sha", (place == F.col("first")).alias("stays"))
    return rows_that_stay(docs, {"id": F.col("doc_id").cast("long"), "text_sha": F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)}, rows)
