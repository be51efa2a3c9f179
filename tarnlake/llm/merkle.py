"""Document fingerprints: Merkle trees over sections, paragraphs and pieces of text.

A line is a paragraph; line ends and blank lines belong to the paragraph before them. A section ends at a blank line, before a heading (a line that starts with #) and
after a paragraph whose digest is 0 modulo SECTION, so that long texts without headings have sections too, and an insertion moves no distant border. A paragraph is cut
into pieces where the eight bytes before a place hash to 0 modulo PIECE (a smaller power of two near its start, so that short texts have several pieces), unless one of the three places before
does too: pieces follow content, not places, whether or not there are words. A leaf is the SHA-256 of a piece, a node the SHA-256 of its children's digests, level by level, so roots are equal just for equal texts. The tree of
a text depends on that text alone.

A fingerprint is the tree as a string: `root|section>paragraph=leaf.n leaf.n,paragraph=...;section>...`, digests in hexadecimal, of which the root is whole, a section and a
paragraph have 16 digits and a leaf 8, and n is the leaf's code points. `likeness` and `differing` compare two of them from the root: equal nodes are not entered, and the
leaves of differing branches locate edits.

Neighbours by id meet without a window over the table: range cuts of (id, hash of the text) come from a narrow pass, texts are dealt to the ranges once, and the first text of each
range goes to the range before it as well. A range is a partition of its own, sorted by Spark and read as a stream, so no range is held.

Defined cases: null texts count as empty; the empty text's fingerprint is its root alone, and two empty texts have likeness 1. A single document is its own next. Null ids come first. Documents of one id
follow in the order of a hash of their text, equal rows in any order; each row gives a row. A very long text is worked on as one, with about 200 bytes a leaf. Other columns are not
read, whatever their names; an empty table gives no rows. Rows equal in id and text share a range.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.arrays import SLICE_BYTES, mix
from tarnlake.llm.staging import parts, quoted, text_bytes

#: Mean bytes between places that may cut, a power of two; MASKS has that number less 1 by place in the paragraph: as many bytes as lie before it, at least 8, at most PIECE.
PIECE = 64
MASKS = np.array([min(PIECE, max(8, 1 << max(0, at.bit_length() - 1))) - 1 for at in range(PIECE + 1)], dtype=np.uint64)
#: A paragraph in so many ends a section.
SECTION = 4
#: Bytes of text of a range, and ranges at most: a range is a stream, its size isn't bounded by memory, while the cuts go to all tasks.
RANGE_BYTES, MOST_RANGES = 32 << 20, 20_000


class Node(NamedTuple):
    """A section (children: paragraphs) or a paragraph (children: leaves as they are printed)."""

    digest: str
    chars: int
    children: tuple


class Tree(NamedTuple):
    root: str
    sections: tuple[Node, ...]

    @property
    def chars(self) -> int:
        return sum(s.chars for s in self.sections)


PARAGRAPHS = re.compile(rb"[^\n]*\n+|[^\n]+")


def code_points(text: bytes) -> np.ndarray:
    """The byte at which each code point starts."""
    return np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)


def leaves_of(paragraphs: list[bytes]) -> list[tuple[bytes, Node]]:
    """Digest and node of each paragraph, none empty; all are cut at once."""
    if not paragraphs:
        return []
    whole = b"".join(paragraphs)
    data, lengths = np.frombuffer(whole, np.uint8), np.array([len(p) for p in paragraphs], dtype=np.int64)
    n, begins = len(data), np.cumsum(lengths) - lengths
    before = np.zeros(n + 8, dtype=np.uint64)
    before[8:] = data
    window = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        window = (window << np.uint64(8)) | before[k : k + n]
    at = np.arange(n) - np.repeat(begins, lengths)
    cut = np.concatenate([[False] * 3, ((mix(window) & MASKS[np.minimum(at, PIECE)]) == 0) & (at >= 8)])  # the bytes before a paragraph play no part
    lonely = cut[3:] & ~(cut[2:-1] | cut[1:-2] | cut[:-3])
    point = (data & 0xC0) != 0x80
    piece = lonely & point & (data != 10)
    piece[begins] = True
    starts = np.flatnonzero(piece)
    stops = np.append(starts[1:], n).tolist()
    chars = np.add.reduceat(point.astype(np.int64), starts).tolist()
    edges = np.searchsorted(starts, np.append(begins, n)).tolist()
    starts, sha = starts.tolist(), hashlib.sha256
    raw = [sha(whole[s:e]).digest() for s, e in zip(starts, stops, strict=True)]
    digits = b"".join(raw).hex()
    shown = [f"{digits[64 * i : 64 * i + 8]}.{c}" for i, c in enumerate(chars)]
    out = []
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        digest = sha(b"".join(raw[a:z])).digest()
        out.append((digest, Node(digest.hex()[:16], sum(chars[a:z]), tuple(shown[a:z]))))
    return out


def trees(texts: list[bytes], known: dict[bytes, tuple[bytes, Node]] | None = None) -> list[Tree]:
    """The tree of each text. known: paragraphs that have been cut; it gains the others."""
    known = {} if known is None else known
    split = [PARAGRAPHS.findall(t) for t in texts]
    new = list({p for ps in split for p in ps if p not in known})
    known.update(zip(new, leaves_of(new), strict=True))
    sha, out = hashlib.sha256, []
    for ps in split:
        sections, digests, nodes, inner = [], [], [], []
        for i, p in enumerate(ps):
            digest, node = known[p]
            nodes.append(node)
            inner.append(digest)
            if i + 1 == len(ps) or digest[-1] % SECTION == 0 or p[-2:] == b"\n\n" or ps[i + 1][0] == 35:
                of = sha(b"".join(inner))
                digests.append(of.digest())
                sections.append(Node(of.hexdigest()[:16], sum(x.chars for x in nodes), tuple(nodes)))
                nodes, inner = [], []
        out.append(Tree(sha(b"".join(digests)).hexdigest(), tuple(sections)))
    return out


def written(tree: Tree) -> str:
    """The tree as a fingerprint."""
    return tree.root + "|" + ";".join([s.digest + ">" + ",".join([p.digest + "=" + " ".join(p.children) for p in s.children]) for s in tree.sections])


def _chars(leaf: str) -> int:
    return int(leaf[9:])


def parsed(fingerprint: str) -> Tree:
    """The tree of a fingerprint."""
    root, _, rest = fingerprint.partition("|")
    sections = []
    for s in rest.split(";") if rest else []:
        digest, _, inner = s.partition(">")
        paragraphs = []
        for p in inner.split(","):
            name, _, leaves = p.partition("=")
            of = tuple(leaves.split(" "))
            paragraphs.append(Node(name, sum(map(_chars, of)), of))
        sections.append(Node(digest, sum(p.chars for p in paragraphs), tuple(paragraphs)))
    return Tree(root, tuple(sections))


def _matched(left: list[tuple[int, Node]], right: list[Node]) -> tuple[int, list[tuple[int, Node]], list[Node]]:
    """Code points of nodes that both sides have, each as often as on the side that has fewer; the other nodes."""
    there = Counter([x.digest for x in right])
    spare, common, rest = Counter(), 0, []
    for at, x in left:
        if spare[x.digest] < there[x.digest]:
            spare[x.digest] += 1
            common += x.chars
        else:
            rest.append((at, x))
    other = []
    for x in right:
        if spare[x.digest]:
            spare[x.digest] -= 1
        else:
            other.append(x)
    return common, rest, other


def _paragraphs(sections: list[tuple[int, Node]]) -> list[tuple[int, Node]]:
    out = []
    for at, s in sections:
        for p in s.children:
            out.append((at, p))
            at += p.chars
    return out


def compared(a: Tree, b: Tree, spans: bool = True) -> tuple[float, list[tuple[int, int]]]:
    """(likeness, differing) of two trees; without spans the second is empty."""
    if a.root == b.root:
        return 1.0, []
    total = a.chars + b.chars
    common, left, right = _matched(_paragraphs([(0, Node("", 0, a.sections))]), list(b.sections))
    found, left, right = _matched(_paragraphs(left), [p for s in right for p in s.children])
    common += found
    there = Counter([x for p in right for x in p.children])
    if not spans:
        here = Counter([x for _, p in left for x in p.children])
        common += sum(_chars(x) * min(here[x], there[x]) for x in here.keys() & there.keys())
        return 2 * common / total, []
    out: list[tuple[int, int]] = []
    for at, p in left:
        for x in p.children:
            n = _chars(x)
            if there.get(x):
                there[x] -= 1
                common += n
            elif out and out[-1][1] == at:
                out[-1] = (out[-1][0], at + n)
            else:
                out.append((at, at + n))
            at += n
    return 2 * common / total, out


def likeness(a: str, b: str) -> float:
    """Share of code points in equal branches of two fingerprints: 1 for equal texts, 0 where no piece is shared."""
    return compared(parsed(a), parsed(b))[0]


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Spans of code points of a's text, end exclusive, in leaves that b doesn't have: where a was edited. Empty where b has all that a has."""
    return compared(parsed(a), parsed(b))[1]


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row of docs; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            a = 0
            while a < len(texts):
                z, size = a + 1, len(texts[a])
                while z < len(texts) and size + len(texts[z]) <= SLICE_BYTES:
                    size += len(texts[z])
                    z += 1
                made = [written(t) for t in trees(texts[a:z])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array([len(code_points(t)) for t in texts[a:z]], pa.int64()), pa.array(made, pa.string())], names=["id", "n_chars", "fingerprint"])
                a = z

    rows = docs.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text_column)).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_chars long, fingerprint string")


def _place(ident, h: int) -> tuple:
    return (ident is not None, 0 if ident is None else ident, h)


def edited_half(text: bytes, following: bytes) -> bytes:
    """text with its last floor(n / 2) code points replaced by the first as many, or all, of the following text."""
    own, other = code_points(text), code_points(following)
    n = len(own) // 2
    head = text[: own[len(own) - n]] if n else text
    return head + (following[: other[n]] if n < len(other) else following)


RESULT = [("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"), ("fingerprint", pa.string(), "string"), ("edited_fingerprint", pa.string(), "string"), ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double"), ("edit_from", pa.int64(), "long")]


def _answers(held: list[tuple]) -> Iterator[tuple]:
    """Results of all rows but the last one, of which each is followed by its next document."""
    rows = [i for i in range(len(held) - 1) if not held[i][1]]
    known: dict = {}
    own = trees([h[3] for h in held], known)
    edited = [edited_half(held[i][3], held[i + 1][3]) for i in rows]
    for i, text, tree in zip(rows, edited, trees(edited, known), strict=True):
        near_edited, spans = compared(tree, own[i])
        near_next, _ = compared(own[i], own[i + 1], spans=False)
        yield (held[i][2], own[i].chars, hashlib.sha256(text).hexdigest(), written(own[i]), written(tree), near_edited, near_next, spans[0][0] if spans else None)


def edited_neighbours(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row its fingerprint, that of its text with the second half replaced by the start of the next document's, and their likeness; see the module's text.

    Columns: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and edit_from, the code point at which the edited text's first differing branch starts (null where there is none)."""
    rows = docs.select(F.col(quoted(id_column)).alias("id"), F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = min(MOST_RANGES, parts(text_bytes(rows, "text"), range_bytes))
    firsts = rows.select("id", "h").repartitionByRange(n, "id", "h").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("id", "h")).alias("first"))
    border = sorted(_place(*r["first"]) for r in firsts.collect())  # a row a range
    kind = pa.schema([("bucket", pa.int32()), ("ghost", pa.bool_())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [_place(i, h) for i, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            bucket = [bisect_right(border, p) - 1 for p in places]
            again = [i for i, (p, b) in enumerate(zip(places, bucket, strict=True)) if p == border[b]]
            for take, where, ghost in ((None, bucket, False), (again, [(bucket[i] - 1) % len(border) for i in again], True)):
                part = batch if take is None else batch.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([ghost] * len(where), pa.bool_()), *part.columns], names=[*kind.names, *batch.schema.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ids = [], 0, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], ids), *[pa.array(c, t) for c, (_, t, _) in zip(columns[1:], RESULT, strict=True)]], names=["id", *[name for name, _, _ in RESULT]])

        for batch in batches:
            ids = batch.schema.field(2).type
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                size += len(row[3])
                if size > SLICE_BYTES and len(held) > 1:
                    if done := list(_answers(held)):
                        yield out(done)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1 and (done := list(_answers(held))):
            yield out(done)

    id_type = rows.schema["id"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"bucket int, ghost boolean, id {id_type}, text string, h long")
    ordered = dealt.repartitionById(max(1, len(border)), "bucket").sortWithinPartitions("bucket", "ghost", F.col("id").asc_nulls_first(), "h", "text")
    found = ordered.select("bucket", "ghost", "id", F.col("text").cast("binary")).mapInArrow(walk, f"id {id_type}, " + ", ".join(f"{name} {sql}" for name, _, sql in RESULT))
    return found.withColumnRenamed("id", id_column)
