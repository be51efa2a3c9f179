"""Secret scans: fixed patterns, and assignment-aware lexing on top of them.

The lexer reads whatever assignment syntax a text holds, source or configuration: `name = literal`, `name: literal`, `"name": "literal"`,
`name => literal`, `name := literal`, `table["name"] = literal`, `<name>literal</name>`, with an optional declaration word or type before the name, quoted literals with escapes, `+` joins of literals and names,
and bare values up to white space. Names bind to constants in text order, so that `a = "..."; password = a` finds the literal where it stands. Values are a graph of joins: binding and joining cost the parts
at hand, so a text of self-joins takes linear time.
Each literal that reaches a name is scored by how sensitive the name is and how secret the literal looks; one at or over the threshold becomes a span.

Spans are code points, end exclusive. Every text is scanned whole. Null or empty texts have no spans; the work is per row, so that no key or group of copies matters. Repeated rows
are scanned each; an empty table gives an empty result. Spans with one start are in the order of their kinds. Names are whole, however long. Comments are lexed like other text, and a name is bound
by the last assignment before its use, whatever its scope.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and the least length of what they must catch.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "lexed")

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(ACCESS)
# a run of hex digits that is long enough is the same match as the bare run, found faster
_hex = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")
#: Which texts can have an assignment at all.
_assign_hint = re.compile(r"[:=]")

#: Parts of names and how sensitive a name with such a part is.
NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0,
    "secretkey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "salt": 0.5, "cert": 0.4, "key": 0.4, "dsn": 0.5, "connectionstring": 0.7,
}
#: Words of names that tell against a secret value.
NAME_DISCOUNTS = {"count": 0.5, "length": 0.6, "limit": 0.6, "type": 0.5, "name": 0.4, "url": 0.3, "path": 0.4, "file": 0.4, "max": 0.4, "min": 0.4, "id": 0.2}
#: Values that stand in for a secret.
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|none|null|true|false|changeme|example|password|secret|your[_-].*|todo|redacted)$")

_assignment = re.compile(
    r"""(?P<q>["'`]?)(?<![\w$.])(?<![\w$.]-)(?P<name>[A-Za-z_$][\w$.-]*+)(?P=q)\]?"""  # a bare or quoted name, whole; also as a subscript
    r"""(?:[ \t]*:[ \t]*[A-Za-z_][\w.\[\]<>]*+(?=[ \t]*=[^=]))?"""  # its type
    r"""[ \t]*(?:=>|:=|=(?![=>~])|:(?![:/]))[ \t]*""",
    re.ASCII,
)
_element = re.compile(r"<([A-Za-z_][\w.:-]*+)>([^<>]*+)</\1[ \t]*>", re.ASCII)
_string = re.compile(r"""[bBrRuUfF]{0,2}(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`)""")
_identifier = re.compile(r"[A-Za-z_$][\w$.]*", re.ASCII)
_bare = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
_join = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*")
_camel = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_ending = re.compile(r"[.!?:]+$")


def name_score(name: str) -> float:
    """0 to 1, from the words of the name and from neighbouring words together."""
    words = [w for w in re.split(r"[^a-z0-9]+", _camel.sub("_", name).lower()) if w]
    joined = ["".join(words[i : i + 2]) for i in range(len(words) - 1)]
    best = max((NAME_SCORES.get(w, 0.0) for w in words + joined), default=0.0)
    return max(0.0, best - max((NAME_DISCOUNTS.get(w, 0.0) for w in words), default=0.0)) if best else 0.0


def literal_score(value: str) -> float:
    """0 to 1, from length, character kinds and entropy."""
    if len(value) < 8 or PLACEHOLDERS.match(value) or value.isspace():
        return 0.0
    return _looks(len(value), Counter(value))


def _looks(length: float, counts: dict[str, float]) -> float:
    entropy = -sum(c / length * math.log2(c / length) for c in counts.values())
    letters = "".join(counts)
    kinds = sum(map(bool, (re.search(p, letters) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))))
    spaced = sum(n for c, n in counts.items() if c.isspace()) / length
    return max(0.0, min(1.0, 0.25 * min(entropy, 4) / 4 + 0.25 * min(length, 20) / 20 + 0.5 * min(kinds - 1, 2) / 2 - 2 * spaced))


class Shape(NamedTuple):
    """What the score of a long joined value needs: its length, counts of its characters, and its ends. Characters from U+0100 on share 256 counts, spaces one."""

    length: float
    counts: dict[str, float]
    head: str
    tail: str

    def score(self) -> float:
        shown = self.head + "".join(sorted(self.counts)) + self.tail  # matches a placeholder's pattern if the value does
        return 0.0 if PLACEHOLDERS.match(shown) or all(map(str.isspace, self.counts)) else _looks(self.length, self.counts)


def _shape(value: str) -> Shape:
    counts: dict[str, float] = {}
    for c, n in Counter(value).items():
        c = " " if c.isspace() and c != "\n" else c if ord(c) < 256 else chr(256 + ord(c) % 256)
        counts[c] = counts.get(c, 0) + n
    return Shape(len(value), counts, value[:ENDS], value[-ENDS:])


def _merged(a: Shape, b: Shape) -> Shape:
    counts = dict(a.counts)
    for c, n in b.counts.items():
        counts[c] = counts.get(c, 0) + n
    length = a.length + b.length
    if length > 2.0**60:  # lengths double with each self-join; shares are what counts
        length, counts = length / 2**30, {c: n / 2**30 for c, n in counts.items()}
    return Shape(length, counts, (a.head + b.head)[:ENDS], (a.tail + b.tail)[-ENDS:])


class Values:
    """The values that names have, as a graph: a node is a literal where it stands, or a join of earlier nodes.

    A name is bound to a node, so a join costs its own parts, whatever they reach; scores are left at nodes and go down to the literals once, at the end."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int] | None] = []
        self.parts: list[tuple[int, ...]] = []
        self.whole: list[str | None] = []  # the value itself, where it is a literal or short
        self.shapes: list[Shape | None] = []
        self.looks: list[float | None] = []
        self.best: list[float] = []

    def _node(self, span: tuple[int, int] | None, parts: tuple[int, ...], whole: str | None, shape: Shape | None) -> int:
        for column, x in ((self.spans, span), (self.parts, parts), (self.whole, whole), (self.shapes, shape), (self.looks, None), (self.best, 0.0)):
            column.append(x)
        return len(self.spans) - 1

    def literal(self, start: int, end: int, value: str) -> int:
        return self._node((start, end), (), value, None)

    def shape(self, node: int) -> Shape:
        if self.shapes[node] is None:
            self.shapes[node] = _shape(self.whole[node])
        return self.shapes[node]

    def joined(self, nodes: list[int]) -> int:
        if len(nodes) == 1:
            return nodes[0]
        values = [self.whole[n] for n in nodes]
        if all(v is not None for v in values) and sum(map(len, values)) <= WHOLE:
            return self._node(None, tuple(nodes), "".join(values), None)
        return self._node(None, tuple(nodes), None, reduce(_merged, map(self.shape, nodes)))

    def score(self, node: int) -> float:
        if self.looks[node] is None:
            self.looks[node] = self.shapes[node].score() if self.whole[node] is None else literal_score(self.whole[node])
        return self.looks[node]

    def settled(self) -> dict[tuple[int, int], float]:
        """The best score of each literal's span, of all values it went into."""
        out: dict[tuple[int, int], float] = {}
        for node in range(len(self.spans) - 1, -1, -1):  # parts come before what they are parts of
            for part in self.parts[node]:
                self.best[part] = max(self.best[part], self.best[node])
            if (span := self.spans[node]) and self.best[node] > out.get(span, 0.0):
                out[span] = self.best[node]
        return out


#: Joined values of so many code points at most are kept as they are; of longer ones the shape, with so many code points of each end.
WHOLE, ENDS = 256, 64


def assignments(text: str, values: Values) -> Iterator[tuple[str, int]]:
    """(name, node of its value) of each assignment in order, after constants are propagated."""
    bound: dict[str, int] = {}
    at = 0
    while m := _assignment.search(text, at):
        at, found = m.end(), []
        where, bare = at, False
        while True:
            if s := _string.match(text, where):
                g = next(i for i in (1, 2, 3) if s.group(i) is not None)
                found.append(values.literal(s.start(g), s.end(g), s.group(g)))
                where = s.end()
            elif (s := _identifier.match(text, where)) and s.group() in bound:
                found.append(bound[s.group()])
                where = s.end()
            elif not found and (s := _bare.match(text, where)):
                value = _ending.sub("", s.group())
                found.append(values.literal(s.start(), s.start() + len(value), value))
                bare = True
                break
            else:
                break
            if not (j := _join.match(text, where)):
                break
            where = j.end()
        if found:
            bound[m.group("name")] = node = values.joined(found)
            yield m.group("name"), node
        # a bare value may itself start the next assignment, as in "a: b = c"; quoted ones may not
        at = where if found and not bare and text[m.end() : m.end() + 1] in "\"'`" else m.end()


def elements(text: str, values: Values) -> Iterator[tuple[str, int]]:
    """(name, node) of each element that holds just text, `<name>literal</name>`, without white space at its ends."""
    for m in _element.finditer(text):
        if value := m.group(2).strip():
            start = m.start(2) + m.group(2).index(value)
            yield m.group(1), values.literal(start, start + len(value), value)


def lexed_spans(text: str, threshold: float) -> list[tuple[int, int]]:
    values = Values()
    for name, node in itertools.chain(assignments(text, values), elements(text, values)):
        if sensitive := name_score(name):
            values.best[node] = max(values.best[node], sensitive * values.score(node))
    return sorted(span for span, score in values.settled().items() if score >= threshold)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the fixed patterns' matches, leftmost and non-overlapping per kind."""
    out = []
    if _assign_hint.search(text):
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(out)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long"
_schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_lexed", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            base = base_spans(text)
            lexed = [(a, 3, b) for a, b in lexed_spans(text, threshold)] if _assign_hint.search(text) or "</" in text else []
            counts = Counter(kind for _, kind, _ in base)
            out.append((ident, counts[0], counts[1], counts[2], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(sorted(base + lexed)), len(lexed)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _schema, strict=True)] if out else [pa.array([], t.type) for t in _schema], schema=_schema)


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.45) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed.

    A base span is the whole match; a lexed span is the literal without its quotes. base_sha256 is of kind:start:end by start, then kind as listed, comma-joined; spans has all spans likewise."""
    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    return rows.mapInArrow(lambda it: _scan(it, threshold), FOUND)
