"""Document fingerprints, the filter audit and centroid clustering against brute force, and their edge rows."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import centroids, exact_dedup, filter_audit, merkle, near_dedup, secrets

DOC = "doc_id long, text string, lang string"


def prose(rng, n):
    return " ".join(f"wörd{rng.randrange(300)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    page = "\n".join(prose(rng, rng.randrange(3, 60)) for _ in range(30))
    out = [(3, None, "en"), (4, "", None), (5, "\n\n", ""), (6, "x", "de"), (6, "x", "de"), (7, "€ü", "de"), (9, page, "en"), (10, page, "en"), (11, page + "\nmore", "en"), (-2, "# head\ntext\n\n# next\n" + page, "fr")]
    out += [(None, "no id", "en"), (None, page, None), (None, None, "en"), (20, prose(rng, 30_000), "en"), (21, "y" * 5000, "en")]
    return out + [(100 + i, prose(rng, rng.randrange(1, 400)), "en") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], DOC + ", bucket int, ghost string, digest string").repartition(6)


def mixed(h):
    full = (1 << 64) - 1
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & full
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & full
    return h ^ (h >> 31)


def plain_tree(text):
    """Root and leaves of a text, byte by byte."""
    sha = lambda b: hashlib.sha256(b).digest()
    paragraphs, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] != 10:
            end += 1
        while end < len(text) and text[end] == 10:
            end += 1
        paragraphs.append(text[at:end])
        at = end
    leaves, of_sections, inner = [], [], []
    for nth, p in enumerate(paragraphs):
        padded, cut = b"\0" * 8 + p, []
        for i in range(len(p)):
            mask = min(64, max(8, 2 ** max(0, i.bit_length() - 1))) - 1
            cut.append(i >= 8 and mixed(int.from_bytes(padded[i : i + 8], "big")) & mask == 0)
        starts = [0] + [i for i in range(8, len(p)) if cut[i] and not any(cut[max(0, i - 3) : i]) and p[i] & 0xC0 != 0x80 and p[i] != 10]
        pieces = [p[a:b] for a, b in zip(starts, [*starts[1:], len(p)], strict=True)]
        digest = sha(b"".join(map(sha, pieces)))
        leaves += [(sha(x).hex()[:8], len(x.decode())) for x in pieces]
        inner.append(digest)
        if nth + 1 == len(paragraphs) or digest[-1] % 4 == 0 or p.endswith(b"\n\n") or paragraphs[nth + 1][:1] == b"#":
            of_sections.append(sha(b"".join(inner)))
            inner = []
    return sha(b"".join(of_sections)).hex(), leaves


def test_tree_against_bytes(rows):
    texts = [(t or "").encode() for _, t, _ in rows]
    for text, tree in zip(texts, merkle.trees(texts), strict=True):
        root, leaves = plain_tree(text) if len(text) < 60_000 else (tree.root, None)
        shown = merkle.written(tree)
        assert merkle.parsed(shown) == tree and tree.root == root and tree.chars == len(text.decode())
        if leaves is not None:
            assert [tuple([x[:8], int(x[9:])]) for s in tree.sections for p in s.children for x in p.children] == leaves
    alone = [merkle.trees([t])[0] for t in texts]
    assert alone == merkle.trees(texts)


def test_likeness_and_located_edits():
    rng = random.Random(2)
    lines = [prose(rng, 40) for _ in range(30)]
    text = "\n".join(lines)
    changed = "\n".join([*lines[:12], lines[12][:100] + "EDIT" + lines[12][104:], *lines[13:]])
    a, b = (merkle.written(t) for t in merkle.trees([text.encode(), changed.encode()]))
    at = sum(len(x) + 1 for x in lines[:12]) + 100
    spans = merkle.differing(b, a)
    assert spans and spans[0][0] <= at and spans[-1][1] >= at + 4 and sum(z - s for s, z in spans) < 500
    assert 0.95 < merkle.likeness(a, b) < 1 and merkle.likeness(a, a) == 1 and merkle.differing(a, a) == []
    inserted = "\n".join([*lines[:3], prose(rng, 20), *lines[3:]])
    (c,) = (merkle.written(t) for t in merkle.trees([inserted.encode()]))
    assert merkle.likeness(a, c) > 0.93
    other = merkle.written(merkle.trees([prose(rng, 500).encode()])[0])
    assert merkle.likeness(a, other) < 0.05 and merkle.likeness(a, merkle.written(merkle.trees([b""])[0])) == 0.0


def plain_likeness(a, b):
    la, lb = (Counter(plain_tree(t)[1]) for t in (a, b))
    total = len(a.decode()) + len(b.decode())
    return 1.0 if a == b else 2 * sum(x[1] * n for x, n in (la & lb).items()) / total


@pytest.mark.parametrize("range_bytes", [1 << 25, 4000])
def test_edited_neighbours(spark, docs, rows, range_bytes):
    key = {i: h for i, h in enumerate(r[0] for r in spark.createDataFrame([(i, t or "") for i, (_, t, _) in enumerate(rows)], "i int, t string").orderBy("i").select(F.xxhash64("t")).collect())}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, key[i], rows[i][1] or ""))
    want = Counter()
    for nth, i in enumerate(order):
        text, following = rows[i][1] or "", rows[order[(nth + 1) % len(order)]][1] or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + following[:n]
        near = [round(plain_likeness(text.encode(), x.encode()), 9) for x in (edited, following)] if max(len(text), len(following)) < 60_000 else [None, None]
        want[rows[i][0], len(text), hashlib.sha256(edited.encode()).hexdigest(), merkle.written(merkle.trees([text.encode()])[0]), merkle.written(merkle.trees([edited.encode()])[0]), *near] += 1
    got = Counter()
    for r in merkle.edited_neighbours(docs, range_bytes=range_bytes).collect():
        long = r.n_chars >= 60_000 or r.doc_id in {x[0] for x, y in zip([rows[i] for i in order], [rows[i] for i in order[1:]], strict=False) if len(y[1] or "") >= 60_000}
        got[r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, *([None, None] if long else [round(r.near_edited, 9), round(r.near_next, 9)])] += 1
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.edit_from is None or r.edit_from < max(1, r.n_chars))
    assert got == want


def test_fingerprints_tell_texts_apart(docs, rows):
    got = merkle.fingerprints(docs).collect()
    texts = {t or "" for _, t, _ in rows}
    assert len(got) == len(rows) and {r.fingerprint for r in got} == {merkle.written(merkle.trees([t.encode()])[0]) for t in texts} and len({r.fingerprint for r in got}) == len(texts)


def test_empty_and_single_tables(spark):
    empty = spark.createDataFrame([], DOC)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert merkle.edited_neighbours(empty).count() == 0 and filter_audit.audit(empty, labels).count() == 0 and merkle.fingerprints(empty).count() == 0
    one = merkle.edited_neighbours(spark.createDataFrame([(1, "abcd", "en")], DOC)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert centroids.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_filter_audit(spark, docs, rows):
    rng = random.Random(4)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [3, 4, 6, 6, 7, 9, 11, 20, 21, *range(100, 140, 2), 999]] + [(None, 1, 1)]
    special = [(300 + i, t, lang) for i, (t, lang) in enumerate([("a b a b", "en"), ("AB c", "en"), ("a # b", "de"), ("same", "en"), ("same", "de"), ("same", None), ("word " * 300, "en"), ("W" * 3 + "x" * 97, "en"), ("W" * 4 + "x" * 96, "en"), ("a b", "en")])]
    rows = [*rows, *special, *[(400 + i, "hot text", "en") for i in range(30)]]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], DOC + ", part string, code int").repartition(5)
    got = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    failed = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        failed.append((lang or "", i, fails))
    want = set()
    for part in {p for p, _, _ in failed}:
        own = [(i, f) for p, i, f in failed if p == part]
        steps = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                steps[order, step] = (len(left), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
        for (order, step), v in steps.items():
            want.add((part, order, step, *v, sum(w[1] for (o, s), w in steps.items() if o[s - 1] == order[step - 1])))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def plain_clusters(vectors, clusters, rounds, seed=2):
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in vectors)
    c = [list(v) for _, v in first[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in vectors]
        for k in range(len(c)):
            own = [v for (_, v), a in zip(vectors, at, strict=True) if a == k]
            if own:
                c[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [near(v) for _, v in vectors], c


def test_clusters_against_all_distances(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(6, 64))
    data = [(int(i), [float(np.float32(x)) for x in middle[i % 6] + 0.3 * rng.normal(size=64)]) for i in range(240)]
    data += [(500, data[0][1]), (0, data[0][1]), (None, data[1][1]), (501, [0.0] * 64)] + [(600 + i, data[2][1]) for i in range(100)]  # repeats, ties, a null id, a hot vector
    bad = [(700, None), (701, [1.0] * 63), (702, [1.0] * 65), (703, [None] + [1.0] * 63), (704, [float("nan")] + [1.0] * 63), (705, [float("inf")] + [1.0] * 63), (706, [])]
    table = spark.createDataFrame([(i, v, 1, "c") for i, v in data + bad], "vec_id long, embedding array<float>, cluster int, lead string").repartition(5)
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data]
    for clusters, rounds in ((12, 5), (400, 2)):  # more clusters than vectors, too
        found, c = plain_clusters(whole, clusters, rounds)
        per = Counter()
        for d, k in found:
            per[k] += d
        want = Counter((i, k, d, per[k], sum(per.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(whole, found, strict=True))
        got = centroids.clustered(table, clusters=clusters, rounds=rounds).collect()
        assert Counter(tuple(r)[:6] for r in got) == want
        if clusters == 12:
            assert np.mean([r.n_verified for r in got]) < 6  # the filter spares most distances


def test_bound_never_loses_the_nearest():
    rng = np.random.default_rng(5)
    for size in (3, 1000, 1 << 27):
        x = rng.integers(-size, size + 1, (500, 64))
        c = x[:40] + rng.integers(-1, 2, (40, 64))
        axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
        lead, rest = centroids.rotated(x, axes, 16)
        cluster, distance, _ = centroids.nearest(x, lead.astype(np.float32), rest.astype(np.float32), c, axes)
        every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_huge_components_are_held(spark):
    table = spark.createDataFrame([(1, [1e30] + [0.0] * 63), (2, [-1e30] + [0.0] * 63)], "vec_id long, embedding array<float>")
    assert [r.distance for r in centroids.clustered(table, clusters=2).collect()] == [0, 0]


def test_secrets_of_hostile_texts():
    literal = "s3cr3t!Pass#99"
    own = f'password_a = "{literal}"\n' + "password_a = password_a + password_a\n" * 10_000
    chain = f'p = "{literal}"\n' + "".join(f'p = p + "x{i}Y"\n' for i in range(10_000)) + "password = p\n"
    often = f'a = "{literal * 20_000}"\n' + "password = a\nb = a + a\n" * 10_000
    for text, spans in ((own, 1), (chain, 10_001), (often, 1)):
        began = time.process_time()
        assert len(secrets.lexed_spans(text, 0.45)) == spans
        assert time.process_time() - began < 5
    assert secrets.lexed_spans(own, 0.45) == [(14, 28)]


def test_long_joins_score_like_their_text():
    values = secrets.Values()
    rng = random.Random(1)
    for piece in ("Ab1!xyz9", "x", "*", "word ", "é中9"):
        parts = [values.literal(i, i + 1, piece * rng.randrange(1, 60)) for i in range(40)]
        node = values.joined(parts)
        whole = "".join(values.whole[n] for n in parts)
        assert values.whole[node] is None and abs(values.score(node) - secrets.literal_score(whole)) < 1e-9, piece


def test_stages_keep_maps_arrays_and_binaries(spark):
    rows = [(1, "the same text " * 9, {"a": "b"}, [1], b"x"), (1, "the same text " * 9, {"a": "b"}, [1], b"x"), (2, "the same  text " * 9, {}, [], None), (3, "other words here " * 9, None, None, b"")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,string>, a array<int>, b binary")
    for stage in (exact_dedup.drop_exact_duplicates, near_dedup.one_of_each_group):
        got = stage(docs)
        assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) in ([1, 3], [2, 3])


@pytest.mark.parametrize("most_bits", [1 << 28, 1])
def test_rows_are_dropped_without_a_shuffle_of_the_others(spark, most_bits):
    """Kept rows pass by the bitmap, nulls and repeats are told apart, and with a bitmap far too small the join decides alike."""
    from tarnlake.llm import staging

    docs = spark.range(60_000).selectExpr("if(id % 1000 = 7, null, id) doc_id", "concat('text ', id) text", "map('k', id) extra")
    docs = docs.unionByName(docs.filter("doc_id = 20 or doc_id = 21"))
    rows = docs.selectExpr("doc_id id", "text", "doc_id is not null and doc_id % 3 <> 0 stays")
    kept = staging.rows_that_stay(docs, {"id": F.col("doc_id"), "text": F.col("text")}, rows, most_bits)
    assert kept.columns == docs.columns
    want = [i for i in range(60_000) if i % 1000 != 7 and i % 3]
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == want

    whole = docs.select(F.struct("doc_id", "text").alias("row"), F.col("doc_id").alias("key_0"), F.col("text").alias("key_1"))
    table = docs.filter("doc_id % 3 = 0").selectExpr("doc_id to_0", "text to_1")
    maybe, surely_not = staging._maybe_in([F.col("key_0"), F.col("key_1")], whole, table, ["to_0", "to_1"], 1 << 20)
    found = {r.key_0 for r in maybe.select("key_0").collect()}
    assert {i for i in range(0, 60_000, 3) if i % 1000 != 7} <= found and len(found) < 23_000
    assert maybe.count() + surely_not.count() == docs.count()


def test_new_words_are_encoded_with_their_text():
    """A text of words never seen before goes to the encoder once, not once for each word."""
    from tokenizers import Tokenizer

    from tarnlake.llm import packing
    from tarnlake.llm.queries import tokenizer_path

    mine, calls = packing.PieceTokenizer(tokenizer_path(), added_tokens=True), []
    encode = mine.encode
    mine.encode = lambda text: calls.append(text) or encode(text)
    text = "\n".join(" ".join(f"w{i * j}x{j}" for j in range(50)) for i in range(20)) + "  end "
    assert np.frombuffer(mine(text), "<u4").tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert len(calls) == 1


def test_buckets_of_ngrams_fit_beside_the_executor():
    """A bucket of two million n-grams is summed, written and passed on in less than seven times their own space."""
    import tempfile
    import tracemalloc

    import pyarrow as pa

    from tarnlake.llm import ngram_lm

    rng, frequent = np.random.default_rng(5), np.array([ngram_lm.BEGIN])
    words = rng.integers(1, 1 << 63, 4000, dtype=np.uint64)
    messages = [(0, 3, *ngram_lm.pack(words[rng.integers(0, 4000, (50_000, 3))], np.ones(50_000, np.int64))) for _ in range(40)]
    table = ngram_lm.table_of(messages, ngram_lm._packed)
    with tempfile.TemporaryDirectory() as folder:
        tracemalloc.start()
        out = ngram_lm._ngrams(3, folder, frequent, 64, table)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert isinstance(out, pa.Table) and out.num_rows > 1
    assert peak < 7 * 2_000_000 * 24, peak


def test_links_are_kept_in_few_files(spark):
    """However many partitions a shuffle has, the tables of a search for components are a few files each."""
    from tarnlake.llm.components import components

    conf = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        found = components(spark.range(4000).selectExpr("id AS a", "id - id % 4 AS b"))
        assert len(found.inputFiles()) <= max(32, 4 * spark.sparkContext.defaultParallelism) < 211
        assert {(r["node"], r["component"]) for r in found.collect()} == {(i, i - i % 4) for i in range(4000)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_look_ups_cost_less_than_two_sorts():
    """Finding hashes among stored keys takes less than 1.8 times a stable sort of these hashes."""
    import time

    from tarnlake.llm import ngram_lm

    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 400_000, dtype=np.uint64)
    counts = np.where(np.arange(len(h)) % 2, 1, 7)
    arrays = ngram_lm._by_key(h, [counts], counts == 1)
    asked = np.concatenate([h[:180_000], rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)])

    def least(f):
        out = []
        for _ in range(9):
            began = time.process_time()
            f()
            out.append(time.process_time() - began)
        return min(out)

    assert ngram_lm._looked_up(arrays, asked, 1)[0][:180_000].tolist() == counts[:180_000].tolist()
    assert least(lambda: ngram_lm._looked_up(arrays, asked, 1)) < 1.8 * least(lambda: np.argsort(asked, kind="stable"))


def test_look_ups_in_crowded_places():
    """Many keys in one place, with equal lower halves, are told apart, and all columns of large sums are whole."""
    from tarnlake.llm import ngram_lm

    rng = np.random.default_rng(6)
    h = np.concatenate([rng.integers(0, 1 << 63, 300, dtype=np.uint64), np.uint64(7 << 40) + (np.arange(200, dtype=np.uint64) << np.uint64(16)), np.uint64(9 << 40) + np.arange(200, dtype=np.uint64)])
    columns = [rng.choice([2, 5, 254, 255, 256, 2**33], len(h)) for _ in range(4)]
    plain = rng.random(len(h)) < 0.5
    for j, c in enumerate(columns):
        c[plain] = j in (0, 1, 3)
    arrays = ngram_lm._by_key(h, columns, plain)
    by = rng.permutation(len(h))
    asked = np.concatenate([h[by], h[:300] ^ np.uint64(1 << 23), np.uint64(7 << 40) + (np.arange(200, 256, dtype=np.uint64) << np.uint64(16))])
    for got, c in zip(ngram_lm._looked_up(arrays, asked, 4), columns, strict=True):
        assert got[: len(h)].tolist() == c[by].tolist() and not got[len(h) :].any()


def test_numbers_sort_with_their_places():
    """Equal numbers are neighbours also where numbers differ only in bits that give way to their places."""
    from tarnlake.llm import ngram_lm

    rng = np.random.default_rng(7)
    for h in (rng.integers(0, 1 << 63, 5000, dtype=np.uint64), np.repeat(rng.integers(0, 1 << 63, 900, dtype=np.uint64), 3), rng.permutation(np.tile(np.arange(40, dtype=np.uint64), 9)), np.zeros(0, np.uint64), np.full(1, 5, np.uint64)):
        for bits in (64, 6) if h.max(initial=0) < 40 else (64,):
            order, ordered = ngram_lm._sorted(h, bits)
            assert sorted(order.tolist()) == list(range(len(h))) and ordered.tolist() == h[order].tolist() == sorted(h.tolist())
        words, code = ngram_lm._coded(h)
        assert len(set(words.tolist())) == len(words) and words[code].tolist() == h.tolist()


def test_look_ups_share_calls_between_files(tmp_path):
    """A model of many files, with few hashes for each, takes few calls a file, and its files aren't held open."""
    import cProfile
    import os
    import pstats
    import sys

    from tarnlake.llm import ngram_lm

    rng, n = np.random.default_rng(8), 400
    h = rng.integers(0, 1 << 64, 12_000, dtype=np.uint64)
    bucket, counts = ngram_lm._range_of(h, n), rng.choice([1, 2, 300], len(h))
    for k in range(1, n):  # nothing fell in the first
        own = bucket == k
        ngram_lm._save(f"{tmp_path}/plain/{k:08d}", ngram_lm._by_key(h[own], [counts[own]], counts[own] == 1))
    (tmp_path / ngram_lm.MARK).touch()
    files, before = ngram_lm.Files(ngram_lm.NgramModel(1, str(tmp_path), n, 0, 0)), len(os.listdir("/proc/self/fd"))
    find = lambda: files._find("plain", bucket, h, 0, 1, ngram_lm._N_ARRAYS[1])[0].tolist()
    assert find() == np.where(bucket == 0, 0, counts).tolist()
    if sys.version_info >= (3, 13):
        assert len(os.listdir("/proc/self/fd")) < before + n // 2
    profile = cProfile.Profile()
    profile.runcall(find)
    assert pstats.Stats(profile).total_calls < 60 * n
