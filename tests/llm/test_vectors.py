"""Exact top-k, hard negatives and the manifest against brute force, with nulls, odd numbers, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import manifest as mf
from folioflow.llm import negatives, topk, vectors
from folioflow.llm import queries as q

from ..conftest import SMALL

VEC = "vec_id bigint, embedding array<float>, label int"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(-100, None, 1), (-200, [0.5, None], 2), (-300, [0.5, float("nan")], 3), (-400, [0.5, float("inf")], 3), (None, [0.5, 0.25], 4), (-500, [], 1), (-600, [0.5, -0.25], None)]


def rows(df):
    return Counter(map(tuple, df.collect()))


def scaled(found, scale):
    """The rows that take part, one an id, as Python's integers."""
    out = {}
    for i, v, label in found:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = ([float(np.float32(x)) for x in v], label)
        if i not in out or r < out[i]:
            out[i] = r
    return {i: ([math.floor(scale * x) for x in v], label) for i, (v, label) in out.items()}


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(found, k=10):
    own = scaled(found, 1024)
    want = Counter()
    for i, (v, _) in own.items():
        if i % 100 == 0:
            best = sorted((-dot(v, w), j) for j, (w, _) in own.items() if j != i)[:k]
            want.update((i, r, j, -s) for r, (s, j) in enumerate(best, 1))
    return want


def brute_negatives(found, n_pos=5, n_neg=10):
    own = scaled([r for r in found if r[2] is not None], 256)
    want = Counter()
    for a, (v, label) in own.items():
        if a % 100:
            continue
        best = sorted((-dot(v, w), j) for j, (w, _) in own.items() if j != a)
        for s, p in [x for x in best if own[x[1]][1] == label][:n_pos]:
            ok = [x for x in best if own[x[1]][1] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:n_neg]
            want.update((a, p, r, n, -s, -t) for r, (t, n) in enumerate(ok, 1))
    return want


def cloud(n, d=6, seed=1, hot=0.4):
    """Clustered vectors, of which a share are one vector, with ties of labels and scores."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    return [(i, centres[0] if r.random() < hot else [round(c + r.gauss(0, 0.3), 2) for c in r.choice(centres)], r.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"shard": 40, "leaf": 4, "block": 3, "group": 2}])
def test_top_k(spark, sizes):
    found = cloud(500) + ODD + [(700, [0.25], 1), (-700, [1.5] * 9, 1), (3, [9.0] * 6, 1), (200, [9.0] * 6, 2)] + cloud(500)[:100]
    df = spark.createDataFrame(found, VEC).repartition(5).withColumn("score", F.lit("clash")).withColumn("ids", F.lit(1)).withColumn("id", F.lit(2))
    assert rows(topk.top_k(df, F.col("vec_id") % 100 == 0, **sizes)) == brute_top(found)


def test_top_k_few_rows_and_large_numbers(spark):
    df = lambda found: spark.createDataFrame(found, "vec_id bigint, embedding array<double>")
    ask = lambda found, **k: [tuple(r) for r in topk.top_k(df(found), F.col("vec_id") % 100 == 0, **k).orderBy("query_id", "rank").collect()]
    assert ask([]) == [] and ask([(0, [1.0])]) == [] and ask([(5, [1.0]), (6, [1.0])]) == []
    assert ask([(0, [1.0]), (1, [-0.0001]), (2, [2.0])]) == [(0, 1, 2, 1024 * 2048), (0, 2, 1, -1024)]
    big = [(0, [2.0**25, 1.0]), (1, [2.0**24, 1.0]), (2, [2.0**24, 1.0]), (3, [-(2.0**25), 0.0]), (4, [1e300, 0.0])]
    assert ask(big)[:3] == [(0, 1, 1, vectors.HIGH - 1), (0, 2, 2, vectors.HIGH - 1), (0, 3, 4, vectors.HIGH - 1)]
    exact = [(0, [2.0**19, 3.0]), (1, [2.0**18 + 1 / 1024, 1.0]), (2, [2.0**18, 5.0])]
    assert ask(exact) == [(0, 1, 1, 2**29 * (2**28 + 1) + 3 * 1024 * 1024), (0, 2, 2, 2**29 * 2**28 + 15 * 1024 * 1024)]


def test_boxes_bound_and_prune():
    r = np.random.default_rng(3)
    x = vectors.narrow((r.normal(size=(2000, 3)) * 100).astype(np.int64))
    ids = r.permutation(2000).astype(np.int64)
    tree = topk.Tree(topk.build(ids, x, 16), 16)
    ask = vectors.Exact(vectors.narrow((r.normal(size=(7, 3)) * 100).astype(np.int64)))
    base = sum(map(len, tree.levels[:-1]))
    bound = tree.upper(ask.of(np.float64), base + np.arange(len(tree.levels[-1])))
    for n, (a, b) in enumerate(tree.levels[-1]):
        assert (bound[:, n] >= ask.times(tree.x, slice(None), slice(a, b)).max(1)).all() and (np.diff(tree.ids[a:b]) > 0).all()
    visited = []
    times = vectors.Exact.times
    try:
        vectors.Exact.times = lambda s, o, mine=slice(None), its=slice(None): visited.append(len(mine)) or times(s, o, mine, its)
        topk.search(tree, np.full(7, -1), ask, vectors.nothing(7, 10), 10)
    finally:
        vectors.Exact.times = times
    assert sum(visited) < 7 * len(tree.levels[-1]) / 3  # most leaves are never visited


@pytest.mark.parametrize("sizes", [{}, {"pivots": 7, "anchors": 2, "slice_rows": 100}])
def test_hard_negatives(spark, sizes):
    found = cloud(400, seed=2) + [(1000 + 100 * i, [float(i), 1.0, 0.0, 0.0, 0.0, -1.0], i % 3) for i in range(12)] + ODD + [(3, [9.0] * 6, 1)] + cloud(400, seed=2)[:50]
    df = spark.createDataFrame(found, VEC).repartition(5).withColumn("g", F.lit("clash")).withColumn("cell", F.lit(1)).withColumn("_l", F.lit(1))
    assert rows(negatives.mine(df, F.col("vec_id") % 100 == 0, **sizes)) == brute_negatives(found)


def test_hard_negatives_few_rows(spark):
    mine = lambda found: rows(negatives.mine(spark.createDataFrame(found, VEC), F.col("vec_id") % 100 == 0))
    assert not mine([]) and not mine([(0, [1.0], 1)]) and not mine([(1, [1.0], 1), (2, [1.0], 2)])
    assert mine([(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == Counter([(0, 1, 1, 2, 65536, 32768)])
    assert not mine([(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)])  # no range below a negative score
    assert mine([(0, [1.0], 1), (1, [0.0], 1), (2, [0.0], 2)]) == Counter([(0, 1, 1, 2, 0, 0)])


def test_rows_far_away_are_not_sent(spark):
    """Bounds keep rows from groups that cannot need them."""
    pivots = negatives.Pivots(np.array([[100.0, 0.0], [-100.0, 0.0]]), 10000.0)
    groups = negatives.Groups(pivots, {0: (3, 5.0, 10100.0, 9900.0), 1: (3, 5.0, 10100.0, 9900.0)}, 1, 10)
    sent = groups.wanted(np.array([[99.0, 1.0], [-99.0, 2.0], [0.0, 5.0]]), np.array([8000.0, 8000.0]), np.full(2, np.inf), False)
    assert sent.tolist() == [[True, False], [False, True], [False, False]]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(docs):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of each row."""
    leaf = lambda r: H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])])
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    trees = defaultdict(list)
    for r in docs:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf((r[0], lower(r[1]), *r[2:])) if tampered else leaf(r), r[0]))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        trees[k].sort()
    built = {k: levels([n[2] for n in trees[k]]) for k in names}
    top = levels([built[k][-1][0] for k in names])
    want = Counter()
    for t, k in enumerate(names):
        for i, (_, _, own, seen, doc_id) in enumerate(trees[k]):
            proof, value = "", seen
            for lv, at in ((built[k], i), (top, t)):
                for nodes in lv[:-1]:
                    a = at // 8 * 8
                    before, after = "".join(nodes[a:at]), "".join(nodes[at + 1 : a + 8])
                    proof, value, at = proof + before + after, H(before, value, after), at // 8
            want[doc_id, own, built[k][-1][0], top[-1][0], proof, value, value == top[-1][0]] += 1
    return want


def proved(df, chunk=mf.CHUNK):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    seen = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, mf.leaf_of(*[lowered if c == "text" else F.col(c) for c in fields]))
    return mf.manifest(df, fields, "lang", "doc_id", seen=seen, chunk=chunk)


ODD_DOCS = [(-1, None, None, None, None), (-2, "", "", "", 0), (-3, "Long " * 50_000, "en", "s", 5), (None, "No id", "en", "s", 5), (None, "No id", "en", "s", 5), (None, "Other", "en", "s", 5), (-4, "é:A", "zz", ":", -7), (-5, "Twice", "en", "s", 1), (-5, "Twice", "en", "s", 1), (-5, "Else", "en", "s", 1)]


def few(n, langs, seed=5):
    r = random.Random(seed)
    return [(i, f"Text {r.random()}", r.choice(langs), "s", i) for i in range(n)]


@pytest.mark.parametrize("docs", [[], ODD_DOCS[:1], ODD_DOCS[:3], ODD_DOCS, few(8, ["a"]), few(9, ["a"]), few(700, ["a"]) + ODD_DOCS, few(80, [f"l{i}" for i in range(70)]), few(600, ["a", "a", "a", "b", None])])
def test_manifest(spark, docs):
    df = spark.createDataFrame(docs, DOC).repartition(3).withColumn("leaf", F.lit("clash")).withColumn("place", F.lit(1)).withColumn("tree", F.lit(1))
    assert rows(proved(df, 2)) == brute_manifest(docs)


def test_manifest_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows(proved(docs)) == brute_manifest([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()])
    digests = {r.doc_id: r.proof_sha256 for r in q.op13_merkle_manifest(spark, SMALL).collect()}
    assert digests == {r.doc_id: H(r.proof) for r in proved(docs).collect()}


def test_forests_merge_in_any_grouping():
    r = random.Random(7)
    sizes = {0: 1, 1: 100, 2: 513, mf.ROOT: 3}
    leaves = [(t, i, H(str(t), str(i))) for t in (0, 1, 2) for i in range(sizes[t])]

    def grown(part):
        f = mf.Forest()
        for t, i, h in part:
            f.sizes[t], f.sizes[mf.ROOT] = sizes[t], 3
            f.add(t, 0, i, h)
        return f

    whole = grown(leaves).root
    for _ in range(20):
        r.shuffle(leaves)
        cuts = sorted(r.sample(range(len(leaves)), 6))
        parts = [grown(leaves[a:b]) for a, b in zip([0, *cuts], [*cuts, len(leaves)])]
        while len(parts) > 1:
            i = r.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i].merge(parts[i + 1])]
        assert parts[0].root == whole and not parts[0].waiting
