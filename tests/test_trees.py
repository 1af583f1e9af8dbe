"""JSON leaves and block trees against plain recursion, beyond a million rows and at a hundred levels."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import pointers
from folioflow.operators import blocks


def nested(levels):
    text = "7"
    for i in range(levels):
        text = ('{"a/~\\"b":%s,"z":[]}' if i % 2 else '[null,%s,1.50,{"q":"x\\n\\u00e9"},{}]') % text
    return text


def leaves_of(text):
    out = []

    def walk(v, p):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, p + "/" + k.replace("~", "~0").replace("/", "~1"))
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{p}/{i}")
        else:
            kind = "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
            out.append((p or "/", kind, None if v is None else str(v).lower() if kind == "boolean" else v if kind == "string" else str(float(v))))

    try:
        walk(json.loads(text), "")
    except (TypeError, json.JSONDecodeError):
        pass
    return sorted(out, key=str)


def test_leaves_of_any_nesting(spark):
    texts = ['{"a":{"b":[1,{"c":null}]},"d":[],"e":"x"}', "5", "[[1.0,2],[]]", "nope", nested(100), None, "[[[[[[[[{}]]]]]]]]", "[[[[[[]]]]]]", nested(6), nested(7), "", '{"a":true,"b":[false]}']
    got = {}
    for r in pointers.leaves(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect():
        got.setdefault(r.k, []).append((r.pointer, r.kind, r.value))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: leaves_of(t) for k, t in enumerate(texts) if leaves_of(t)}


def test_two_frames_of_leaves(spark):
    one, two = (pointers.leaves(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t") for t in ('{"a":1}', '{"b":2}'))
    assert [r.pointer for r in one.unionByName(two).collect()] == ["/a", "/b"]


def test_two_million_leaves(spark):
    rows = spark.range(1_000_000).select(F.col("id").alias("k"), F.lit('{"a":1,"b":{"c":"x"}}').alias("t"))
    assert pointers.leaves(rows, "k", "t").count() == 2_000_000


@pytest.mark.parametrize("chunk", [50, 1 << 16])
def test_preorder(spark, monkeypatch, chunk):
    monkeypatch.setattr(blocks, "CHUNK_ROWS", chunk)
    random.seed(3)
    rows = []
    for doc in [*range(20), None]:
        n = random.randint(1, 40)
        rows += [(doc, random.randint(0, 1), f"b{i}", None if i == 0 or random.random() < 0.2 else f"b{random.randint(0, n)}", random.choice([1, 2, 3, None])) for i in range(n)]
    rows += [(99, 0, f"b{i}", None if i == 0 else f"b{i - 1}", 1) for i in range(300)]  # deeper than any page
    got = {(r.doc, r.page, r.block_id): (r.depth, r.number, r.position) for r in blocks.preorder(spark.createDataFrame(rows, "doc int, page int, block_id string, parent_id string, reading_order int"), ["doc", "page"]).collect()}
    want = {}
    for g in {r[:2] for r in rows}:
        children = {}
        for r in sorted((r for r in rows if r[:2] == g), key=lambda r: (r[4] is not None, r[4] or 0, r[2])):
            children.setdefault(r[3], []).append(r[2])
        place, stack = 0, [(c, 0, str(i)) for i, c in enumerate(children.get(None, []), 1)][::-1]
        while stack:
            block, depth, number = stack.pop()
            place += 1
            want[(*g, block)] = (depth, number, place)
            stack += [(c, depth + 1, f"{number}.{i}") for i, c in enumerate(children.get(block, []), 1)][::-1]
    assert got == want


def test_preorder_of_many_rows(spark):
    n = F.col("id") % 1000
    rows = spark.range(1_200_000).select((F.col("id") / 1000).cast("int").alias("doc"), F.col("id").alias("block_id"), F.when(n > 0, F.col("id") - n + ((n - 1) / 3).cast("int")).alias("parent_id"), F.col("id").alias("reading_order"))
    got = blocks.preorder(rows, ["doc"]).agg(F.count(F.lit(1)), F.max("position"), F.max("depth")).first()
    assert tuple(got) == (1_200_000, 1000, 6)
