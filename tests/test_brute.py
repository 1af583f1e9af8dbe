"""Queries that SQL cannot express against plain Python on the same tables, and region operators by hand."""

import difflib
import html
import random
import re
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import pointers, text
from folioflow.operators import blocks, folds, joins, metrics, regions
from folioflow.plans import catalog

from .conftest import SMALL


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet").collect()


def got(spark, name):
    return catalog.QUERIES[name](spark, SMALL).collect()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def fewest_insertions(candidate, reference):
    row = [(j, 0) for j in range(len(reference) + 1)]
    for i, x in enumerate(candidate, 1):
        before, row = row, [(i, i)]
        for j, y in enumerate(reference, 1):
            row.append(min((before[j][0] + 1, before[j][1] + 1), (row[-1][0] + 1, row[-1][1]), (before[j - 1][0] + (x != y), before[j - 1][1])))
    return row[-1][1]


def test_word_accuracy(spark):
    words = lambda t: re.findall(r"\w+(?:[-'’]\w+)*", unicodedata.normalize("NFC", t).casefold())
    w = {r.item_id: words(r.text) for r in table(spark, "benchmark")}
    rows = got(spark, "word_accuracy")
    assert {r.item_id for r in rows} == {i for i in w if i - 1 in w}
    for r in rows[:40]:
        a, b = w[r.item_id], w[r.item_id - 1]
        assert (r.d, r.insertions) == (distance(a, b), fewest_insertions(a, b)) and r.word_accuracy == pytest.approx(max(0, 1 - r.d / len(b)))


def test_ocr_similarity(spark):
    said = {(r.conv_id, r.turn): r.text for r in table(spark, "conversations")}
    plain = lambda t: re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t).casefold())
    for r in got(spark, "ocr_similarity"):
        a, b = said[r.conv_id, r.turn], said[r.conv_id, r.turn + 1]
        x, y = plain(a), plain(b)
        assert r.similarity == pytest.approx(1 - distance(x, y) / max(len(x), len(y)) if x or y else 1.0)
        assert r.ratio == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())


def test_critical_values(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents")}
    for r in got(spark, "critical_values"):
        found = [m.group(0) for p in text.CRITICAL for m in re.finditer(p, texts[r.doc_id], re.ASCII)]
        assert list(r["values"]) == sorted({v.lower().rstrip(".,;:") for v in found})


def test_garbage_ratio(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents")}
    for r in got(spark, "garbage_ratio"):
        t = texts[r.doc_id]
        visible = len(re.sub(r"[ \t\n\x0b\f\r]", "", t))
        marks = sum(t.count(m) for m in text.MOJIBAKE) + sum(unicodedata.category(c)[0] == "C" and c not in "\t\n\x0b\f\r" for c in t)
        runs = sum(len(m[0]) for m in re.finditer(text.NOISE_RUN, t, re.ASCII))
        assert r.garbage == pytest.approx(min(1.0, (marks + runs) / visible) if visible else 0.0)


def boxes(spark):
    out = {}
    for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect():
        e = [(min(max(round(float(v), 4), -1.0), 1.0) + 1) / 2 for v in r.embedding[:5]]
        out.setdefault(r.vec_id // 50, []).append((r.vec_id, r.label, min(e[0], e[1]), min(e[2], e[3]), max(e[0], e[1]), max(e[2], e[3]), e[4]))
    return out


def shares(a, b):
    size = lambda x: (x[4] - x[2]) * (x[5] - x[3])
    inter = max(min(a[4], b[4]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0)
    union, small = size(a) + size(b) - inter, min(size(a), size(b))
    return inter / union if union else 0, inter / small if small else 0


def test_detector_dedup(spark):
    want = set()
    for page, found in boxes(spark).items():
        kept = []
        for b in found:
            k = next((k for k, o in enumerate(kept) if shares(b, o[1])[1] >= 0.9), None)
            if k is None:
                kept.append((b[0], b))
            elif b[6] > kept[k][1][6]:
                kept[k] = (kept[k][0], b)
        want |= {(page, i, b[1], round(b[6], 9)) for i, b in kept}
    assert {(r.page, r.idx, r.label, round(r.confidence, 9)) for r in got(spark, "detector_dedup")} == want


def test_recovery_suppression(spark):
    want = set()
    for page, found in boxes(spark).items():
        kept = []
        for b in sorted(found, key=lambda b: (b[1], b[0])):
            if not any(s[0] >= 0.5 or s[1] >= 0.85 for s in (shares(b, o) for o in kept)):
                kept.append(b)
        want |= {(page, b[0]) for b in kept}
    assert {(r.page, r.vec_id) for r in got(spark, "recovery_suppression")} == want


def test_context_packing(spark):
    want, sizes = set(), {}
    for r in table(spark, "conversations"):
        sizes.setdefault(r.conv_id, []).append((r.turn, len(r.text or "") * 40))
    for conv, turns in sizes.items():
        context, open_ = -1, []
        for turn, size in sorted(turns):
            if size > 48_000:
                for part in range(-(-size // 24_000)):
                    context += 1
                    want.add((conv, turn, context, part))
                open_ = []
                continue
            if not open_ or len(open_) == 8 or sum(open_) + size > 48_000:
                context, open_ = context + 1, []
            open_.append(size)
            want.add((conv, turn, context, 0))
    assert {tuple(r) for r in got(spark, "context_packing")} == want


def test_html_grid(spark):
    source = "<table><tr><th rowspan=2>A</th><td colspan='2'>B<br>c</td></tr><tr><td>D</td><td rowspan=x>E &amp; F</td></tr></table>"
    odd = "<tr><td colspan='²' rowspan=0>a</td><TD rowspan='3000000'>b<td>never closed<tr><td>in an open row<tr><td COLSPAN = \"+2\">&eacute;<!-- no --><i>x</i></TD ></tr ><td>stray</td>"
    rows = regions.html_grid(spark.createDataFrame([(1, source), (2, None), (3, "<td>q</td>"), (4, odd)], "k int, h string"), "k", "h").collect()
    assert {(r.k, r.row, r.column, r.row_span, r.col_span, r.text, r.header) for r in rows} == {(1, 0, 0, 2, 1, "A", True), (1, 0, 1, 1, 2, "B c", False), (1, 1, 1, 1, 1, "D", False), (1, 1, 2, 1, 1, "E & F", False), (4, 0, 0, 1, 2, "éx", False)}


def test_cells_are_placed_as_they_are_cut(spark):
    """one pass over the tables, no shuffle of their cells; a row is a table of its own, and a long one is cut once."""
    one = "<tr><td rowspan=2>a<td>never closed</td></tr><tr><th \nrowspan = ' +1 '>b<!-- <br> -->&lt;i></th></tr>"
    d = spark.createDataFrame([(1, one), (1, one), (2, "<tr>" * 20_000 + "<tr><td>c" + "<" * 20_000 + "</td></tr>")], "k int, h string")
    grid = regions.html_grid(d, "k", "h")
    assert "Exchange" not in grid._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, r.row, r.column, r.header, r.text) for r in grid.collect()) == [(1, 0, 0, False, "never closed")] * 2 + [(1, 1, 0, True, "b<i>")] * 2 + [(2, 0, 0, False, "c" + "<" * 20_000)]
    assert regions.html_cells(d, "k", "h").dtypes == [("k", "int"), ("row", "bigint"), ("seq", "int"), ("row_span", "bigint"), ("col_span", "bigint"), ("header", "boolean"), ("text", "string")]


def test_spans_of_any_size_are_one_interval(spark):
    c = spark.createDataFrame([(1, r, 0, 10_000_000, 3_000_000, f"{r}") for r in range(300)], "t int, row int, seq int, row_span int, col_span int, text string")
    assert sorted(r.column for r in folds.place_cells(c, ["t"]).collect()) == [3_000_000 * r for r in range(300)]


def test_markers_fragments_and_literals(spark):
    one = lambda expr: spark.range(1).select(expr).first()[0]
    item = lambda body, marker: one(regions.without_marker(F.lit(body), F.lit("list_item"), F.lit(marker)))
    assert item("step a) Step A)  rest", "step a)") == "rest" and item("\t1) x", "1)") == "\t1) x" and item("1) 1)x", "1)") == "1)x" and item("a.b c", "a?b") == "a.b c" and item("\\E1 x", "\\E1") == "x" and item("- ", "-") == ""
    assert one(regions.has_marker(F.lit("\t (a) b"), F.lit("(A)"))) and one(regions.has_marker(F.lit("\u2003(a)"), F.lit("(a)"))) and not one(regions.has_marker(F.lit("(a)b"), F.lit("(a)")))
    none = [F.lit(None).cast(t) for t in ("struct<label:string,value:string,hint:string>", "struct<state:string,group:string,option:string>", "array<string>", "string")]
    cells = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(t).alias("text")) for r, c, t in ((0, 0, "c\n"), (0, 1, "a\r\nb"), (1, 0, "x"))])
    said = lambda body: one(regions.fragments(F.lit("table"), F.lit(body), cells, *none))
    assert said("") == ["c", "a  b", "x"] and said("x\nx\n| c | a b|\n c\nnew | x\n\n") == ["c", "a  b", "x", "new | x"]
    form = F.struct(F.lit("Name:").alias("label"), F.lit("Ann").alias("value"), F.lit(None).cast("string").alias("hint"))
    filled = one(regions.fragments(F.lit("form_field"), F.lit("Name: Ann\nName: Ann\nName: Ann\nsigned\nsigned"), F.lit(None).cast("array<struct<row:int,col:int,text:string>>"), form, *none[1:]))
    assert filled == ["Name", "Ann", "Name: Ann", "signed"]
    number = lambda s, kind="integer": one(pointers.coerce(F.lit(s), kind))
    assert number("1234567890123456789") == 1234567890123456789 and number("-9223372036854775808") == -(2**63) and number("9223372036854775808") is None and number("1\n") is None and number("+7") == 7 and number("1e400", "number") == float("inf")
    same = [one(F.sha2(pointers.canonical_json(F.lit(t)), 256)) for t in ('{"a":1,"b":[1.0,null]}', ' {"b" : [1, null], "a": 1.00}', '{"a":1,"b":[1]}', '{"a":1}')]
    assert same[0] == same[1] and len(set(same)) == 3
    f = lambda text_: one(pointers.fingerprint(F.from_json(F.lit(text_), "a int, b int")))
    assert f('{"a":1}') == f('{"b":null,"a":1}') and one(pointers.canonical_json(F.lit('{"x":"1.0","y":"q\\"2.0,"}'))) == '{"x":"1.0","y":"q\\"2.0,"}'


def test_lines_of_long_tables_are_read_once(spark):
    """F8: time grows with the lines of a table, not with their square; cells without a row, a text or a struct say no row."""
    n = 30_000
    d = spark.createDataFrame([(1, "\n".join(f"| a{i} | b |\nx{i}" for i in range(n)), [(i, 0, f"a{i}") for i in range(n)] + [(i, 1, "b") for i in range(n)]), (2, "a\n b \n| b|c\n|\n\u2003\nb", [(None, 1, "b"), (0, 1, "c"), (0, 0, "b"), (None, None, None), None]), (3, None, []), (4, None, [(0, 0, "q")])], "k int, body string, cells array<struct<row:int,col:int,text:string>>")
    none = [F.lit(None).cast(t) for t in ("struct<label:string,value:string,hint:string>", "struct<state:string,group:string,option:string>", "array<string>", "string")]
    began = time.monotonic()
    got = {r.k: r.said for r in d.select("k", regions.fragments(F.lit("table"), F.col("body"), F.col("cells"), *none).alias("said")).collect()}
    assert time.monotonic() - began < 60
    assert got == {1: [*(f"a{i}" for i in range(n)), "b", *(f"x{i}" for i in range(n))], 2: ["b", "c", "a"], 3: [], 4: ["q"]}


def test_processed_page(spark):
    cols = "page int, id string, type string, text string, status string, evidence_ref string, reading_order int, fingerprint string, x0 double, y0 double, x1 double, y1 double, confidence double"
    row = lambda p, i, s, n: (p, i, "paragraph", "old", s, "e", n, f"f{n}", 0.1, 0.1, 0.5, 0.2, 0.5)
    blocks = spark.createDataFrame([row(1, "a", "needs_review", 1), row(1, "b", "verified", 2), row(1, "c", "verified", 2), row(2, "a", "needs_review", 1)], cols)
    decisions = spark.createDataFrame([(1, "a", "e", "correct", 0.9, "new"), (2, "a", "other", "accept", 0.9, None)], "page int, id string, evidence_ref string, action string, confidence double, text string")
    assert {(r.page, r.id, r.text, r.status) for r in regions.processed_page(blocks, decisions, ["page"]).collect()} == {(1, "a", "new", "corrected"), (1, "b", "old", "verified"), (2, "a", "old", "needs_review")}


def test_thresholds():
    assert regions.Thresholds.of({"FOLIOFLOW_SKEW_DEGREES": "2.5"}).skew_degrees == 2.5
    for bad in ({"visual_area_ratio": 1.1}, {"skew_degrees": -1.0}, {"complex_region_count": 0}):
        with pytest.raises(ValueError):
            regions.Thresholds(**bad)


def test_markers(spark):
    f = lambda b, m="1)": regions.without_marker(F.lit(b), F.lit("list_item"), F.lit(m))
    r = spark.range(1).select(f("1) 1)  a  b").alias("a"), f("1)a").alias("b"), f("1)").alias("c"), f("A. a. x", "a.").alias("d"), f("x", "").alias("e")).first()
    assert tuple(r) == ("a  b", "1)a", "", "x", "x")


def test_long_rows_take_linear_time(spark):
    """20,000 words, anchors and levels in seconds each."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(15_000)}" for _ in range(20_000)]
    other = rng.sample(words, len(words))
    df = spark.createDataFrame([(words, other[:18_000]), (None, ["a"]), ([], ["a"]), (["a", "a"], None)], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(text.multiset_coverage("a", "b")).collect()] == [0.9, 1.0, 1.0, 0.0]
    short = spark.createDataFrame([(words[:4000], words[:3990]), (["😀", "b"], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in short.select(text.token_distance(F.col("a"), F.col("b"))).collect()] == [10, 1]
    values = np.array([rng.randrange(300) for _ in range(3000)])
    assert metrics.ordered_pairs(values) == sum(int((values[i + 1 :] > values[i]).sum()) for i in range(len(values))) and metrics.ordered_pairs(values[:0]) == 0
    gold = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("anchor"), F.col("id").alias("pos"))
    turned = gold.select("doc_id", "anchor", (F.lit(20_000) - F.col("pos")).alias("pos"))
    assert metrics.reading_order(turned, gold).first().pairwise_order_accuracy == 0.0
    chain = spark.range(80_000).select(F.lit(1).alias("d"), F.col("id").cast("string").alias("block_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"), F.lit(0).alias("reading_order"))
    deep = blocks.preorder(chain, ["d"], numbers=False).agg(F.max("depth").alias("d"), F.count("number").alias("n")).first()
    assert (deep.d, deep.n) == (79_999, 0)


def test_anchors_against_every_pair(spark):
    rng = random.Random(4)
    said = lambda n: " ".join(rng.choice(["ab", "abc", "é b", "zz", "a"]) for _ in range(n))
    b = [(d, i, i % 3, i, said(9)) for d in range(5) for i in range(12)] + [(9, 1, 0, 0, ""), (9, 2, 0, 1, None)]
    a = [(d, i, said(rng.choice([1, 2, 3, 4]))[rng.randrange(2) :]) for d in (*range(5), 9, 11) for i in range(15)] + [(0, 99, ""), (0, 98, None), (1, 97, "z z")]
    got = {(r.doc_id, r.anchor_id): r.block_id for r in joins.claimed_anchors(spark.createDataFrame(b, "doc_id int, block_id int, page int, reading_order int, text string"), spark.createDataFrame(a, "doc_id int, anchor_id int, anchor_text string"), ["doc_id"]).collect()}
    want = {}
    for d, i, anchor in a:
        held = sorted((x[2], x[3], x[1]) for x in b if x[0] == d and x[4] is not None and anchor is not None and anchor in x[4])
        if held:
            want[d, i] = held[0][2]
    assert got == want


VOID = set("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = {"p", "li", "pre", "table", *(f"h{i}" for i in range(1, 7))}


def brute_blocks(source: str):
    """(type, text, path) of leaf blocks by marks of a pattern: (start, end, tag, path) of each element first, then those without a block inside."""
    stack, found, said = [("", "", {})], [], []
    for m in re.finditer(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-z][a-z0-9]*)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", source):
        if m[3]:
            tag = m[3].lower()
            if m[2]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        for t, path, info in stack[k:]:
                            info["end"] = len(said)
                        del stack[k:]
                        break
                continue
            seen = stack[-1][2].setdefault("seen", {})
            seen[tag] = seen.get(tag, 0) + 1
            node = (tag, f"{stack[-1][1]}/{tag}[{seen[tag]}]", {"start": len(said), "end": None})
            found.append(node)
            if tag in VOID:
                node[2]["end"] = len(said)
            else:
                stack.append(node)
        elif m[1]:
            seen = stack[-1][2].setdefault("seen", {})
            seen[m[1].lower()] = seen.get(m[1].lower(), 0) + 1
        elif not m[0].startswith("<!"):
            said.append(html.unescape(m[0]).strip())
    out = []
    for tag, path, info in found:
        if tag in LEAVES and (tag == "table" or not any(p.startswith(path + "/") and t in LEAVES for t, p, _ in found)):
            text_ = " ".join(x for x in said[info["start"] : len(said) if info["end"] is None else info["end"]] if x)
            if text_:
                out.append(("table" if tag == "table" else "text", text_, path))
    return out


def test_blocks_and_headings_of_pages(spark):
    want = {(r.page_id, n, *b) for r in table(spark, "pages") for n, b in enumerate(brute_blocks(r.html or ""), 1)}
    assert {(r.page_id, r.seq, r.type, r.text, r.path) for r in catalog.QUERIES["html_blocks"](spark, SMALL).collect()} == want
    heads = {}
    for page, seq, _, _, path in sorted(want, key=lambda x: (x[0], x[1])):
        m = re.search(r"/h([1-6])\[\d+\]$", path)
        if m:
            heads.setdefault(page, []).append((seq, int(m[1])))
    parents = {(page, s, level, max((t for t, l in own if t < s and l < level), default=None)) for page, own in heads.items() for s, level in own}
    assert {(r.page_id, r.seq, r.level, r.parent) for r in catalog.QUERIES["html_heading_parents"](spark, SMALL).collect()} == parents


def test_retrieval_against_every_element(spark):
    question = "the order of the pages"
    terms = sorted(set(re.findall(r"[\w-]{2,}", question)))
    by = {}
    for r in table(spark, "conversations"):
        by.setdefault(r.conv_id, []).append(r)
    want = set()
    for conv, turns in by.items():
        scored = []
        for r in turns:
            t = (r.text or "").casefold()
            score = 10 * sum(x in t for x in terms) + difflib.SequenceMatcher(None, question, t[:500]).ratio() + (0.25 if r.role == "system" else 0)
            scored.append((-score, -r.turn))
        best = {-n for _, n in sorted(scored)[:3]}
        used = 0
        for r in sorted(turns, key=lambda r: r.turn):
            if best & {r.turn - 1, r.turn, r.turn + 1}:
                used += 2 * len(r.text) + 64
                if used <= 48_000:
                    want.add((conv, r.turn))
    assert {(r.conv_id, r.idx) for r in catalog.QUERIES["lexical_retrieval"](spark, SMALL).collect()} == want
