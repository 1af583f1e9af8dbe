"""Hand-computed expectations and brute-force versions of the operators."""

import io
import random
import re
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.functions import geometry, pointers, text
from folioflow.operators import folds, joins, metrics, models, validate, windows
from folioflow.sources import formats, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_calibration_expectations(spark):
    d = spark.createDataFrame([("Invoice", "Invoice", 0.9), ("Invoice", "Report", 0.8), ("Report", "Report", 0.6)], "expected string, predicted string, confidence double")
    s = metrics.classification_summary(d).first()
    assert s.accuracy == pytest.approx(2 / 3) and s.macro_f1 == pytest.approx(2 / 3) and s.review_rate == pytest.approx(2 / 3) and s.auto_approved_accuracy == 1.0
    b = metrics.brier_ece(d).first()
    assert b.brier == pytest.approx(0.27) and b.ece == pytest.approx(13 / 30)
    assert rows(metrics.confusion(d)) == [("Invoice", "Invoice", 1), ("Invoice", "Report", 1), ("Report", "Report", 1)]


def test_bin_edges(spark):
    d = spark.createDataFrame([("a", "a", x) for x in (0.0, 0.1, 0.3, 0.9, 0.8999999999999999, 1.0)], "expected string, predicted string, confidence double")
    assert {r.bin: r.n for r in metrics.calibration_bins(d).collect()} == {0: 1, 1: 1, 3: 1, 8: 1, 9: 2}


def test_costs(spark):
    calls = spark.createDataFrame([("luna", 1_000_000, 250_000, 100_000, True), ("lite", 2_000_000, 0, 200_000, True), ("free", 500, 0, 100, True), ("gone", 1, 1, 1, False)], "model string, input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, telemetry_available boolean")
    prices = spark.createDataFrame([("luna", 0.2, 1.2, 0.02), ("lite", 0.3, 2.5, None)], "model string, input_rate double, output_rate double, cached_rate double")
    cost = metrics.usage_cost(calls, prices)
    assert sum(r.estimated_cost for r in cost.collect()) == pytest.approx(1.375)
    total = metrics.usage_with_total(cost, spark.createDataFrame([("luna", "Luna")], "model string, label string")).where("label = 'Total'").first()
    assert (total.input_tokens, total.cached_input_tokens, total.output_tokens) == (3_000_500, 250_000, 300_100)


def test_cost_per_page_gate(spark):
    rates = spark.createDataFrame([("luna", 2.0, 4.0)], "model string, input_per_million double, output_per_million double")
    usage = lambda *m: spark.createDataFrame([(x, 300, 100) for x in m], "model string, input_tokens bigint, output_tokens bigint")
    pages = spark.createDataFrame([(2,)], "pages int")
    assert metrics.cost_per_page(usage("luna"), rates, pages).first().cost_per_page == pytest.approx(0.0005)
    none = metrics.cost_per_page(usage("luna", "other"), rates, pages).first()
    assert none.cost_per_page is None and "other" in none.reason


def test_gate_fails_closed(spark):
    m = spark.createDataFrame([("/a", 0.84, True), ("/r", 0.14, True), ("/t", None, False)], "path string, value double, is_number boolean")
    b = spark.createDataFrame([("/a", 0.90, True), ("/r", 0.10, True)], "path string, value double, is_number boolean")
    rules = spark.createDataFrame([("acc", "/a", True, 0.85, None, 0.03), ("rev", "/r", False, None, 0.15, 0.03), ("txt", "/t", True, 0.0, None, None), ("gone", "/x", True, 0.0, None, None), ("base", "/t", True, None, None, 0.1)], "name string, path string, higher_is_better boolean, minimum double, maximum double, max_regression double")
    got = {r["name"]: r["reason"] for r in metrics.regression_gate(m, b, rules).collect()}
    assert got == {"acc": "absolute threshold and baseline regression failed", "rev": "baseline regression exceeded", "txt": "candidate metric is not numeric", "gone": "candidate metric is missing", "base": "candidate metric is not numeric"}


def test_order_tables_boxes_leaves(spark):
    g = spark.createDataFrame([("d", "title", 0), ("d", "left", 1), ("d", "right", 2)], "doc_id string, anchor string, pos int")
    r = metrics.reading_order(spark.createDataFrame([("d", "title", 0), ("d", "right", 1)], "doc_id string, anchor string, pos int"), g).first()
    assert r.pairwise_order_accuracy == 1.0 and r.anchor_coverage == pytest.approx(2 / 3)
    cell = "page int, ordinal int, row int, col int, text string, row_span int, col_span int"
    gold = spark.createDataFrame([(2, 1, 0, 0, "Item", 1, 1), (2, 1, 0, 1, "Count", 1, 1)], cell)
    cand = spark.createDataFrame([(2, 1, 0, 0, "Item", 1, 1, 0), (2, 1, 0, 1, "Count", 1, 1, 0), (2, 1, 0, 1, "Total", 1, 1, 1)], cell + ", seq int")
    t = metrics.table_cells(cand, gold).first()
    assert (t.matched_tables, t.table_coverage, t.cell_exact_accuracy) == (1, 1.0, 0.5)
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    gb = spark.createDataFrame([("a", (0.0, 0.0, 1.0, 1.0)), ("b", (0.0, 0.0, 0.5, 0.5)), ], f"id string, box {box}").withColumn("k", F.lit(1))
    cb = spark.createDataFrame([("a", (0.0, 0.0, 1.0, 1.0)), ("b", (0.0, 0.0, 0.25, 0.25))], f"id string, box {box}").withColumn("k", F.lit(1))
    i = joins.iou_recall(cb, gb, ["k"]).first()
    assert i.mean_iou == pytest.approx(0.625) and i.recall_at_half == 0.5
    doc = lambda s: pointers.leaves(spark.createDataFrame([(1, s)], "doc_id int, j string"), "doc_id", "j")
    f = metrics.leaf_scores(doc('{"amount":"2","ok":true,"extra":null}'), doc('{"amount":2,"ok":true}')).first()
    assert (f.exact_matches, f.f1) == (1, pytest.approx(0.4)) and f.precision == pytest.approx(1 / 3)
    assert rows(doc('{"a":[{"x~/":1.0},[]],"b":{}}')) == [(1, "/a/0/x~0~1", "number", "1.0")]


def test_text(spark):
    like = lambda a, b: text.ocr_similarity(F.lit(a), F.lit(b))
    r = one(spark, a=like("Invoice # 42", " invoice—42 "), b=like("total 100 usd", "total 900 usd"), c=like("", "--"), d=like("ﬁne ①", "FINE 1"))
    assert (r.a, r.b, r.c, r.d) == (1.0, pytest.approx(2 / 3), 1.0, 1.0)
    assert text.insertions("alpha beta invented".split(), "alpha beta".split()) == 1
    rng = random.Random(3)

    def slow(a, b, i=0, j=0):
        if i == len(a):
            return (len(b) - j, 0)
        if j == len(b):
            return (len(a) - i, len(a) - i)
        d, n = slow(a, b, i + 1, j)
        skip, same = slow(a, b, i, j + 1), slow(a, b, i + 1, j + 1)
        return min((skip[0] + 1, skip[1]), (d + 1, n + 1), (same[0] + (a[i] != b[j]), same[1]))

    for _ in range(60):
        a, b = [rng.choice("abc") for _ in range(rng.randrange(5))], [rng.choice("abc") for _ in range(rng.randrange(5))]
        assert (text.edit_distance(a, b), text.insertions(a, b)) == slow(a, b)
    r = one(spark, w=text.semantic_words(F.lit("Café-au  l’été DON'T")), c=text.critical_values(F.lit("See www.x.org, a@b.co; +1 (555) 010-9999 on 2024-01-02 for AB-12 and 12345.")), g=text.garbage_ratio(F.lit("ok ###")), s=text.ordered_subsequence(F.array(F.lit("a"), F.lit("c")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))), e=text.ordered_subsequence(F.array().cast("array<string>"), F.array(F.lit("a"))), m=text.multiset_coverage(F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "ab"))))
    assert list(r.w) == ["café-au", "l’été", "don't"] and {"www.x.org", "a@b.co", "2024-01-02", "ab-12", "12345"} <= set(r.c)
    assert r.g == pytest.approx(3 / 5) and r.s and not r.e and r.m == pytest.approx(0.666667)


@pytest.mark.parametrize(
    "said, value, cited",
    [("total (1,234.50)", "-1234.5", True), ("$ -3 left", "-3", True), ("12.5.6", "12.5", False), ("(-5)", "-5", False), ("(5", "5", True), ("- -5", "-5", False), ("a-5", "5", True), ("1,23", "1", False), ("1,2345", "1", False), ("12 000", "12", True), ("12,000.", "12000", True),
     ("about 1e3 m", "1000", True), ("€+7", "7", True), ("+7€", "7", True), ("5%", "5", True), ("v5", "5", False), ("9007199254740993", "9007199254740992", False), ("a \\|3\\|", "3", True), ("", "0", False), ("x", "x", False)],
)
def test_cited_numbers(spark, said, value, cited):
    assert one(spark, x=text.cites_number(F.lit(said), F.lit(value))).x is cited


def test_cited_booleans(spark):
    yes = ["| Paid | yes |", "Paid: Yes.", "**Paid**: __yes__", "YES", "*yes!*", "[x] a", "[✓]", "so True it is", "| a | b |\n|---|---|\n| ok | **yes** |"]
    no = ["Paid: No", "| Paid | no. |", "[ ] a", "it is false", "no", "**no**"]
    neither = ["no.", "yes sir", "| yes |", "| | yes |", ": yes", "| Paid | yes |\n| --- | :---: |", "**yes*", "untrue", "|", "", "yesterday: no way", "a:\nb"]
    got = spark.createDataFrame([(t,) for t in yes + no + neither], "t string").select("t", *[text.cites_boolean(F.col("t"), v).alias(str(v)) for v in (True, False)]).collect()
    assert [(r.t, r["True"], r["False"]) for r in got] == [(t, t in yes, t in no) for t in yes + no + neither]


def test_unicode_normal_forms(spark):
    odd = "  Cafe\u0301\u00a0ΣΑΣ\u2003Straße\u0130 \u212b\x1f"
    r = one(spark, n=text.normal(F.lit(odd)), f=text.folded(F.lit(odd)), w=text.semantic_words(F.lit(odd)), z=text.normal(F.lit(None).cast("string")))
    plain = " ".join(unicodedata.normalize("NFC", odd).split())
    assert r.n == plain and r.f == " ".join(odd.split()).casefold() and r.z is None
    assert list(r.w) == re.findall(r"\w+(?:[-'’]\w+)*", plain.casefold())


def test_token_distance(spark):
    rng = random.Random(5)
    rows = [([rng.choice("abcdeé") * rng.randint(1, 2) for _ in range(rng.randrange(9))], [rng.choice("abcdeé") * rng.randint(1, 2) for _ in range(rng.randrange(9))]) for _ in range(80)]
    rows.append(([str(i) for i in range(0, 3000, 3)], [str(i) for i in range(0, 500, 5)]))
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", text.token_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == text.edit_distance(list(r.a), list(r.b)) for r in got)


def test_section_paths_and_parents(spark):
    b = spark.createDataFrame([(1, 1, 1, "h1"), (1, 2, 3, "h3a"), (1, 3, 3, "h3b"), (1, 4, None, "p")], "d int, o int, level int, t string")
    assert [(r.o, list(r.section_path)) for r in windows.section_paths(b, ["d"], "o", "level", "t").orderBy("o").collect()] == [(1, []), (2, ["h1"]), (3, ["h1", "h3a"]), (4, ["h1", "h3a", "h3b"])]
    assert [r.parent for r in windows.heading_parents(b.where("level IS NOT NULL"), ["d"], "o", "level").orderBy("o").collect()] == [None, 1, 1]


def test_packing(spark):
    p = spark.createDataFrame([("d", i, s) for i, s in enumerate([10, 40, 60, 250, 5, 5, 5])], "d string, page int, size int")
    got = rows(folds.pack(p, "d", "page", "size", "split", max_pages=2, max_size=100))
    assert got == [("d", 0, 0, 0), ("d", 1, 0, 0), ("d", 2, 1, 0), ("d", 3, 2, 0), ("d", 3, 3, 1), ("d", 3, 4, 2), ("d", 3, 5, 3), ("d", 3, 6, 4), ("d", 4, 7, 0), ("d", 5, 7, 0), ("d", 6, 8, 0)]


def test_union_area(spark):
    boxes = {"none": [], "one": [(0, 0, 0.3, 0.3)], "two": [(0, 0, 0.4, 0.4), (0.2, 0.2, 0.6, 0.6)], "same": [(0, 0, 0.4, 0.4)] * 2, "flat": [(0.1, 0.1, 0.1, 0.9)], "strips": [(i / 1000, 0.1, i / 1000 + 1 / 2000, 0.9) for i in range(1000)]}
    d = spark.createDataFrame([(k, *map(float, b)) for k, v in boxes.items() for b in v], "k string, x0 double, y0 double, x1 double, y1 double")
    got = {r.k: r.union_area for r in folds.union_area(d, ["k"]).collect()}
    assert got == {"one": pytest.approx(0.09), "two": pytest.approx(0.28), "same": pytest.approx(0.16), "flat": 0, "strips": pytest.approx(0.4)}


def test_dedup_folds(spark):
    d = spark.createDataFrame([(1, 0, "a", 0.5, 0.0, 0.0, 0.5, 0.5), (1, 1, "b", 0.9, 0.0, 0.0, 0.5, 0.49), (1, 2, "c", 0.4, 0.6, 0.6, 0.9, 0.9)], "page int, idx int, label string, confidence double, x0 double, y0 double, x1 double, y1 double")
    assert [(r.idx, r.label) for r in folds.detector_dedup(d, ["page"]).orderBy("idx").collect()] == [(0, "b"), (2, "c")]
    assert sorted(r.label for r in folds.suppress(d, ["page"], ["confidence"]).collect()) == ["a", "c"]
    b = spark.createDataFrame([(1, "x", "p", 0, "same text", 0.0, 0.0, 0.5, 0.5, False, False, 0.4), (1, "y", "p", 0, "same text", 0.1, 0.0, 0.5, 0.5, False, True, None), (1, "z", "h", 0, "same text", 0.0, 0.0, 0.5, 0.5, False, False, 0.9)], "page int, id string, type string, reading_order int, fingerprint string, x0 double, y0 double, x1 double, y1 double, rejected boolean, verified boolean, confidence double")
    assert sorted(r.id for r in folds.block_dedup(b, ["page"]).collect()) == ["y", "z"]
    c = spark.createDataFrame([(1, 0, 0, 2, 1, "a"), (1, 0, 1, 1, 2, "b"), (1, 1, 0, 1, 1, "c"), (1, 1, 1, 1, 1, "d")], "t int, row int, seq int, row_span int, col_span int, text string")
    assert {r.text: r.column for r in folds.place_cells(c, ["t"]).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_cells_against_a_grid(spark):
    rng = random.Random(3)
    cells = [(t, r, i, rng.randrange(1, 4), rng.randrange(0, 3), f"{t}-{r}-{i}") for t in (None, *range(40)) for r in range(5) for i in range(rng.randrange(4))]
    taken, want = set(), {}
    for t, r, i, down, across, said in sorted(cells, key=lambda x: (str(x[0]), x[1], x[2])):
        column = next(c for c in range(99) if (t, r, c) not in taken)
        taken |= {(t, r + x, column + y) for x in range(down) for y in range(across)}
        want[said] = column
    rng.shuffle(cells)
    c = spark.createDataFrame(cells, "t int, row int, seq int, row_span int, col_span int, text string")
    assert {x.text: x.column for x in folds.place_cells(c, ["t"]).collect()} == want
    assert folds.place_cells(c.limit(0), ["t"]).count() == 0


def test_dense_form_order(spark):
    r = [("r1", 0.3, 0.02, 0.4, 0.05), ("l1", 0.02, 0.02, 0.2, 0.05), ("l2", 0.02, 0.06, 0.2, 0.08), ("r2", 0.3, 0.06, 0.4, 0.08), ("m", 0.01, 0.3, 0.05, 0.6), ("b", 0.1, 0.2, 0.9, 0.25), ("f", 0.1, 0.95, 0.9, 0.98)]
    d = spark.createDataFrame([(1, *x) for x in r], "page int, id string, x0 double, y0 double, x1 double, y1 double")
    assert [x.id for x in windows.dense_form_order(d, ["page"]).orderBy("position").collect()] == ["l1", "l2", "r1", "r2", "b", "m", "f"]


def test_interval_joins_against_loops(spark):
    rng = random.Random(5)
    a = [(rng.randrange(3), i, s, s + rng.randrange(1, 40)) for i in range(60) for s in [rng.randrange(200)]]
    b = [(rng.randrange(3), i, s, s + rng.randrange(1, 40)) for i in range(60) for s in [rng.randrange(200)]]
    got = rows(joins.overlap_join(spark.createDataFrame(a, "g int, id int, start bigint, end bigint"), spark.createDataFrame(b, "g int, other int, start2 bigint, end2 bigint"), ["g"], 16).select("g", "id", "other"))
    assert got == sorted(((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]), key=str)


def test_replacements_and_rebase(spark):
    t = spark.createDataFrame([(1, "abcdefgh"), (2, "x")], "d int, text string")
    e = spark.createDataFrame([(1, 1, 3, "ZZZZ"), (1, 5, 6, "")], "d int, start bigint, end bigint, new string")
    assert rows(joins.apply_replacements(t, e, ["d"])) == [(1, "aZZZZdegh"), (2, "x")]
    r = windows.rebase_spans(e.withColumn("new_length", F.length("new")), ["d"]).orderBy("start").collect()
    assert [(x.new_start, x.new_end) for x in r] == [(1, 5), (7, 7)]


def test_decisions(spark):
    b = spark.createDataFrame([(1, "a", "x", "needs_review"), (1, "b", "y", "needs_review"), (1, "c", "z", "needs_review"), (1, "d", "w", "verified")], "p int, id string, text string, status string")
    d = spark.createDataFrame([(1, "a", "accept", 0.9, None), (1, "b", "correct", 0.9, "Y"), (1, "c", "correct", 0.5, "Z")], "p int, id string, action string, confidence double, text string")
    assert {r.id: (r.text, r.status) for r in joins.apply_decisions(b, d, ["p"]).collect()} == {"a": ("x", "verified"), "b": ("Y", "corrected"), "c": ("z", "needs_review"), "d": ("w", "verified")}


def _archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="urn:w"'
FILES = {
    "/d/a.csv": "﻿a,b\nc\n".encode(),
    "/d/b.md": b"# Title\n\ntext\nmore\n\n| a | b |\n|---|---|\n| 1 | 2 |\n",
    "/d/c.html": b"<div><p>one <b>two</b><ul><li>x</ul><table><tr><td>t</td></tr></table><img src=i.png alt=pic></div>",
    "/d/d.docx": _archive({"[Content_Types].xml": "<a/>", "word/document.xml": f'<w:document {W}><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:t>c1</w:t></w:p></w:tc><w:tc><w:p><w:t>c2</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>', "word/media/x.png": b"p"}),
    "/d/e.xlsx": _archive({"[Content_Types].xml": "<a/>", "xl/workbook.xml": '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": "<sst><si><t>hey</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="B2" t="s"><v>0</v></c><c r="C3"><v>5</v></c></row></sheetData></worksheet>'}),
    "/d/f.ods": _archive({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": '<d xmlns:t="urn:t"><t:body><t:table t:name="T"><t:table-row><t:table-cell t:number-columns-repeated="2"/><t:table-cell t:number-columns-repeated="2"><t:p>v</t:p></t:table-cell></t:table-row></t:table></t:body></d>'}),
    "/d/g.epub": _archive({"mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item id="i" href="x.html"/><itemref idref="i"/></p>', "o/x.html": "<p>chapter</p>"}),
    "/d/h.pptx": _archive({"[Content_Types].xml": "<a/>", "ppt/presentation.xml": "<a/>", "ppt/slides/slide1.xml": "<s><sp><cNvPr id='7'/><p><t>point</t></p></sp></s>"}),
    "/d/i.odt": _archive({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": "<d><body><text><p>para</p></text></body></d>"}),
    "/d/bad.docx": b"no zip",
    "/d/fake.png": b"GIF89a",
}


def test_format_scans(spark):
    d = formats.scan(spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "path string, content binary"))
    got = {}
    for r in d.collect():
        got.setdefault(r.path, []).append((r.kind, r.type, r.text, r.anchor, r.error))
    rec = lambda p: [(x[1], x[2], x[3]) for x in got[p] if x[0] == "record"]
    assert rec("/d/a.csv") == [("table", "a b c", "rows[1:2]/columns[1:2]")]
    assert rec("/d/b.md") == [("text", "Title", "1:1-1:8"), ("text", "text\nmore", "3:1-4:5"), ("table", "a b 1 2", "/markdown/lines[6:8]")]
    assert rec("/d/c.html") == [("text", "x", "/div[1]/p[1]/ul[1]/li[1]"), ("table", "t", "/div[1]/p[1]/table[1]")]
    assert rec("/d/d.docx") == [("paragraph", "Hi", "/word/document/body/p[1]"), ("table", "c1 c2", "/word/document/body/tbl[1]")]
    assert rec("/d/e.xlsx") == [("table", "hey 5", "S!B2:C3")] and rec("/d/f.ods") == [("table", "v v", "T!C1:D1")]
    assert rec("/d/g.epub") == [("text", "chapter", "epub:x.html:/p[1]")]
    assert rec("/d/h.pptx") == [("text", "point", "/ppt/slides/slide[1]/shape[id=7]/paragraph[1]")] and rec("/d/i.odt")[0][1] == "para"
    assert "zip" in got["/d/bad.docx"][0][4].lower() and got["/d/fake.png"][0][0] == "error"
    assert {r.unit_kind: r.n_units for r in formats.unit_counts(d).where("path LIKE '%.xlsx'").collect()} == {"sheet": 1}


def test_schema_tools(spark):
    s = pointers.infer_schema({"total": 1.5, "lines": [{"name": "x", "n": 2}]})
    assert [tuple(r) for r in pointers.contract(spark, s).collect()] == [("field_0001", "/total", None, "number"), ("field_0002", "/lines/*/name", "/lines", "string"), ("field_0003", "/lines/*/n", "/lines", "integer")]
    assert pointers.compile_schema(s).simpleString() == "struct<total:double,lines:array<struct<name:string,n:bigint>>>" and pointers.skeleton(s) == {"total": None, "lines": []}
    with pytest.raises(ValueError):
        pointers.contract(spark, pointers.infer_schema({"a": [{"b": [1]}]}))
    assert pointers.schema_problems({"type": "object", "properties": {"a": {"type": "string"}}, "required": [], "additionalProperties": False})
    assert formats.schema_fields("# S\n- **name** (date): when\n- other: what")[0] == {"name": "name", "description": "when", "type": "date"}
    with pytest.raises(ValueError):
        formats.schema_fields("| Field name | Description |\n|---|---|\n| a | b |\n\n- c: d")


def test_sinks(spark, tmp_path):
    out = one(spark, s=sinks.safe_preview(F.lit("<table><script>x</script>&</table>")), c=text.checkbox_state(F.lit("☑ Yes:")), l=text.checkbox_label(F.lit("[x] Office Visit:")), cells=text.table_row_cells(F.lit("| a \\| b | c |")))
    assert out.s == "<table>&lt;script&gt;x&lt;/script&gt;&amp;</table>" and (out.c, out.l, list(out.cells)) == ("checked", "office visit", ["a \\| b", "c"])
    d = spark.createDataFrame([("d", "t")], "doc string, title string")
    e = spark.createDataFrame([("d", 1, 2, "b"), ("d", 1, 1, "a")], "doc string, page int, seq int, text string")
    assert sinks.envelope(d, e, "doc", "1.0").first().json == '{"schema_version":"1.0","doc":"d","title":"t","elements":[{"page":1,"seq":1,"text":"a"},{"page":1,"seq":2,"text":"b"}]}'
    sinks.write_archive(e, str(tmp_path / "o"), "doc")
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    st = spark.createDataFrame([("a", bytearray(b"x"), "bad", 1, "done", "r"), ("b", bytearray(b"x"), "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881", 1, "running", "r")], "id string, content binary, sha256 string, version int, status string, result string")
    assert {r.id: r.status for r in sinks.restore(st, 1).collect()} == {"a": "failed", "b": "pending"}


def test_annotations_and_progress(spark):
    kinds = ["title", "checkbox", "table", "chart", "formula", "seal", "signature", "paragraph"]
    e = spark.createDataFrame([("d", 1, k, i, 0.1, 0.2, 0.5, 0.5) for i, k in enumerate(kinds)] + [("d", 1, "table", 8, None, 0.2, 0.5, 0.5), ("d", 2, "table", 9, 0.1, 0.2, 0.5, 0.5)], "doc_id string, page int, type string, reading_order int, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([("d", 1, 200.0, 100.0)], "doc_id string, page int, width double, height double")
    got = sinks.annotations(e, p).orderBy("reading_order").collect()
    assert [r.label for r in got] == ["0", "Form 1", "Table 2", "Figure 3", "Formula 4", "Seal 5", "Signature 6", "7"]
    assert {(r.x0, r.y0, r.x1, r.y1) for r in got} == {(20.0, 20.0, 100.0, 50.0)}
    assert [r.label for r in sinks.annotations(e, p, False).orderBy("reading_order").collect()] == ["Title", "Form", "Table", "Figure", "Formula", "Seal", "Signature", "Text"]
    v = spark.createDataFrame([("layout", 0, 0, 1, 4), ("ocr", 1, 2, 1, 4), ("ocr", 0, 0, 0, 4), ("ocr", 1, 1, None, 4)], "stage string, current int, total int, page_position int, n_pages int")
    assert sorted((r.done, r.of) for r in models.region_progress(v).collect()) == [(50, 4000), (1025, 4000), (1525, 4000)]


def test_model_boundary(spark):
    def load():
        def model(row):
            if row["n"] == 2:
                raise RuntimeError("busy")
            return {"said": f"n{row['n']}"}

        return model

    got = rows(models.call(spark.createDataFrame([(1,), (2,)], "n int"), load, "said string"))
    assert got == [(1, "n1", None), (2, None, "RuntimeError: busy")]
    j = '{"parsing_res_list":[{"block_label":"text","block_content":"hi","block_bbox":[10,20,50,200],"block_order":1}]}'
    r = models.recognised_regions(spark.createDataFrame([(1, j, 100, 100)], "p int, j string, w int, h int"), ["p"], "j", "w", "h").first()
    assert (r.content, r.x0, r.y1) == ("hi", 0.1, 1.0)
    c = spark.createDataFrame([("d", 1, "a", 0.1, "total 100 usd"), ("d", 1, "b", 0.2, "x")], "doc string, page int, id string, confidence double, text string")
    o = spark.createDataFrame([("d", 1, "a", 0, "nope"), ("d", 1, "a", 1, "total 100 usd")], "doc string, page int, id string, other_index int, other_text string")
    assert {x.id: x.outcome for x in models.cross_check(c, o, ["doc"], text.ocr_similarity).collect()} == {"a": "agreed", "b": "unavailable"}


def test_native_integrity(spark):
    e = spark.createDataFrame([("d", "e1", "u1"), ("d", "e1", "u1"), ("d", "e2", "ux")], "doc_id string, id string, unit_id string")
    s = spark.createDataFrame([("d", "s1", 0, 4), ("d", "s2", 2, 99)], "doc_id string, id string, start int, end int")
    u, t = spark.createDataFrame([("d", "u1")], "doc_id string, unit_id string"), spark.createDataFrame([("d", "text")], "doc_id string, base_text string")
    assert rows(validate.native_document(e, s, u, t).select("id", "rule")) == [("e1", "repeated id"), ("e2", "unknown unit"), ("s2", "span outside text")]


def test_geometry(spark):
    b = geometry.ordered_unit_box(F.lit(900.0), F.lit(100.0), F.lit(100.0), F.lit(1200.0))
    r = one(spark, b=b, p=geometry.crop_pixels(geometry.box(F.lit(0.1), F.lit(0.1), F.lit(0.5), F.lit(0.5)), F.lit(100), F.lit(200), 0.0))
    assert tuple(r.b) == (0.1, 0.1, 0.9, 1.0) and tuple(r.p) == (10, 20, 50, 100)


def test_streaming_ledger(spark, tmp_path):
    from folioflow.streaming import jobs

    calls = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("b", 5, 6)], "model string, input_tokens bigint, output_tokens bigint")
    calls.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    q = jobs.usage_ledger(stream).writeStream.format("memory").queryName("ledger").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("ledger")) == [("a", 2, 4, 6), ("b", 1, 5, 6)]


def test_streaming_ingest(spark, tmp_path):
    from folioflow.streaming import jobs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("one")
    (tmp_path / "in" / "b.md").write_text("one")
    (tmp_path / "in" / "c.md").write_text("two")
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(str(tmp_path / "in"))
    q = jobs.ingest(files, lambda b: formats.scan(b), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).where("kind = 'record'").collect()) == ["one", "two"]


def test_union_area_of_many_groups(spark):
    """groups are cut out of a stream of batches, whichever batch they end in; no group is a call of its own."""
    rows = [(k if k else None, "a" if k % 2 else "b", 0.0, 0.0, (i + 1) / (k % 7 + 1), 1.0) for k in range(300) for i in range(k % 7 + 1)] + [(1000, "a", i / 2500, 0.0, (i + 1) / 2500, 0.5) for i in range(2500)] + [(1001, "a", None, 0.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "k int, g string, x0 double, y0 double, x1 double, y1 double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        area = folds.union_area(d, ["g", "k"])
        assert "FlatMapGroups" not in area._jdf.queryExecution().sparkPlan().toString()
        got = sorted((str(r.k), r.g, round(r.union_area, 9)) for r in area.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted([(str(k if k else None), "a" if k % 2 else "b", 1.0) for k in range(300)] + [("1000", "a", 0.5), ("1001", "a", 0.0)])


def test_similarities_hold_one_row_at_a_time():
    """the functions get Arrow arrays, so that no batch of texts or tokens becomes Python objects as a whole."""
    from pyspark.util import PythonEvalType

    assert {text._spelled.evalType, text.ratio.evalType} == {PythonEvalType.SQL_SCALAR_ARROW_UDF}


def test_merged_intervals_of_nulls_and_ties(spark, tmp_path):
    """as its SQL has them where intervals differ: nulls stand last, and each interval without a start is a run of its own. Equal intervals change nothing."""
    import duckdb

    from folioflow.plans import catalog

    events = [(i if i % 9 else None, i % 3, None if i % 5 == 0 else i * 37 % 300 / 2) for i in range(300)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = catalog.QUERIES["merged_intervals"](spark, str(tmp_path)).select("doc_id", "island", "start", "end")
    assert rows(found) == sorted(con.execute(catalog.ORACLES["merged_intervals"]).fetchall(), key=str)
    spans = spark.createDataFrame([(i % 3, i * 7 % 50, i * 7 % 50 + i % 4 + 1) for i in range(60)], "doc_id bigint, start bigint, end bigint")
    once, often = (joins.merged_intervals(s, ["doc_id"]) for s in (spans, spans.crossJoin(spark.range(20)).drop("id")))
    assert rows(once) == rows(often) and often._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Sort [") == 1
