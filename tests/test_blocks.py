"""Predicates, quality and assembly of blocks; client policy."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import geometry
from folioflow.operators import blocks, clients
from folioflow.sources import formats


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_native_document_offsets(spark):
    files = spark.createDataFrame([("/x/a.md", bytearray(b"# Head\n\nbody text\n\n| a |\n|---|\n| b |"))], "path string, content binary")
    native = blocks.native_document(formats.scan(files))
    base = blocks.base_text(native).first().base_text
    assert base == "Head\nbody text\na b"
    assert all(base[r.start : r.end] == r.text for r in native.collect())


def test_risks_and_verification(spark):
    b = spark.createDataFrame([("t", "table", "rejected", 0.5, ["a", ""]), ("p", "paragraph", "rejected", 0.5, None), ("u", "checkbox", "verified", None, None)], "id string, type string, status string, confidence double, cells array<string>")
    bad = blocks.incomplete(F.col("cells"), F.lit("x"), F.lit("o"))
    box = geometry.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    got = {r.id: (list(r.risks), r.repair, r.verify) for r in b.select("id", blocks.repair_risks(bad, box, F.array(F.lit("Ambiguous digit"))).alias("risks"), blocks.needs_verification().alias("verify")).withColumn("repair", blocks.requires_repair(F.col("risks"))).collect()}
    assert got == {"t": (["rejected", "structure", "confidence", "degraded"], True, True), "p": ([], False, True), "u": (["degraded"], True, False)}


def test_probes(spark):
    d = spark.createDataFrame([(1, "figure", "", "verified", (0.0, 0.0, 0.5, 0.5)), (1, "figure", "cap", "verified", (0.0, 0.0, 0.5, 0.5)), (1, "image", "", "rejected", (0.0, 0.0, 0.9, 0.9))], "page int, type string, text string, status string, box struct<x0:double,y0:double,x1:double,y1:double>")
    c = spark.createDataFrame([(1, 0.6), (2, 0.9)], "page int, covered double")
    assert sorted((r.page, r.reason) for r in blocks.scan_probes(d, c, ["page"]).collect()) == [(1, "interior"), (1, "visual")]


def test_small_expressions(spark):
    r = spark.range(1).select(
        blocks.semantic_text(F.lit(" a  b "), F.lit(None).cast("string"), F.lit(""), F.lit("c")).alias("s"), blocks.route_key(F.lit("1:native, 2:ocr")).alias("k"), blocks.route_key(F.lit("1:native,x")).alias("n"),
        blocks.subset_pages(F.lit("a<!-- PAGE BREAK -->b<!-- PAGE BREAK -->c"), F.array(F.lit(3), F.lit(1))).alias("p"), F.size(blocks.history_tail(F.sequence(F.lit(1), F.lit(20)))).alias("h"), F.size(blocks.history_tail(F.sequence(F.lit(1), F.lit(3)))).alias("g"),
        blocks.redundant(F.lit("total 5"), F.lit("the total is 5 now")).alias("r"), blocks.conflicts(F.lit("total is 99999"), F.array(F.lit("total is"))).alias("c"),
        blocks.reference_basis(F.lit(None).cast("string"), F.lit("source_verified"), F.lit(False), F.lit(True)).alias("b"),
        blocks.scan_quality(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.when(i == 255, 1000).otherwise(0)), F.lit(500.0)).alias("q"),
        blocks.aggregated_confidence(F.lit(None).cast("double"), F.array(F.lit(0.7), F.lit(None), F.lit(0.4))).alias("a"),
    ).first()
    assert (r.s, r.k, r.n, r.p, r.h, r.g, r.r, r.c, r.b, list(r.q), r.a) == ("a b c", {1: "native", 2: "ocr"}, None, "c<!-- PAGE BREAK -->a", 16, 3, True, True, "source_verified", ["blank", "low contrast"], 0.4)


def test_page_metrics(spark):
    p = spark.createDataFrame([("d", "Alpha page", "alpha page"), ("d", "Beta x", "beta page")], "doc string, candidate string, reference string")
    r = blocks.page_accuracy(p, ["doc"]).first()
    assert (r.word_accuracy, r.word_error_rate, r.page_count) == (0.75, 0.25, 2)
    h = spark.createDataFrame([("d", "alpha beta invented", "alpha beta", ["invented", "secret"], ["r1", "r2"], ["r1", "kept"])], "doc string, candidate string, reference string, forbidden array<string>, rejected array<string>, accepted array<string>")
    x = blocks.hallucination(h, "doc").first()
    assert (x.word_insertions, x.forbidden_literal_count, x.false_accept_count, x.false_accept_rate) == (1, 1, 1, 0.5) and x.hallucination_rate == pytest.approx(1 / 3)
    q = spark.createDataFrame([("d", 1, "rejected", 0.5, False, None), ("d", 1, "verified", 1.0, True, "b")], "doc string, page int, status string, coverage double, bad_structure boolean, box string")
    y = blocks.page_quality(q, ["doc", "page"]).first()
    assert y.semantic_coverage == 0.75 and list(y.reasons) == ["rejected_content", "incomplete_structure", "semantic_coverage_loss", "geometry_loss"]


def test_recovery_content_and_toc(spark):
    r = spark.createDataFrame([(1, 0, "text", "a"), (1, 1, "Table", "<t>"), (1, 2, "table", "<tt>"), (2, 0, "text", "x"), (2, 1, "text", " "), (2, 2, "text", "y")], "p int, idx int, label string, content string")
    assert rows(blocks.recovery_content(r, ["p"])) == [(1, "<tt>"), (2, "x\ny")]
    s = spark.createDataFrame([("d", "e1", "Intro", 1, 1, 0, 0), ("d", "e1", "INTRO", 1, 1, 0, 1), ("d", "e2", "Sub", 2, 1, 1, 2), ("d", "e3", "Late", 1, 1, None, 3)], "doc string, element_id string, title string, level int, page int, order int, seq int")
    assert [(x.title, x.parent) for x in blocks.toc(s, ["doc"]).orderBy("n").collect()] == [("Intro", None), ("Sub", 1), ("Late", None)]


def test_client_policy():
    now, slept = [0.0], []
    limiter = clients.Limiter(8, clock=lambda: now[0])
    answers = [clients.Throttled("3"), clients.Throttled(), "ok"]

    def f():
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    budget = [10]
    assert clients.call_with_policy(f, limiter, budget, sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)), draw=lambda: 0.5) == "ok"
    assert limiter.limit == 2 and budget == [7] and slept[0] == 3.0 and limiter.counters == {"calls": 3, "retries": 2, "throttled": 2}
    for _ in range(9):
        limiter.succeeded()
    assert limiter.limit == 3
    with pytest.raises(clients.BudgetSpent):
        clients.call_with_policy(lambda: 1, limiter, [0])
    assert clients.wait_asked("Thu, 01 Jan 1970 00:00:10 GMT", 4.0) == 6.0 and clients.wait_asked("soon", 0) == 0.0


def test_scan_quality_reads_its_histogram_once(spark):
    """the histogram is one expression of the plan, and pages as the plain sums judge them."""
    rows = [[1] * 256, [0] * 100 + [7] + [0] * 149 + [96] + [0] * 5, [5] + [0] * 255, [0] * 30 + [50] + [0] * 60 + [50] + [0] * 164]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, h array<int>")
    made = F.transform("h", lambda x: x * 2)
    judged = df.select("k", blocks.scan_quality(made, F.lit(500.0)).alias("q"))
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("transform(h#") == 1

    def plain(h):
        total, level = sum(h) * 2, {}
        for q in (0.05, 0.95):
            level[q] = sum(1 for i in range(256) if 2 * sum(h[: i + 1]) < total * q)
        return (["blank"] if sum(h[:245]) * 2 / total <= 0.005 else []) + (["low contrast"] if level[0.95] - level[0.05] < 40 else [])

    assert {r.k: list(r.q) for r in judged.collect()} == {k: plain(h) for k, h in enumerate(rows)}
