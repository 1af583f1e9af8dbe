"""End-to-end flows."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import flows


def test_ingest_routes(spark):
    files = spark.createDataFrame([("/a/x.md", bytearray(b"hello")), ("/a/y.png", bytearray(b"\x89PNG\r\n\x1a\nxx")), ("/a/z.docx", bytearray(b"no")), ("/a/e.csv", bytearray(b"")), ("/a/w.xyz", bytearray(b"1"))], "path string, content binary")
    out = flows.ingest(files, 100, lambda: lambda row: {"text": f"seen {row['format']}"})
    assert {r.path: r.base_text for r in out["texts"].collect()} == {"/a/x.md": "hello", "/a/y.png": "seen png"}
    errors = {r.path: r.error for r in out["errors"].collect()}
    assert set(errors) == {"/a/z.docx", "/a/e.csv", "/a/w.xyz"} and errors["/a/e.csv"] == "empty file"
    assert {r.path for r in flows.ingest(files, 100)["errors"].collect()} == {"/a/z.docx", "/a/e.csv", "/a/w.xyz", "/a/y.png"}


def test_extraction_repairs_once(spark):
    draft = spark.createDataFrame([("d", "/a", "1"), ("d", "/b", "2"), ("d", "/c", "3"), ("d", "/n", None)], "doc_id string, pointer string, value string")
    evidence = spark.createDataFrame([("d", "/a", "atom"), ("d", "/b", "unknown"), ("d", "/b", "atom")], "doc_id string, pointer string, kind string")
    fixed = spark.createDataFrame([("d", "/b", "22")], "doc_id string, pointer string, value string")
    assert {r.pointer: (r.value, r.issue) for r in flows.extract(draft, evidence, fixed).collect()} == {"/a": ("1", None), "/b": ("22", None), "/c": (None, "no evidence"), "/n": (None, None)}


def test_corpus_payload_and_log(spark):
    m = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    r = spark.createDataFrame([("a", 0.5, None)], "doc_id string, score double, error string")
    assert {x.doc_id: x.error for x in flows.corpus_run(m, r).collect()} == {"a": None, "b": "source is unavailable"}
    s = spark.createDataFrame([("d", "s1", 1), ("d", "s2", 2)], "doc_id string, segment_id string, start_page int")
    e = spark.createDataFrame([("d", "s1", "v")], "doc_id string, segment_id string, total string")
    assert [x.json for x in flows.segment_payload(s, e, ["doc_id"]).orderBy("segment_id").collect()] == ['{"segment_id":"s1","start_page":1,"extraction":{"total":"v"}}', '{"segment_id":"s2","start_page":2}']
    c = spark.createDataFrame([("d", 1, 0.1, 1, 0, "t1", ["x"]), ("d", 5, 0.9, 2, 0, "t2", ["unresolved_form_controls"])], "doc string, severity int, confidence double, page int, reading_order int, target_id string, reasons array<string>")
    assert [x.target_id for x in flows.recovery_log(c, ["doc"]).orderBy("number").collect()] == ["t2", "t1"]
    u = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "doc string, seq int, model string")
    assert flows.combined_envelope({"usage": u}, "doc", "2").first().json == '{"schema_version":"2","usage":[{"seq":1,"model":"a"},{"seq":2,"model":"b"}]}'
    assert flows.inside("/r", "a/b") == "/r/a/b"
    with pytest.raises(ValueError):
        flows.inside("/r", "../x")
    assert spark.range(1).select(flows.source(F.lit(1), F.lit(None).cast("string"), F.lit(2), F.lit(3)).alias("s")).first().s == '{"page":1,"start":2,"end":3}'
