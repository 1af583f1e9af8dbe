"""The data source of documents, publications, stores, observed counters and instances."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.functions import pointers
from folioflow.operators import instances, metrics
from folioflow.sources import datasource, formats, publish, stores
from folioflow.streaming import progress

from .conftest import SMALL


def folder(tmp_path, n=6):
    at = tmp_path / "files"
    at.mkdir()
    for i in range(n):
        (at / f"n{i}.md").write_text(f"# Title {i}\n\ntext {i} " + "x" * 500 * i)
    (at / "B.csv").write_text("a,b\n1,2\n")
    (at / "c.html").write_text("<p>one</p><p>two</p>")
    (at / "bad.pdf").write_bytes(b"no pdf")
    (at / "odd.docx").write_bytes(b"no zip")
    (at / ".hidden.md").write_text("no")
    (at / "below").mkdir()
    (at / "below" / "deep.md").write_text("no")
    return at


def test_documents_equal_the_scan(spark, tmp_path):
    at = folder(tmp_path)
    datasource.register(spark)
    read = spark.read.format("folio_documents").option("path", str(at)).option("partition_bytes", 1500).load()
    assert read.rdd.getNumPartitions() > 3
    names = [c.split()[0] for c in formats.RECORD.split(", ")]
    plain = lambda df: sorted(json.dumps([str(v) for v in [r["path"].removeprefix("file:"), *[r[c] for c in names[1:-1]]]]) for r in df.collect())
    files = spark.read.format("binaryFile").load(str(at)).where("path NOT LIKE '%/.hidden.md'").select("path", "content")
    assert plain(read) == plain(formats.scan(files))


def test_excluded_files_are_not_opened(spark, tmp_path):
    at = folder(tmp_path)
    datasource.register(spark)
    (at / "unreadable.csv").symlink_to(tmp_path / "nowhere.csv")  # opening it would be an error row
    read = spark.read.format("folio_documents").option("path", str(at)).load()
    assert {r.path.rsplit("/", 1)[1] for r in read.where("format = 'markdown'").collect()} == {f"n{i}.md" for i in range(6)}
    one = read.where(F.col("path") == str(at / "n2.md")).where("kind = 'record'")
    assert [r.text for r in one.orderBy("seq").collect()][0] == "Title 2" and one.rdd.getNumPartitions() == 1
    reader = datasource.Reader({"path": str(at)})
    opened = []
    wanted = reader.wanted
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    left = list(reader.pushFilters([In(("format",), ("csv", "html")), EqualTo(("kind",), "record"), GreaterThan(("unit_number",), 0), StringContains(("text",), "x")]))
    assert [type(f).__name__ for f in left] == ["StringContains"]
    files = [p for part in reader.partitions() for p, _ in part.files]
    assert {Path(p).name for p in files} <= {"B.csv", "c.html", "unreadable.csv"} and not opened
    assert {r[1] for r in datasource.records([(str(at / "B.csv"), 1)], wanted)} == {"record"}
    assert list(datasource.records([(str(at / "missing.csv"), 1)], wanted)) == []
    assert [r[1] for r in datasource.records([(str(at / "missing.csv"), 1)], datasource.Wanted())] == ["error"]


def test_documents_are_dealt_by_bytes():
    parts = datasource.split([("a", 5), ("b", 5), ("c", 20), ("d", 1)], 10)
    assert [[p for p, _ in x.files] for x in parts] == [["a", "b"], ["c"], ["d"]] and datasource.split([], 10) == []


def test_stream_of_documents_gives_each_file_once(spark, tmp_path):
    at = folder(tmp_path, 3)
    datasource.register(spark)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        read = spark.readStream.format("folio_documents").option("path", str(at)).option("max_files", 2).load()
        q = read.where("kind = 'unit'").select("path", "format").writeStream.format("parquet").option("checkpointLocation", check).start(out)
        q.processAllAvailable()
        q.stop()
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(out).collect())

    assert run() == ["B.csv", "c.html", "n0.md", "n1.md", "n2.md"]
    (at / "zz.md").write_text("# later")
    assert run() == ["B.csv", "c.html", "n0.md", "n1.md", "n2.md", "zz.md"]


def test_publication_is_whole_or_nothing(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "p")
    one = spark.range(10).withColumn("k", F.col("id") % 3)
    with pytest.raises(KeyError):
        publish.read(spark, target, "rows")
    publish.publish(spark, target, {"rows": one, "sums": one.groupBy("k").count()}, by={"rows": "k"})
    assert publish.read(spark, target, "rows").count() == 10 and publish.read(spark, target, "rows").columns == ["id", "k"]

    def lost(*_):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as m:  # written, not yet switched
        m.setattr(publish, "verify", lost)
        with pytest.raises(RuntimeError):
            publish.publish(spark, target, {"rows": one.limit(1)})
    assert publish.read(spark, target, "rows").count() == 10
    with pytest.raises(ValueError):
        publish.verify("rows", {"n": 1}, {"n": 2})
    second = publish.publish(spark, target, {"rows": one.limit(4), "none": one.limit(0)})
    assert publish.read(spark, target, "rows").count() == 4 and publish.read(spark, target, "none").count() == 0
    told = {(r.number, r.parts, r.n_rows, r.is_current) for r in publish.statuses(spark, target).collect()}
    assert told == {(1, 2, 13, False), (2, 2, 4, True)} and {r.version for r in publish.current(spark, target).collect()} == {second}


def test_store_keys_have_no_case(spark):
    stored = spark.createDataFrame([("Alpha", 1, "a"), ("beta", 2, "b"), ("Éclair", 1, "e")], "key string, version int, body string")
    changes = spark.createDataFrame([("ALPHA", 1, 1, False, "a2"), ("alpha", 1, 2, False, "a3"), ("BETA", 1, 3, False, "b2"), ("gamma", None, 4, False, "g"), ("éclair", 1, 5, True, None), ("delta", 3, 6, False, "d"), ("Beta2", None, 7, True, None)], "key string, expected int, seq int, deleted boolean, body string")
    after, told = stores.put(stored, changes, "key")
    assert [tuple(r) for r in stores.listed(after, "key").collect()] == [("Alpha", 2, "a2"), ("beta", 2, "b"), ("gamma", 1, "g")]
    assert {r.seq: r.outcome for r in told.collect()} == {1: "updated", 2: "repeated", 3: "conflict", 4: "created", 5: "deleted", 6: "missing", 7: "missing"}
    asked = spark.createDataFrame([("aLPHa",), ("none",)], "key string")
    assert {(r.asked, r.body) for r in stores.found(stored, asked, "key").collect()} == {("aLPHa", "a"), ("none", None)}


def test_observed_counters_equal_a_query(spark, tmp_path):
    calls = spark.range(1000, numPartitions=7).select(F.when(F.col("id") % 5 == 0, "timeout").alias("error"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("input_tokens"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("output_tokens"))
    df, seen = progress.observed(calls, "calls")
    df.write.mode("overwrite").parquet(str(tmp_path / "calls"))
    want = spark.read.parquet(str(tmp_path / "calls")).agg(*progress.call_counters()).first().asDict()
    assert seen.get == want == {"calls": 1000, "failures": 200, "input_tokens": sum(i for i in range(1000) if i % 5), "output_tokens": sum(range(0, 1000, 3)), "unmetered": 0}


def test_observed_counters_after_a_task_is_tried_again(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from folioflow.streaming import progress
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def flaky(batches):
    n = 0
    for b in batches:
        yield b
        n += 1
        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() % 2 == 0:
            raise RuntimeError("lost")
rows = spark.range(4000, numPartitions=4)
first, one = progress.observed(rows, "before", F.count(F.lit(1)).alias("n"))
last, two = progress.observed(first.mapInArrow(flaky, "id bigint"), "after", F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
last.write.format("noop").mode("overwrite").save()
print("COUNTS", one.get["n"], two.get["n"], two.get["s"])
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert f"COUNTS 4000 4000 {sum(range(4000))}" in said.stdout, said.stderr[-2000:]


def test_progress_of_a_stream(spark, tmp_path):
    source, told = str(tmp_path / "in"), []
    for i in range(3):
        spark.createDataFrame([(None, 10 * i + 1, 2), ("timeout", None, None)], "error string, input_tokens bigint, output_tokens bigint").coalesce(1).write.mode("append").parquet(source)
    listener = progress.Progress(told.append)
    spark.streams.addListener(listener)
    try:
        read = progress.streamed(spark.readStream.schema("error string, input_tokens bigint, output_tokens bigint").option("maxFilesPerTrigger", 1).parquet(source), "calls")
        q = read.writeStream.format("noop").queryName("ledger").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if any(e[0] == "ended" for e in told):
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals("calls") == {"calls": 6, "failures": 3, "input_tokens": 33, "output_tokens": 6, "unmetered": 0} and told[0][:2] == ("started", "ledger")


def test_instances_of_odd_texts(spark):
    rules = instances.rules(spark, {"s": {"type": "object", "properties": {"*": {"type": ["array", "null"], "items": {"type": ["integer", "null"]}}, "~/": {"type": ["number", "null"]}}, "required": ["*", "~/"], "additionalProperties": False}})
    texts = ['{"*":[1,null,2.0,"x"],"~/":1e5}', "[]", "null", "3", "", None, '{"*":null,"~/":true,"a":{"deep":1}}', '{"*":[],"~/":-1}', '{"*":{"*":1},"~/":1}', "{broken"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("schema", F.lit("s"))
    got = sorted(map(tuple, instances.instance_problems(docs, rules, "k", "schema", "text").collect()))
    assert got == sorted([(0, "/*/2", "expected integer"), (0, "/*/3", "expected integer"), (1, "/", "expected object"), (2, "/", "null is not allowed"), (3, "/", "expected object"), (4, "/", "no JSON"), (5, "/", "no JSON"), (6, "/~0~1", "expected number"), (6, "/a", "unexpected"), (8, "/*", "expected array"), (9, "/", "no JSON")])
    deep = "[" * 400 + "]" * 400
    assert sum(1 for _ in pointers.walk_nodes(deep)) == 400


def test_instances_are_judged_in_one_pass(spark):
    """documents meet the rules of their own schema where they stand; equal and null keys are rows of their own, text behind a value is no JSON."""
    loose = {"type": "object", "properties": {"a/~*": {"type": ["number", "null"], "enum": [1, 2.5]}, "s": {"type": "string", "enum": ["\u00e9\""]}}, "required": [], "additionalProperties": False}
    rules = instances.rules(spark, {"o": loose, "l": {"type": "array", "items": {"type": "boolean"}}})
    texts = [(1, "o", '{"a/~*":2.5,"s":"\u00e9\\""}'), (1, "o", '{"a/~*":3,"s":"e"}'), (None, "l", "[true, null, 0]"), (2, "l", "[true] x"), (3, "none", '{"a":[1]}'), (4, None, "1"), (5, "o", '{"\\ud800":1,"s":null}'), (6, "l", "[" * 900 + "]" * 900)]
    got = instances.instance_problems(spark.createDataFrame(texts, "k int, n string, t string"), rules, "k", "n", "t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    want = [(1, "/a~1~0*", "value is not in enum"), (1, "/s", "value is not in enum"), (None, "/1", "null is not allowed"), (None, "/2", "expected boolean"), (2, "/", "no JSON"), (3, "/", "unexpected"), (4, "/", "unexpected"), (5, "/?", "unexpected"), (5, "/a~1~0*", "missing"), (5, "/s", "null is not allowed"), (6, "/0", "expected boolean")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_requests_are_called_once_an_attempt(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    where = str(log)

    def load():
        def model(row):
            import uuid

            Path(f"{where}/{row['k']}-{row['attempt']}-{uuid.uuid4().hex}").touch()
            return {"document": '{"n":1}' if row["attempt"] == 2 or row["k"] == 1 else "{", "input_tokens": 1, "output_tokens": 1}

        return model

    rules = instances.rules(spark, {"n": {"type": "object", "properties": {"n": {"type": ["integer", "null"]}}, "required": ["n"], "additionalProperties": False}})
    asked = spark.createDataFrame([(1, "n"), (2, "n"), (3, "n")], "k int, schema string")
    answers, trace = instances.structured_requests(asked, load, rules, "k", "schema")
    assert {(r.k, r.document, r.error) for r in answers.collect()} == {(k, '{"n":1}', None) for k in (1, 2, 3)}
    assert sorted((r.k, r.attempt, r.status, r.summary) for r in trace.collect()) == [(1, 1, "completed", None), (2, 1, "schema_invalid", "/: no JSON"), (2, 2, "completed", None), (3, 1, "schema_invalid", "/: no JSON"), (3, 2, "completed", None)]
    assert sorted(p.name.rsplit("-", 1)[0] for p in log.iterdir()) == ["1-1", "2-1", "2-2", "3-1", "3-2"]


def test_leaves_of_reports_are_not_broadcast(spark):
    """however small the reports look, their leaves meet the rules in shuffled joins."""
    reports = spark.createDataFrame([("r1", "a", '{"x":1}', '{"x":2}')], "report string, kind string, candidate string, baseline string")
    rules = spark.createDataFrame([("a", "up", "/x", True, 2.0, None, None)], "kind string, name string, path string, higher_is_better boolean, minimum double, maximum double, max_regression double")
    gate = metrics.report_gate(reports, rules, "report")
    assert gate._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin [report") == 2
    assert [(r.report, r.passed, r.reason) for r in gate.collect()] == [("r1", False, "absolute threshold failed")]


def test_report_gate_reads_each_rule_at_its_pointer(spark):
    reports = spark.createDataFrame([("r1", "x", '{"a":{"b":[1,5]},"c":"t"}', '{"a":{"b":[1,9]}}'), ("r2", "y", "{}", "{}")], "report string, kind string, candidate string, baseline string")
    rules = spark.createDataFrame([("x", "up", "/a/b/1", True, 1.0, None, 2.0), ("x", "text", "/c", True, 1.0, None, None), ("y", "gone", "/z", False, None, 1.0, None)], "kind string, name string, path string, higher_is_better boolean, minimum double, maximum double, max_regression double")
    assert {(r.report, r.name, r.reason) for r in metrics.report_gate(reports, rules, "report").collect()} == {("r1", "up", "baseline regression exceeded"), ("r1", "text", "candidate metric is not numeric"), ("r2", "gone", "candidate metric is missing")}


def test_snapshot_discovery_batches_and_keys(spark, tmp_path):
    """Operators that no query reaches."""
    from folioflow.functions import geometry, text
    from folioflow.operators import windows

    at = folder(tmp_path, 2)
    assert [r.path.rsplit("/", 1)[1] for r in formats.discover(spark, str(at), [".md", ".csv"]).collect() if not r.path.endswith(".hidden.md")] == ["B.csv", "n0.md", "n1.md"]
    files = spark.read.format("binaryFile").load(str(at))
    kinds = {r.path.rsplit("/", 1)[1]: r.category for r in formats.snapshot(files, [(r"\.md$", "docs"), (r"\.csv$", "data")]).collect()}
    assert kinds["n0.md"] == "docs" and kinds["B.csv"] == "data" and kinds["c.html"] == "other"
    pages = spark.range(1, 8).select(F.lit(1).alias("d"), F.col("id").alias("page"))
    assert {r.page: r.batch for r in windows.batches(pages, ["page"], 3, ["d"]).collect()} == {p: (p - 1) // 3 for p in range(1, 8)}
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(text.fingerprint(F.lit("table"), F.lit("A b-1, c"))) == "table a b-1 c"
    box = lambda *v: geometry.box(*[F.lit(float(x)) for x in v])
    assert one(geometry.over_smaller(box(0, 0, 1, 1), box(0, 0, 0.5, 0.5))) == 1.0
    docs = spark.createDataFrame([(1, '{"a":null,"b":[1,null]}')], "k int, j string")
    assert [tuple(r) for r in pointers.non_null_leaves(docs, "k", "j").collect()] == [(1, "/b/0", "number", "1.0")]
    assert one(pointers.identity(F.lit("a"), F.lit("b").cast("binary"))) != one(pointers.identity(F.lit("ab"), F.lit("").cast("binary")))
    assert SMALL
