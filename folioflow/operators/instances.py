"""JSON instances against schemas, problems as rows, and structured requests with a traced repair.

A schema is a table of rules, one a generalised pointer (an index of an array is *, a star in a name is ~2). Rules are made on the driver and
few, so they go to the tasks as trees, and each document is read against the tree of its schema: only its problems become rows, and neither
documents nor their values are shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pointers
from . import keep, models

RULE = "schema string, pattern string, kind string, nullable boolean, allowed array<string>, children array<string>"


def _escaped(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def rules_of(name: str, schema: dict) -> list[tuple]:
    """A schema of the strict subset as rows of RULE: what each place may hold, its enumerated values as JSON literals, and the names it must have."""
    found: list[tuple] = []
    todo = [("", schema)]
    while todo:
        at, node = todo.pop()
        kinds = [node["type"]] if isinstance(node["type"], str) else node["type"]
        kind = next(k for k in kinds if k != "null")
        children = [_escaped(n) for n in node.get("properties", {})] if kind == "object" else None
        found.append((name, at, kind, "null" in kinds, [pointers.literal(v) for v in node["enum"]] if "enum" in node else None, children))
        if kind == "object":
            todo += [(f"{at}/{_escaped(n).replace('*', '~2')}", child) for n, child in node["properties"].items()]
        elif kind == "array":
            todo.append((f"{at}/*", node["items"]))
    return found


def rules(spark: SparkSession, schemas: dict[str, dict]) -> DataFrame:
    """Schemas by name as one table of rules."""
    return spark.createDataFrame([r for name, schema in schemas.items() for r in rules_of(name, schema)], RULE)


NODE = "pointer string, pattern string, parent string, parent_kind string, kind string, literal string, names array<string>"
_NODE = pa.schema([*((c, pa.string()) for c in ("pointer", "pattern", "parent", "parent_kind", "kind", "literal")), ("names", pa.list_(pa.string()))])


def nodes(documents: DataFrame, key: str, document: str) -> DataFrame:
    """Every value of JSON texts: key, pointer, pattern, the pattern and kind of what holds it, kind (integer is a number without fraction or
    exponent), literal of a scalar, names of an object. Texts that are no JSON have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], {c: [] for c in _NODE.names}
            for i, said in enumerate(batch.column(1).to_pylist()):
                for row in pointers.walk_nodes(said):
                    keys.append(i)
                    for c, v in zip(_NODE.names, row):
                        rows[c].append(v)
                if len(keys) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *[pa.array(rows[f.name], f.type) for f in _NODE]], names=[key, *_NODE.names])
                    keys, rows = [], {c: [] for c in _NODE.names}
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *[pa.array(rows[f.name], f.type) for f in _NODE]], names=[key, *_NODE.names])

    good = documents.where(F.try_parse_json(F.col(document)).isNotNull()).select(key, document)
    return good.mapInArrow(run, f"`{key}` {dict(documents.dtypes)[key]}, {NODE}")


class _Integer(str):
    """The literal of a number without fraction or exponent."""


class _Number(str):
    """The literal of any other number."""


_DECODER = json.JSONDecoder(parse_int=_Integer, parse_float=_Number)
_KINDS = {dict: "object", list: "array", str: "string", _Integer: "integer", _Number: "number", bool: "boolean", type(None): "null"}


@dataclass
class Rule:
    """What a place may hold, with the rules of what it holds: of an object by name, of an array of its items (under None)."""

    kind: str
    nullable: bool
    allowed: list[str] | None
    names: dict[str, str]  # the names it must have, with their escaped forms
    below: dict[str | None, Rule]


def _unescaped(step: str) -> str:
    return step.replace("~2", "*").replace("~1", "/").replace("~0", "~")


def trees(rules: list[tuple]) -> dict[str, Rule]:
    """Rows of RULE as one tree a schema."""
    found = {(schema, pattern): Rule(kind, nullable, allowed, {_unescaped(c): c for c in children or ()}, {}) for schema, pattern, kind, nullable, allowed, children in rules}
    for (schema, pattern), rule in found.items():
        parent, slash, step = pattern.rpartition("/")
        if slash and (schema, parent) in found:
            found[schema, parent].below[None if step == "*" else _unescaped(step)] = rule
    return {schema: rule for (schema, pattern), rule in found.items() if pattern == ""}


def _problems(said: str, rule: Rule | None) -> list[tuple[str, str]]:
    """Pointer and problem of what a text that begins with JSON breaks; text behind its value makes it none."""
    told: list[tuple[str, str]] = []
    try:
        value = _DECODER.decode(said)
    except ValueError:
        return [("/", "no JSON")]
    _judge(value, rule, "", told)
    return told


def _judge(value, rule: Rule | None, pointer: str, told: list[tuple[str, str]]) -> None:
    """Adds pointer and problem of a value and of what it holds; it goes as deep as the rules do."""
    if rule is None:
        return told.append((pointer or "/", "unexpected"))
    kind = _KINDS[type(value)]
    if kind == "null":
        return None if rule.nullable else told.append((pointer or "/", "null is not allowed"))
    if kind != rule.kind and (kind, rule.kind) != ("integer", "number"):
        return told.append((pointer or "/", f"expected {rule.kind}"))
    if kind == "object":
        told += [(f"{pointer}/{escaped}", "missing") for name, escaped in rule.names.items() if name not in value]
        for name, v in value.items():
            _judge(v, rule.below.get(name), f"{pointer}/{_escaped(name)}", told)
    elif kind == "array":
        item = rule.below.get(None)
        for i, v in enumerate(value):
            _judge(v, item, f"{pointer}/{i}", told)
    elif rule.allowed is not None and (value if kind in ("integer", "number") else pointers.literal(value)) not in rule.allowed:
        told.append((pointer or "/", "value is not in enum"))


def instance_problems(documents: DataFrame, rules: DataFrame, key: str, schema: str, document: str) -> DataFrame:
    """key, pointer, problem: no JSON, null is not allowed, expected <kind>, value is not in enum, missing, unexpected.

    Below a place that has a problem of its kind nothing is told. documents: key, schema (the name of its schema), document.
    """
    by_schema = trees([tuple(r) for r in rules.select("schema", "pattern", "kind", "nullable", "allowed", "children").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, told = [], []
            for i, (name, said, good) in enumerate(zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)])):
                told += _problems(said, by_schema.get(name)) if good else [("/", "no JSON")]
                owners += [i] * (len(told) - len(owners))
                if told and (len(told) >= 1 << 16 or i == batch.num_rows - 1):
                    at, problem = zip(*told)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), pa.array([a.encode("utf-8", "replace") for a in at], pa.string()), pa.array(problem, pa.string())], names=[key, "pointer", "problem"])
                    owners, told = [], []

    read = documents.select(F.col(key), F.col(schema).alias("_name"), F.col(document).alias("_said"), F.try_parse_json(F.col(document)).isNotNull().alias("_good"))
    return read.mapInArrow(run, f"`{key}` {dict(documents.dtypes)[key]}, pointer string, problem string")


# fixed value: what the error of a call says when its answer did not fit the schema
SCHEMA_FAILURES = ("schema validation", "schema-valid", "validation error", "invalid json", "json_invalid")


def structured_requests(requests: DataFrame, load: Callable[[], Callable[[dict], dict]], rules: DataFrame, key: str, schema: str, attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """Answers (key, document, error) and the trace (key, attempt, status, n_problems, input_tokens, output_tokens, summary), one row an attempt.

    The model gets the request with its attempt and, from the second one on, the problems of the last answer. An answer that breaks its
    schema, or a call whose error says so, is asked for again; other errors are final. Each round of answers is kept before it is judged, so
    no call is made twice.
    """
    waiting = requests.withColumn("attempt", F.lit(1)).withColumn("problems", F.lit(None).cast("string"))
    answers, trace = None, None
    for attempt in range(1, attempts + 1):
        called = keep.kept(models.call(waiting, load, "document string, input_tokens bigint, output_tokens bigint"))
        found = instance_problems(called.where("error IS NULL").select(key, schema, F.coalesce("document", F.lit("")).alias("document")), rules, key, schema, "document")
        found = found.groupBy(key).agg(F.count(F.lit(1)).alias("n_problems"), F.array_join(F.slice(F.array_sort(F.collect_list(F.concat("pointer", F.lit(": "), "problem"))), 1, 20), "; ").alias("_told"))
        judged = called.join(found, key, "left").withColumn("n_problems", F.coalesce("n_problems", F.lit(0)))
        invalid = (F.col("n_problems") > 0) | F.coalesce(F.lower("error").rlike("|".join(map(re.escape, SCHEMA_FAILURES))), F.lit(False))
        judged = keep.kept(judged.withColumn("status", F.when(invalid, "schema_invalid").when(F.col("error").isNotNull(), "failed").otherwise("completed")).withColumn("summary", F.coalesce("error", "_told")))
        told = judged.select(key, F.lit(attempt).alias("attempt"), "status", "n_problems", "input_tokens", "output_tokens", "summary")
        trace = told if trace is None else trace.unionByName(told)
        final = F.lit(attempt == attempts) | (F.col("status") != "schema_invalid")
        done = judged.where(final).select(key, F.when(F.col("status") == "completed", F.col("document")).alias("document"), F.when(F.col("status") != "completed", F.concat_ws(": ", "status", "summary")).alias("error"))
        answers = done if answers is None else answers.unionByName(done)
        again = judged.where(~final)
        waiting = again.select(*requests.columns, F.lit(attempt + 1).alias("attempt"), F.col("summary").alias("problems"))
    return answers, trace
