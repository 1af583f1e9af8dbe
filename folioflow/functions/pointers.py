"""JSON leaves, pointers, schemas and fingerprints (F50-F60). Leaves come from generators over VARIANT, those of deep containers from a walk over text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NATIVE_LEVELS = 6


def _is_container(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")


def _walk(text: str) -> Iterator[tuple[str, str, str | None]]:
    """pointer, kind, literal of each leaf of a compact JSON container, of any nesting: one pass over its marks, a stack of open containers."""
    open_, path = [], []  # of each open container the next array place, or None for an object whose key comes next
    for m in _MARK.finditer(text):
        c = m[0]
        if c in "[{":
            open_.append(0 if c == "[" else None)
            path.append("0" if c == "[" else "")
        elif c in "]}":
            open_.pop()
            path.pop()
        elif c == ",":
            if open_[-1] is not None:
                open_[-1] += 1
                path[-1] = str(open_[-1])
        elif m[1] is not None:  # a key with its colon
            path[-1] = json.loads(m[1]).replace("~", "~0").replace("/", "~1")
        else:
            kind = "string" if c[0] == '"' else "boolean" if c in ("true", "false") else "null" if c == "null" else "number"
            yield "/" + "/".join(path), kind, json.loads(c) if kind == "string" else None if kind == "null" else c


def literal(value) -> str:
    """A scalar as its JSON literal."""
    return json.dumps(value, ensure_ascii=False)


def walk_nodes(text: str) -> Iterator[tuple]:
    """pointer, pattern, parent's pattern, parent's kind, kind, literal, names of each value of a JSON text, containers after what they hold."""
    open_: list[dict] = []

    def place() -> tuple:
        if not open_:
            return "", "", None, None
        top = open_[-1]
        step = str(top["n"]) if top["kind"] == "array" else top["name"]
        return f"{top['pointer']}/{step}", top["pattern"] + ("/*" if top["kind"] == "array" else "/" + step.replace("*", "~2")), top["pattern"], top["kind"]

    for m in _MARK.finditer(text):
        c = m[0]
        if c in ("[", "{"):
            pointer, pattern, parent, parent_kind = place()
            open_.append({"pointer": pointer, "pattern": pattern, "parent": parent, "parent_kind": parent_kind, "kind": "array" if c == "[" else "object", "n": 0, "name": "", "names": []})
        elif c in ("]", "}"):
            own = open_.pop()
            yield own["pointer"], own["pattern"], own["parent"], own["parent_kind"], own["kind"], None, own["names"] if own["kind"] == "object" else None
        elif c == ",":
            open_[-1]["n"] += 1
        elif m[1] is not None:
            open_[-1]["name"] = json.loads(m[1]).replace("~", "~0").replace("/", "~1")
            open_[-1]["names"].append(open_[-1]["name"])
        else:
            kind = "string" if c[0] == '"' else "boolean" if c in ("true", "false") else "null" if c == "null" else "integer" if re.fullmatch(r"-?\d+", c) else "number"
            yield *place(), kind, literal(json.loads(c)) if kind == "string" else c, None


_MARK = re.compile(r'("(?:[^"\\]|\\.)*")\s*:|"(?:[^"\\]|\\.)*"|[\[\]{},]|[^\s\[\]{},:"]+')


def _deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, prefix + p, kind, value) for i, (prefix, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) for p, kind, value in _walk(text)]
        for k in range(0, len(found), 1 << 16):
            i, p, kind, value = zip(*found[k : k + (1 << 16)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(p, pa.string()), pa.array(kind, pa.string()), pa.array(value, pa.string())], names=["k", "pointer", "kind", "value"])


def leaves(df: DataFrame, key: str, document: str) -> DataFrame:
    """key, pointer, kind, value of each leaf of a JSON text. Kinds are null, boolean, number and string; numbers compare by value, so 1 and 1.0
    are one number. Empty containers have no leaves; a document that is no JSON has none either.

    ``NATIVE_LEVELS`` levels are generators in one stage; a container that is still open below them is walked as text, so nesting has no limit
    beyond the parser's. Texts with fewer opening brackets than that are not read a second time."""
    spark = df.sparkSession

    def opened(rows: DataFrame) -> DataFrame:
        walk = rows.select(F.col(key).alias("k"), F.lit("").alias("pointer"), F.try_parse_json(F.col(document)).alias("v")).where("v IS NOT NULL")
        for _ in range(NATIVE_LEVELS):
            step = F.when(F.col("key").isNull(), F.col("pos").cast("string")).otherwise(F.replace(F.replace(F.col("key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
            walk = walk.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
            walk = walk.select("k", F.when(F.col("pos").isNull(), F.col("pointer")).otherwise(F.concat("pointer", F.lit("/"), step)).alias("pointer"), F.when(F.col("pos").isNull(), F.col("v")).otherwise(F.col("value")).alias("v"))
        return walk

    kind = F.schema_of_variant("v")
    shallow = opened(df).where(~_is_container(F.col("v"))).select("k", "pointer", F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").otherwise("number").alias("kind"), F.col("v").cast("string").alias("value"))
    rest = opened(df.where(F.regexp_count(F.col(document), F.lit(r"[\[{]")) > NATIVE_LEVELS)).where(_is_container(F.col("v")) & ~F.to_json("v").isin("[]", "{}"))
    deep = rest.select("k", "pointer", F.to_json("v").alias("value")).mapInArrow(_deep, f"k {dict(df.dtypes)[key]}, pointer string, kind string, value string")
    value = F.when(F.col("kind") == "number", F.col("value").cast("double").cast("string")).when(F.col("kind") != "null", F.col("value"))
    return shallow.unionByName(deep).select(F.col("k").alias(key), F.when(F.col("pointer") == "", "/").otherwise(F.col("pointer")).alias("pointer"), "kind", value.alias("value"))


def non_null_leaves(df: DataFrame, key: str, document: str) -> DataFrame:
    """F51."""
    return leaves(df, key, document).where("kind <> 'null'")


def pointer_to_path(pointer: str) -> str:
    """RFC 6901 pointer as a JSONPath for variant_get."""
    out = "$"
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        out += f"[{part}]" if part.isdigit() else "['" + part.replace("'", "\\'") + "']"
    return out


def lookup(document: Column, pointer: str, kind: str = "string") -> Column:
    """the value at a pointer, null if it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(document), pointer_to_path(pointer), kind)


def canonical_pointer(pointer: Column) -> Column:
    """without a leading /data, with a leading slash."""
    p = F.when(F.startswith(pointer, F.lit("/")), pointer).otherwise(F.concat(F.lit("/"), pointer))
    return F.when(p.rlike("^/data(/|$)"), F.regexp_replace(p, "^/data", "")).otherwise(p)


def schema_problems(schema: dict, path: str = "") -> list[str]:
    """where a JSON schema leaves the strict subset (object root, every property required and nullable, closed objects, one non-null type)."""
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else list(kinds or [])
    solid = [k for k in kinds if k != "null"]
    if len(solid) != 1:
        return [f"{path or '/'}: exactly one non-null type"]
    if path == "" and kinds != ["object"]:
        out.append("/: the root is an object")
    if path and "null" not in kinds and solid[0] not in ("object", "array"):
        out.append(f"{path}: nullable")
    if solid[0] == "object":
        props = schema.get("properties") or {}
        if schema.get("additionalProperties") is not False:
            out.append(f"{path or '/'}: additionalProperties is false")
        if sorted(schema.get("required") or []) != sorted(props):
            out.append(f"{path or '/'}: every property is required")
        for name, child in props.items():
            out += schema_problems(child, f"{path}/{name.replace('~', '~0').replace('/', '~1')}")
    if solid[0] == "array":
        out += schema_problems(schema["items"], f"{path}/*") if isinstance(schema.get("items"), dict) else [f"{path}: items is a schema"]
    return out


_KINDS = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.StringType(), "text": T.StringType()}


def compile_fields(fields: list[dict]) -> T.StructType:
    """stored form fields (name, type, description) as a struct type; dates are kept as text."""
    return T.StructType([T.StructField(f["name"], _KINDS[f["type"]], True, {"comment": f.get("description", "")}) for f in fields])


def compile_schema(schema: dict) -> T.DataType:
    """a JSON schema of the strict subset as a Spark type."""
    kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    kind = next(k for k in kinds if k != "null")
    if kind == "object":
        return T.StructType([T.StructField(n, compile_schema(s), True) for n, s in schema["properties"].items()])
    if kind == "array":
        return T.ArrayType(compile_schema(schema["items"]))
    return _KINDS[kind]


def infer_schema(value) -> dict:
    """a schema of the strict subset for a value; arrays are typed by their first item."""
    if isinstance(value, dict):
        return {"type": "object", "properties": {k: infer_schema(v) for k, v in value.items()}, "required": list(value), "additionalProperties": False}
    if isinstance(value, list):
        return {"type": ["array", "null"], "items": infer_schema(value[0]) if value else {"type": ["string", "null"]}}
    kind = "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "number" if isinstance(value, float) else "string"
    return {"type": [kind, "null"]}


def contract(spark: SparkSession, schema: dict) -> DataFrame:
    """extraction classes of a schema: class, pointer, array_pointer, kind. Arrays inside arrays are refused."""
    rows: list[tuple] = []

    def walk(node: dict, pointer: str, array: str | None):
        kinds = node["type"] if isinstance(node["type"], list) else [node["type"]]
        kind = next(k for k in kinds if k != "null")
        if kind == "object":
            for name, child in node["properties"].items():
                walk(child, f"{pointer}/{name.replace('~', '~0').replace('/', '~1')}", array)
        elif kind == "array":
            if array is not None:
                raise ValueError(f"{pointer}: arrays inside arrays are not supported")
            walk(node["items"], f"{pointer}/*", pointer)
        else:
            rows.append((f"field_{len(rows) + 1:04d}", pointer, array, kind))

    walk(schema, "", None)
    return spark.createDataFrame(rows, "class string, pointer string, array_pointer string, kind string")


def coerce(text: Column, kind: str) -> Column:
    """a strict literal as its kind's type, null if it is none."""
    if kind == "integer":
        return F.when(text.rlike(r"\A[+-]?\d+\z"), F.regexp_replace(text, r"^\+", "").try_cast("bigint"))  # null beyond the type
    if kind == "number":
        return F.when(text.rlike(r"\A[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"), text.try_cast("double"))
    if kind == "boolean":
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    return text


def skeleton(schema: dict):
    """an instance with nulls for scalars and empty arrays."""
    kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    if "object" in kinds:
        return {n: skeleton(s) for n, s in schema["properties"].items()}
    return [] if "array" in kinds else None


def identity(name: Column, content: Column) -> Column:
    """hash of a file's name and bytes."""
    return F.sha2(F.concat(name.cast("binary"), F.lit(b"\x00"), content), 256)


def canonical_json(text: Column) -> Column:
    """a JSON text with sorted keys at every level, nulls kept, no white space, and whole numbers without a fraction; null if it is none."""
    compact = F.to_json(F.try_parse_json(text))
    return F.regexp_replace(compact, r'("(?:[^"\\\\]|\\\\.)*+")|(?<=[\[:,]|^)(-?\d+)\.0(?=[,\]}]|$)', "$1$2")


def fingerprint(document: Column) -> Column:
    """hash of a struct's canonical JSON; a null field is not an absent one, and the order of fields does not count."""
    return F.sha2(canonical_json(F.to_json(document, {"ignoreNullFields": "false"})), 256)
