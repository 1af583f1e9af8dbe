"""Merkle manifest of a dataset: a tree of digests a group, one root over the groups, and a proof for each row.

Leaves get their places by a range exchange, counts a range and offsets. A task walks its places in order and keeps a
``Forest``: nodes that wait for the rest of their run, keyed by tree, level and run. The size of each tree is known, so the
length of every run is, and a run that is whole becomes its parent at once; a finished tree becomes a leaf of the tree of
roots. Forests merge in any grouping to the same forest, so ``treeReduce`` joins those of all tasks. A task keeps at most 14
waiting nodes a level, and there are at most ``RANGES`` tasks, which bounds what reaches the driver.

Runs that end inside a task are written by it, those that end in a merge by the driver; both from level ``chunk`` up, and
those give each chunk of 8**chunk leaves its path to the root. A task then takes a chunk and its path and makes the proofs.

Null values have a digest of their own ("-"); empty and long texts are values like any other. Rows that share the order
column are placed by their leaves, so equal rows have neighbouring places and their own proofs; a null stands first. An
empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import out_batch, settle, spread_join

CHUNK, RANGES, ROOT = 4, 1024, -1
DEEPEST = 21  # 8**21 is more than any count of rows

NODE = "tree bigint, level int, place bigint, digest string"
_NODE = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string())])


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*columns: Column) -> Column:
    """The digest of a row: of each value's byte count and text, "-" for null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]), 256)


class Forest:
    """Waiting nodes of trees whose numbers of leaves are known. root: the digest of everything, once it is whole."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk = chunk
        self.sizes: dict[int, int] = {}
        self.waiting: dict[tuple[int, int, int], dict[int, str]] = {}
        self.used: list[tuple[int, int, int, str]] = []
        self.root: str | None = None

    def add(self, tree: int, level: int, place: int, value: str) -> None:
        while True:
            width = -(-self.sizes[tree] // 8**level)
            if width == 1 and tree == ROOT:
                self.root = value
                self.used.append((tree, level, place, value))
                return
            if width == 1:
                tree, level, place = ROOT, 0, tree
                continue
            key = (tree, level, place >> 3)
            run = self.waiting.setdefault(key, {})
            run[place] = value
            if len(run) < min(8, width - (place >> 3 << 3)):
                return
            del self.waiting[key]
            if level >= self.chunk or tree == ROOT:
                self.used += [(tree, level, i, h) for i, h in run.items()]
            level, place, value = level + 1, place >> 3, digest(*(run[i] for i in sorted(run)))

    def merge(self, other: Forest) -> Forest:
        """Both forests as one: their waiting nodes, and what they complete."""
        self.sizes |= other.sizes
        self.used += other.used
        self.root = self.root or other.root
        for (tree, level, _), run in other.waiting.items():
            for place, value in run.items():
                self.add(tree, level, place, value)
        return self


def _grown(chunk: int):
    """The nodes of one task: those that wait, and those of level chunk or more that its own runs have used."""
    schema = pa.schema([*_NODE, ("waits", pa.bool_()), ("size", pa.int64()), ("trees", pa.int64())])

    def run(batches):
        forest = Forest(chunk)

        def out(nodes, waits):
            nodes = list(nodes)
            columns = dict(zip(_NODE.names, zip(*nodes))) if nodes else {c: [] for c in _NODE.names}
            return out_batch(schema, **columns, waits=[waits] * len(nodes), size=[forest.sizes[n[0]] for n in nodes], trees=[forest.sizes[ROOT]] * len(nodes))

        for batch in batches:
            for tree, size, trees, place, leaf in zip(*(c.to_pylist() for c in batch.columns)):
                forest.sizes[tree], forest.sizes[ROOT] = size, trees
                forest.add(tree, 0, place, leaf)
            if len(forest.used) >= 10_000:
                yield out(forest.used, False)
                forest.used = []
        if forest.sizes:
            yield out(forest.used, False)
            yield out(((t, level, i, h) for (t, level, _), run in forest.waiting.items() for i, h in run.items()), True)

    return run


def _forest(chunk: int):
    """The forest of waiting nodes that one task has kept."""

    def run(rows):
        forest = Forest(chunk)
        for r in rows:
            forest.sizes[r.tree], forest.sizes[ROOT] = r.size, r.trees
            forest.waiting.setdefault((r.tree, r.level, r.place >> 3), {})[r.place] = r.digest
        return [forest]

    return run


def placed(df: DataFrame, group: str, *order: str, known=lambda groups: groups) -> DataFrame:
    """df with place (from 0, within its group, by order) and what ``known`` makes of the groups (group, size): one row a group.

    One range exchange; a group may span any number of ranges, and a range any number of groups. Rows of one range and group stay in one task.
    """
    spark = df.sparkSession
    parts = min(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = settle(df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    by_range = ranged.groupBy(group, F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("size", F.sum("_n").over(Window.partitionBy(group)))
    starts = settle(starts.select(group, "_range", "_from", "_start", "size"))
    starts = starts.drop("size").join(known(starts.where(F.col("_start") == 0).select(group, "size")), group)
    rows = ranged.withColumn("_range", F.shiftright("_at", 33)).join(starts, [group, "_range"]).withColumn("place", F.col("_at") - F.col("_from") + F.col("_start"))
    return rows.drop("_at", "_from", "_start", "_range")


def numbered(groups: DataFrame) -> DataFrame:
    """name, tree (its place among the names), trees (their number) and size of each group."""
    found = placed(groups.withColumnRenamed("size", "leaves").withColumn("all", F.lit(0)), "all", "name")
    return settle(found.select("name", F.col("place").alias("tree"), F.col("size").alias("trees"), F.col("leaves").alias("size")))


def _paths(trees: DataFrame, nodes: DataFrame, chunk: int) -> DataFrame:
    """tree, chunk, path of each chunk: of each level from the chunk's to the root the siblings before and after."""
    depth = lambda size: F.size(F.filter(F.array(*[F.lit(8**k) for k in range(DEEPEST)]), lambda v: v < size))
    up = lambda start, depth: F.filter(F.sequence(F.lit(start), F.lit(DEEPEST)), lambda k: k < depth)
    shift = lambda c, n: F.call_function("shiftright", c, n.cast("int"))
    chunks = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / F.lit(8**chunk)))))
    own = F.transform(up(chunk, depth(F.col("size"))), lambda k: F.struct(F.col("tree").alias("tree"), k.alias("level"), shift(F.col("chunk"), 3 * (k - chunk)).alias("place")))
    root = F.transform(up(0, depth(F.col("trees"))), lambda k: F.struct(F.lit(ROOT).cast("bigint").alias("tree"), k.alias("level"), shift(F.col("tree"), 3 * k).alias("place")))
    steps = chunks.select("tree", "chunk", F.posexplode(F.concat(own, root)).alias("step", "at"))
    name = lambda tree, level, place: F.concat_ws(":", tree, level, F.shiftright(place, 3))
    runs = nodes.groupBy(name(F.col("tree"), F.col("level"), F.col("place")).alias("run")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("members"))  # at most 8
    met = spread_join(steps.withColumn("run", name(F.col("at.tree"), F.col("at.level"), F.col("at.place"))), runs, "run", F.col("chunk"))
    side = lambda keep: F.array_join(F.transform(F.filter("members", keep), lambda m: m["digest"]), "")
    both = met.select("tree", "chunk", F.struct("step", side(lambda m: m["place"] < F.col("at.place")).alias("before"), side(lambda m: m["place"] > F.col("at.place")).alias("after")).alias("s"))
    found = both.groupBy("tree", "chunk").agg(F.array_sort(F.collect_list("s")).alias("path"))
    return chunks.select("tree", "chunk").join(found, ["tree", "chunk"], "left")


PROVED = "order_key bigint, leaf string, tree bigint, proof string, folded_root string"
_PROVED = pa.schema([("order_key", pa.int64()), ("leaf", pa.string()), ("tree", pa.int64()), ("proof", pa.string()), ("folded_root", pa.string())])


def _prove(as_digest: bool, chunk: int):
    """The proof of each leaf of a chunk, and the root that its leaf as it is seen now folds to."""

    def run(leaves: pa.Table, paths: pa.Table) -> pa.Table:
        rows = leaves.sort_by("place").to_pylist()
        if not rows:
            return _PROVED.empty_table()
        path = [(s["before"], s["after"]) for s in paths.column("path").to_pylist()[0] or ()]
        levels, width = [[r["leaf"] for r in rows]], rows[0]["size"]
        while width > 1 and len(levels) <= chunk:
            last, width = levels[-1], -(-width // 8)
            levels.append([digest(*last[i : i + 8]) for i in range(0, len(last), 8)])
        steps: list[tuple] = [((b, a), None) for b, a in path]

        def beside(level: int, i: int) -> tuple[str, str]:
            nodes, first = levels[level], i >> 3 << 3
            return "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 8])

        tails = {(len(levels) - 1, 0): [s for s, _ in steps]}
        for level in range(len(levels) - 2, 0, -1):
            for i in range(len(levels[level])):
                tails[level, i] = [beside(level, i), *tails[level + 1, i >> 3]]
            for i in range(len(levels[level + 1])):
                tails.pop((level + 1, i), None)
        proofs, folded = [], []
        for i, r in enumerate(rows):
            way = [beside(0, i), *tails[1, i >> 3]] if len(levels) > 1 else tails[0, 0]
            value = r["seen"] or r["leaf"]
            for before, after in way:
                value = digest(before, value, after)
            folded.append(value)
            joined = "".join(b + a for b, a in way)
            proofs.append(digest(joined) if as_digest else joined)
        return pa.table([[r["order_key"] for r in rows], levels[0], [r["tree"] for r in rows], proofs, folded], _PROVED)

    return run


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, seen: Column | None = None, as_digest: bool = False, chunk: int = CHUNK) -> DataFrame:
    """order column, leaf, subroot, root, proof (its siblings from the leaf to the root, joined; their SHA-256 if as_digest), folded_root, verified.

    columns: what a leaf covers. seen: the leaf of the row as it is found now, null where it is untouched; folded_root is made of it and the proof.
    """
    spark = docs.sparkSession
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit(":"), F.col(group).cast("string")))  # null first, then by bytes
    leaves = docs.select(F.col(order).cast("bigint").alias("order_key"), leaf_of(*[F.col(c) for c in columns]).alias("leaf"), (F.lit(None).cast("string") if seen is None else seen).alias("seen"), key.alias("name"))
    rows = settle(placed(settle(leaves), "name", "order_key", "leaf", known=numbered).drop("name").sortWithinPartitions("tree", "place"))
    trees = rows.where(F.col("place") == 0).select("tree", "trees", "size")

    grown = settle(rows.select("tree", "size", "trees", "place", "leaf").mapInArrow(_grown(chunk), f"{NODE}, waits boolean, size bigint, trees bigint"))
    fragments = grown.where("waits").rdd.mapPartitions(_forest(chunk))
    if not fragments.getNumPartitions():
        return spark.createDataFrame([], f"{order} bigint, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")
    whole = fragments.treeReduce(Forest.merge, depth=3)
    root = whole.root
    if root is None:  # a lone task has finished it, or there are no rows
        first = grown.where((F.col("tree") == ROOT) & ~F.col("waits")).orderBy(F.desc("level")).first()
        root = first["digest"] if first else None
    nodes = grown.where(~F.col("waits")).select("tree", "level", "place", "digest").unionByName(spark.createDataFrame(whole.used, NODE))
    nodes = settle(nodes)
    subroots = nodes.where((F.col("tree") == ROOT) & (F.col("level") == 0)).select(F.col("place").alias("tree"), F.col("digest").alias("subroot"))

    in_chunks = rows.select("tree", F.shiftright("place", 3 * chunk).alias("chunk"), "place", "size", "order_key", "leaf", "seen")
    paths = _paths(trees, nodes, chunk).select(F.col("tree").alias("of"), F.col("chunk").alias("part"), "path")
    proved = in_chunks.groupBy("tree", "chunk").cogroup(paths.groupBy("of", "part")).applyInArrow(_prove(as_digest, chunk), PROVED)
    out = spread_join(proved, subroots, "tree", F.col("leaf")).withColumn("root", F.lit(root))
    return out.select(F.col("order_key").alias(order), "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
