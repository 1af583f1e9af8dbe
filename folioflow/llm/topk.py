"""Exact top-k search by inner product: k-d trees a shard, walked with box bounds and a kth score that is handed on.

Rows are cut into shards of at most ``SHARD`` vectors as they are read, one tree a shard: the widest side is split at its
median place until a leaf has at most ``LEAF`` rows; each node keeps its tight box and its smallest id. A box bounds the
product with a query from above, so a block of queries walks a tree level by level and drops nodes that cannot beat its kth
score; then each query visits its leaves from the highest bound down, until the bound falls below its kth.

Blocks of queries meet groups of shards in cells, both of bounded size. In a first round each block searches one group;
the kth scores found there go with the block to all other groups, where a cell hands them on from tree to tree.

Rows that take no part: see ``vectors``. A query without other rows has no result; an empty table gives none. Ties go to the
smaller id, also between equal vectors, however many: a node whose bound equals the kth score is dropped if its smallest id
is not smaller. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import out_batch, settle
from .vectors import HIGH, LOW, PACKED, Exact, best, matrices, merged, narrow, nothing, pack, rows_of, unpack

SHARD, LEAF, BLOCK = 8192, 256, 1024
GROUP = 64  # shards, and blocks, that one cell holds at most on average

TREE = f"ids binary, {PACKED}, low binary, high binary, first binary"
QUERY = f"ids binary, {PACKED}"
STATE = f"{QUERY}, scores binary, found binary"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def bounds_of(n: int, leaf: int) -> list[list[tuple[int, int]]]:
    """Places of the nodes of a tree over n rows, by level: each node is halved until leaves have at most leaf rows."""
    levels = [[(0, n)]]
    while levels[-1][0][1] - levels[-1][0][0] > leaf:
        levels.append([half for a, b in levels[-1] for half in ((a, (a + b) // 2), ((a + b) // 2, b))])
    return levels


def build(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict:
    """A tree as one row: rows in leaf order, and the boxes and smallest ids of nodes level by level."""
    order = np.argsort(ids, kind="stable")
    levels = bounds_of(len(ids), leaf)
    for nodes in levels[:-1]:
        for a, b in nodes:
            own = x[order[a:b]]
            if own.shape[1]:
                widest = np.argmax(own.max(0).astype(np.float64) - own.min(0))
                order[a:b] = order[a:b][np.argsort(own[:, widest], kind="stable")]  # equal values stay by id
    for a, b in levels[-1]:
        order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
    ids, x = ids[order], x[order]
    every = [node for nodes in levels for node in nodes]
    low, high, first = (np.stack([f(v[a:b]) for a, b in every]) for f, v in ((lambda v: v.min(0), x), (lambda v: v.max(0), x), (np.min, ids)))
    return {"ids": ids.tobytes(), "low": low.tobytes(), "high": high.tobytes(), "first": first.tobytes(), **pack(x)}


class Tree:
    def __init__(self, row: dict, leaf: int = LEAF):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = Exact(unpack(row))
        self.levels = bounds_of(len(self.ids), leaf)
        shape = (sum(map(len, self.levels)), row["width"])
        self.low, self.high = (np.frombuffer(row[k], row["code"]).reshape(shape).astype(np.float64) for k in ("low", "high"))
        self.first = np.frombuffer(row["first"], np.int64)

    def upper(self, q: np.ndarray, nodes) -> np.ndarray:
        """The highest product of each query with a point of each node's box; a little more where floats round."""
        d = min(q.shape[1], self.low.shape[1])
        up, down, low, high = np.maximum(q[:, :d], 0), np.minimum(q[:, :d], 0), self.low[nodes, :d], self.high[nodes, :d]
        bound = up @ high.T + down @ low.T
        size = up @ np.abs(high).T - down @ np.abs(low).T
        return np.where(size < 2.0**52, bound, bound + size * 1e-9)


def beats(bound: np.ndarray, first: np.ndarray, state: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether a node can still give a row that goes before a query's kth."""
    kth, last = state[0][:, -1:], state[1][:, -1:]
    return (bound > kth) | ((bound == kth) & (first < last))


def search(tree: Tree, own: np.ndarray, q: Exact, state: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The state of the queries (ids own) after they have searched one tree."""
    whole, base, nodes, alive = q.of(np.float64), 0, np.zeros(1, np.int64), np.ones((len(own), 1), bool)
    for depth, level in enumerate(tree.levels):
        bound = tree.upper(whole, base + nodes)
        alive = alive & beats(bound, tree.first[base + nodes], state)
        if depth + 1 < len(tree.levels):
            kept = alive.any(0)
            nodes, alive = np.repeat(nodes[kept] * 2, 2) + np.tile([0, 1], int(kept.sum())), np.repeat(alive[:, kept], 2, axis=1)
            base += len(level)
        if not alive.any():
            return state
    bound = np.where(alive, bound, -np.inf)
    order = np.argsort(-bound, axis=1, kind="stable")
    scores, found = state[0].copy(), state[1].copy()
    for t in range(len(nodes)):
        at, rows = order[:, t], np.arange(len(own))
        live = np.flatnonzero((bound[rows, at] > -np.inf) & beats(bound[rows, at][:, None], tree.first[base + nodes[at]][:, None], (scores, found))[:, 0])
        for leaf in np.unique(at[live]):
            asks = live[at[live] == leaf]
            a, b = tree.levels[-1][nodes[leaf]]
            got = q.times(tree.x, asks, slice(a, b))
            got[tree.ids[a:b][None, :] == own[asks][:, None]] = LOW
            s, i = merged((scores[asks], found[asks]), best(got, tree.ids[a:b], k), k)
            scores[asks], found[asks] = s, np.where(s > LOW, i, HIGH)
        if not (bound[rows, at] >= scores[:, -1]).any():
            break
    return scores, found


def _packs(scale: float, most: int, make, schema):
    """Rows (id, x) of a task as packs of at most most rows of one length, each made by make(ids, matrix)."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids = np.asarray(batch.column(0)).astype(np.int64)
            for at, x in matrices(batch.column(1), scale):
                own = held.setdefault(x.shape[1], [])
                own.append((ids[at], x))
                while sum(len(i) for i, _ in own) >= most:
                    every, xs = np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own])
                    held[x.shape[1]] = own = [(every[most:], xs[most:])]
                    yield out_batch(schema, **{c: [v] for c, v in make(every[:most], narrow(xs[:most])).items()})
        for own in held.values():
            ids, xs = np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own])
            if len(ids):
                yield out_batch(schema, **{c: [v] for c, v in make(ids, narrow(xs)).items()})

    return run


def _arrow(spark, ddl: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in spark.createDataFrame([], ddl).schema])


def _block(row: dict, k: int):
    """The ids, vectors and state of a block of queries."""
    own = np.frombuffer(row["ids"], np.int64)
    state = nothing(len(own), k) if row.get("scores") is None else tuple(np.frombuffer(row[c], np.int64).reshape(-1, k) for c in ("scores", "found"))
    return own, Exact(unpack(row)), state


def _cell(blocks: pa.Table, shards: pa.Table, k: int, leaf: int):
    """(row, its state before, its state after) of each block of a cell: trees with the highest bounds first."""
    trees = [Tree(r, leaf) for r in shards.to_pylist()]
    for row in blocks.to_pylist():
        own, q, before = _block(row, k)
        state = before
        for tree in sorted(trees, key=lambda t: -t.upper(q.of(np.float64), np.zeros(1, np.int64)).mean()):
            state = search(tree, own, q, state, k)
        yield row, own, before, state


def _home(k: int, leaf: int, schema):
    """Blocks with the state of their first cell."""

    def run(blocks, shards):
        out = [{**row, "scores": s.tobytes(), "found": i.tobytes()} for row, _, _, (s, i) in _cell(blocks, shards, k, leaf)]
        return pa.Table.from_pylist(out, schema)

    return run


def _away(k: int, leaf: int, schema):
    """What a cell finds beyond the state that a block came with."""

    def run(blocks, shards):
        parts = []
        for _, own, before, (scores, found) in _cell(blocks, shards, k, leaf):
            new = (scores > LOW) & ~(found[:, :, None] == before[1][:, None, :]).any(2)
            asks, _ = np.nonzero(new)
            parts.append(pa.table([own[asks], found[new], scores[new]], schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def _listed(k: int, schema):
    """Rows of the states of blocks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own, _, (scores, found) = _block(row, k)
                asks, at = np.nonzero(scores > LOW)
                yield out_batch(schema, query_id=own[asks], vec_id=found[asks, at], score=scores[asks, at])

    return run


def top_k(df: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0, id_column: str = "vec_id", vector: str = "embedding", shard: int = SHARD, leaf: int = LEAF, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of df for which ``queries`` (a condition on the id) holds, its k best other rows."""
    spark = df.sparkSession
    tree, query, state, found = (_arrow(spark, s) for s in (TREE, QUERY, STATE, FOUND))
    rows = settle(rows_of(df, id_column, vector))
    deal = F.shiftright("n", 33) + F.col("n").bitwiseAND((1 << 33) - 1)
    number = lambda packs: settle(packs.withColumn("n", F.monotonically_increasing_id()).withColumn("n", deal))
    shards = number(rows.mapInArrow(_packs(scale, shard, lambda ids, x: build(ids, x, leaf), tree), TREE))
    asked = rows.withColumnRenamed("id", id_column).where(queries).select(id_column, "x")
    blocks = number(asked.repartition(max(1, -(-asked.count() // block))).mapInArrow(_packs(scale, block, lambda ids, x: {"ids": ids.tobytes(), **pack(x)}, query), QUERY))

    n_shards, n_blocks = shards.count(), blocks.count()
    across = max(1, -(-n_blocks // group))
    down = max(1, -(-n_shards // group), min(n_shards, 4 * spark.sparkContext.defaultParallelism // across))
    shards = shards.withColumn("down", F.pmod("n", F.lit(down))).withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).drop("n")
    blocks = blocks.withColumn("across", F.pmod("n", F.lit(across))).withColumn("home", F.pmod(F.shiftright("n", 1), F.lit(down)))
    cells = lambda side: side.groupBy(F.col("across").cast("bigint").alias("across"), F.col("down").cast("bigint").alias("down"))

    narrowed = blocks.withColumn("down", F.col("home"))
    keyed = lambda run, keys: lambda key, b, s: _keyed(run, keys, key, b, s)
    with_cell = pa.schema([*state, ("across", pa.int64()), ("home", pa.int64())])
    seeded = settle(cells(narrowed.drop("n", "home")).cogroup(cells(shards)).applyInArrow(keyed(_home(k, leaf, state), with_cell), f"{STATE}, across bigint, home bigint"))
    others = seeded.withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).where(F.col("down") != F.col("home")).drop("home")
    more = cells(others).cogroup(cells(shards)).applyInArrow(_away(k, leaf, found), FOUND)
    every = seeded.drop("across", "home").mapInArrow(_listed(k, found), FOUND).unionByName(more)
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _keyed(run, schema: pa.Schema, key, blocks: pa.Table, shards: pa.Table) -> pa.Table:
    """run's table with the cell it came from."""
    got = run(blocks, shards)
    return pa.table([*got.columns, *[pa.array([key[i].as_py()] * got.num_rows, pa.int64()) for i in range(2)]], schema)
