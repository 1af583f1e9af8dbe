"""Hard negatives by a kNN join over Voronoi partitions.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, and anchors 0: then the distance of an anchor a and
a row x is |a|^2 + M^2 - 2 a.x, so near means a high product. At most ``PIVOTS`` rows, the first by a hash of the id, serve
as pivots. Each anchor belongs to the group of its nearest pivot, each row to the cell of its nearest pivot; a group keeps
its radius and the range of its norms. A row is sent to a group only if, by the triangle inequality over the group's pivot,
some anchor of the group might need it:

1. home: the rows of a group's own cell give each anchor its first positives; the worst fifth score of a group is its floor.
2. positives: rows of other cells whose bound reaches the floor. Both together hold the exact positives.
3. negatives: rows whose bounds meet the range of scores that the positives of the group allow.

Groups are cut into blocks of about ``ANCHORS`` anchors and rows into slices by a hash of the id, so that a cell or a vector
that holds most rows is spread; a task joins one block with one slice. Statistics that pass through the driver are a few
numbers a pivot.

Rows that take no part: see ``vectors``, and rows with a null label. A null condition on an anchor is false. Ties go to the
smaller id; of rows that share an id the one with the smallest vector, then label, takes part; an anchor without positives,
and a pair without negatives, gives no row; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import mix, out_batch, settle
from .vectors import LOW, PACKED, Exact, best, matrices, pack, rows_of, unpack

PIVOTS, ANCHORS, SLICE, CHUNK = 256, 1024, 1 << 17, 4096
SLACK = 1e-6  # share by which rounded bounds are widened

PACK = f"ids binary, labels binary, {PACKED}, top double"
ROW = f"id bigint, label bigint, {PACKED}"
SENT = f"cell bigint, ids binary, labels binary, {PACKED}"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _packed(scale: float):
    """Batches of (id, x, label) as packs, with the largest squared norm of each."""
    schema = _arrow(PACK)

    def run(batches):
        for batch in batches:
            ids, labels = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 2))
            for at, x in matrices(batch.column(1), scale):
                yield out_batch(schema, ids=[ids[at].tobytes()], labels=[labels[at].tobytes()], top=[float((x.astype(np.float64) ** 2).sum(1).max(initial=0))], **{k: [v] for k, v in pack(x).items()})

    return run


class Pivots:
    """Pivots in the widened space, and distances to them."""

    def __init__(self, x: np.ndarray, top: float):
        self.x, self.top = x, top
        self.last = np.sqrt(np.maximum(top - (x**2).sum(1), 0))

    def products(self, x: np.ndarray) -> np.ndarray:
        d = min(x.shape[1], self.x.shape[1])
        return x[:, :d] @ self.x[:, :d].T

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(self.top - (x**2).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.top - 2 * (self.products(x) + own[:, None] * self.last), 0))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + self.top - 2 * self.products(x), 0))


def _anchors(pivots: Pivots):
    """Anchors as rows with their group, distance to its pivot and squared norm."""
    schema = _arrow(f"{ROW}, g int, away double, norm double")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, ids, labels = unpack(row), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                whole = x.astype(np.float64)
                away = pivots.of_anchors(whole)
                g = away.argmin(1)
                yield out_batch(schema, id=ids, label=labels, code=[row["code"]] * len(ids), width=[row["width"]] * len(ids), xs=[v.tobytes() for v in x], g=g.astype(np.int32), away=away[np.arange(len(g)), g], norm=(whole**2).sum(1))

    return run


class Groups:
    """What the driver knows of the groups: one number a pivot each. wanted(): which rows a group might need."""

    def __init__(self, pivots: Pivots, stats: dict[int, tuple], slices: int, size: int):
        p = len(pivots.x)
        self.pivots, self.slices = pivots, slices
        get = lambda i, default: np.array([stats[g][i] if g in stats else default for g in range(p)], np.float64)
        self.n, self.radius, self.high, self.low = get(0, 0), get(1, 0), get(2, 0), get(3, 0)
        self.blocks = np.ceil(self.n / size).astype(np.int64)
        self.base = np.cumsum(self.blocks) - self.blocks

    def wanted(self, x: np.ndarray, least: np.ndarray, most: np.ndarray, skip_home: bool) -> np.ndarray:
        """Rows by groups: whether some score of the group with the row may lie from least to most."""
        away = self.pivots.of_rows(x)
        top, wide = self.pivots.top, 1 + SLACK
        near, far = np.maximum(away - self.radius * wide - SLACK * np.sqrt(top + 1), 0), (away + self.radius) * wide
        size = SLACK * (self.high + top + 1)
        got = ((self.high + top - near**2) / 2 + size >= least) & ((self.low + top - far**2) / 2 - size <= most) & (self.n > 0)
        if skip_home:
            got[np.arange(len(x)), away.argmin(1)] = False
        return got

    def home(self, x: np.ndarray) -> np.ndarray:
        got = np.zeros((len(x), len(self.n)), bool)
        got[np.arange(len(x)), self.pivots.of_rows(x).argmin(1)] = True
        return got & (self.n > 0)


def _send(groups: Groups, wanted):
    """Packs of rows for each cell (a block of a group, and a slice) that might need them."""
    schema = _arrow(SENT)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, ids, labels = unpack(row), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                to, part = wanted(x.astype(np.float64)), (mix(ids.astype(np.uint64)) % np.uint64(groups.slices)).astype(np.int64)
                for s in np.unique(part):
                    own = part == s
                    for g in np.flatnonzero(to[own].any(0)):
                        at = own & to[:, g]
                        for b in range(groups.blocks[g]):
                            yield out_batch(schema, cell=[int((groups.base[g] + b) * groups.slices + s)], ids=[ids[at].tobytes()], labels=[labels[at].tobytes()], code=[row["code"]], width=[row["width"]], xs=[x[at].tobytes()])

    return run


def _stacked(vectors: list[np.ndarray]) -> np.ndarray:
    """Rows of any length as one matrix, the missing components 0."""
    wide = np.zeros((len(vectors), max((v.shape[0] for v in vectors), default=0)), np.result_type(*vectors) if vectors else np.int64)
    for i, v in enumerate(vectors):
        wide[i, : len(v)] = v
    return wide


def _side(anchors: pa.Table):
    rows = anchors.to_pylist()
    return rows, Exact(_stacked([np.frombuffer(r["xs"], r["code"]) for r in rows]))


def _chunks(packs: pa.Table):
    """Rows of a cell, ascending by id, at most CHUNK at a time: (ids, labels, matrix)."""
    for row in packs.to_pylist():
        ids, labels, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), unpack(row)
        order = np.argsort(ids)
        for i in range(0, len(ids), CHUNK):
            at = order[i : i + CHUNK]
            yield ids[at], labels[at], Exact(x[at])


FIRST = "anchor_id bigint, g int, positive_id bigint, score bigint"


def _positives(k: int):
    """The first k rows of a cell with the anchor's label, for each anchor of the block."""
    schema = _arrow(FIRST)

    def run(anchors, packs):
        rows, a = _side(anchors)
        own, label, g = (np.array([r[c] for r in rows], np.int64) for c in ("id", "label", "g"))
        parts = []
        for ids, labels, x in _chunks(packs):
            for value in np.intersect1d(label, labels):
                asks, has = np.flatnonzero(label == value), np.flatnonzero(labels == value)
                scores = a.times(x, asks, has)
                scores[own[asks][:, None] == ids[has]] = LOW
                s, i = best(scores, ids[has], k)
                at, place = np.nonzero(s > LOW)
                parts = _firsts([*parts, (asks[at], i[at, place], s[at, place])], k)
        if not parts:
            return schema.empty_table()
        at, found, s = parts[0]
        return pa.table([own[at], g[at].astype(np.int32), found, s], schema)

    return run


def _firsts(parts: list[tuple], k: int) -> list[tuple]:
    """One (asker, id, score) of several: the first k rows of each asker, by score down and id up."""
    who, ids, scores = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((ids, -scores, who))
    who = who[order]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]][: len(who)])
    kept = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)])) < k
    return [(who[kept], ids[order][kept], scores[order][kept])]


PAIRED = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def allowed(score: int, least: int, most: int) -> tuple[int, int]:
    """The whole scores n with least * score <= 100 * n <= most * score."""
    return -(-least * score // 100), most * score // 100


def _ranged(scores: np.ndarray, ids: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """(pair, id, score) of the first k rows of each pair, a range of the scores of one anchor: each anchor's scores are sorted once."""
    m = len(ids)
    known = scores > LOW
    if np.abs(scores, where=known, out=np.zeros_like(scores)).max(initial=0) >= (1 << 62) // m:
        picked = [[j for j in np.lexsort((ids, -scores[a])) if low[p] <= scores[a, j] <= high[p] and known[a, j]][:k] for p, a in enumerate(of)]
        pair, place = (np.array(v, np.int64) for v in ([p for p, own in enumerate(picked) for _ in own], [j for own in picked for j in own]))
        return pair, ids[place], scores[of[pair], place]
    keys = np.sort(np.where(known, scores * m - np.arange(m), LOW), axis=1)
    most = (1 << 62) // m - 1
    stop = np.array([np.searchsorted(keys[a], min(h, most) * m, "right") for a, h in zip(of, high)], np.int64)
    at = stop[:, None] - 1 - np.arange(k)
    got = np.where(at >= 0, keys[of[:, None], np.maximum(at, 0)], LOW)
    s = -((-got) // m)
    pair, place = np.nonzero((got > LOW) & (s >= low[:, None]))
    return pair, ids[s[pair, place] * m - got[pair, place]], s[pair, place]


def _negatives(k: int, least: int, most: int):
    """For each anchor and positive the first k rows of a cell with another label and an allowed score."""
    schema = _arrow(PAIRED)

    def run(anchors, packs):
        rows, a = _side(anchors)
        own, label = (np.array([r[c] for r in rows], np.int64) for c in ("id", "label"))
        pairs = [(i, p["positive_id"], p["score"], *(min(max(v, LOW + 1), -LOW) for v in allowed(p["score"], least, most))) for i, r in enumerate(rows) for p in r["positives"]]
        of, positive, score, low, high = (np.array(v, np.int64) for v in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 5
        parts = []
        for ids, labels, x in _chunks(packs):
            for i in range(0, len(pairs), 512):
                mine = slice(i, i + 512)
                asks, back = np.unique(of[mine], return_inverse=True)
                scores = a.times(x, asks)
                scores[label[asks][:, None] == labels] = LOW
                at, found, s = _ranged(scores, ids, back, low[mine], high[mine], k)
                parts.append((at + i, found, s))
            parts = _firsts(parts, k) if parts else parts
        if not parts:
            return schema.empty_table()
        at, found, s = parts[0]
        return pa.table([own[of[at]], positive[at], score[at], found, s], schema)

    return run


def _join(anchors: DataFrame, packs: DataFrame, groups: Groups, wanted, local, out: str) -> DataFrame:
    """local() over each block of anchors and the rows of each slice that it might need."""
    sliced = anchors.withColumn("cell", F.explode(F.sequence(F.col("block") * groups.slices, (F.col("block") + 1) * groups.slices - 1)))
    return sliced.groupBy("cell").cogroup(packs.mapInArrow(_send(groups, wanted), SENT).groupBy("cell")).applyInArrow(lambda a, b: local(a, b), out)


def _first(df: DataFrame, keys: list[str], score: str, row_id: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), row_id))).where(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90, scale: float = 256.0, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", pivots: int = PIVOTS, anchors: int = ANCHORS, slice_rows: int = SLICE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor (a condition on the id) and each of its n_positives best rows of its label: the n_negatives best rows of
    other labels with least * positive_score <= 100 * negative_score <= most * positive_score.
    """
    spark = df.sparkSession
    known = settle(rows_of(df.where(F.col(label).isNotNull()).select(id_column, vector, F.col(label).cast("bigint").alias("_l")), id_column, vector, "_l"))
    packs = settle(known.mapInArrow(_packed(scale), PACK))
    sizes = packs.agg(F.sum(F.octet_length("ids")).alias("n"), F.max("top").alias("top")).first()
    n, top = int(sizes["n"] or 0) // 8, float(sizes["top"] or 0) * (1 + 1e-9)
    asked = known.withColumnRenamed("id", id_column).where(is_anchor).withColumnRenamed(id_column, "id").select("id", "x", "_l")
    asked = settle(asked.mapInArrow(_packed(scale), PACK))
    n_asked = int(asked.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 8
    if not n_asked:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")

    chosen = known.select("id", "x").orderBy(F.xxhash64("id")).limit(min(pivots, max(4, n_asked // 256))).collect()  # at most PIVOTS rows
    around = Pivots(np.floor(np.nan_to_num(_stacked([np.array(r["x"], np.float64) for r in chosen]) * scale)), top)
    around.top = max(around.top, float((around.x**2).sum(1).max()))
    grouped = asked.mapInArrow(_anchors(around), f"{ROW}, g int, away double, norm double")
    stats = {r["g"]: (r["n"], r["away"], r["high"], r["low"]) for r in grouped.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away"), F.max("norm").alias("high"), F.min("norm").alias("low")).collect()}
    blocks = sum(-(-int(s[0]) // anchors) for s in stats.values())
    slices = max(1, -(-n // slice_rows), min(-(-n // 2048), 4 * spark.sparkContext.defaultParallelism // blocks))
    groups = Groups(around, stats, slices, anchors)

    base = F.element_at(F.lit(groups.base.tolist()), F.col("g") + 1)
    count = F.element_at(F.lit(np.maximum(groups.blocks, 1).tolist()), F.col("g") + 1)
    blocked = settle(grouped.select("id", "label", "code", "width", "xs", "g", (base + F.pmod(F.xxhash64("id"), count)).cast("bigint").alias("block")))

    anywhere, p = np.full(len(around.x), np.inf), len(around.x)
    home = settle(_join(blocked, packs, groups, groups.home, _positives(n_positives), FIRST))
    kth = _first(home, ["anchor_id"], "score", "positive_id", n_positives).where(F.col("rank") == n_positives)
    floor = {r["g"]: r["least"] for r in kth.groupBy("g").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).collect() if r["n"] == stats[r["g"]][0]}
    floors = np.array([float(floor.get(g, -np.inf)) for g in range(p)])
    more = _join(blocked, packs, groups, lambda x: groups.wanted(x, floors, anywhere, True), _positives(n_positives), FIRST)
    positives = settle(_first(home.unionByName(more), ["anchor_id"], "score", "positive_id", n_positives))

    bound = lambda percent: F.col("score").cast("double") * (percent / 100)
    ranges = positives.where(F.col("score") >= 0).groupBy("g").agg(F.min(bound(least)).alias("least"), F.max(bound(most)).alias("most")).collect()
    from_, to = np.full(p, np.inf), np.full(p, -np.inf)
    for r in ranges:
        from_[r["g"]], to[r["g"]] = r["least"] - 1, r["most"] + 1
    paired = positives.where(F.col("score") >= 0).groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))  # at most n_positives
    found = _join(blocked.join(paired, "id"), packs, groups, lambda x: groups.wanted(x, from_, to, False), _negatives(n_negatives, least, most), PAIRED)
    return _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
