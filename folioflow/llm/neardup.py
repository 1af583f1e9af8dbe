"""N-gram Jaccard join: MinHash bands find candidates, pairs are verified on whole n-gram sets.

Words are white-space words with A-Z lowered; a document's set has its runs of WIDTH words (a text of fewer words, but not
none, is one run). Bands and rows are chosen so that a pair at the threshold shares a band with probability RECALL.

Copies (equal word sequences) collapse to one node. Each band bucket links its nodes to its smallest node, so candidates
grow with nodes and not with pairs; the connected candidates meet in groups, and each group counts, for each node, the
partners at or above the threshold. A component of more than BLOCK nodes is cut into blocks and each pair of blocks is a
group of its own; small components share groups. Inside a group an inverted index gives exact intersections. A group
returns a link count and one edge a node; classes are the connected components of those edges.

Null or empty text: no set, no links, a class of its own. Repeated rows are copies of each other. Ties: a class is named by
its smallest doc_id (nulls only where a class has nothing else). Empty table: no rows. Extra columns are ignored by
``classes`` and kept by ``representatives``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import _U, mix, settle, shingles, span_hash, spread_join, words_of
from .graph import components

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
BLOCK = 512


def choose(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows a band (fewest false candidates) that reach the recall within so many hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall within so many hashes")
    return best


SIGNED = "doc_id bigint, row_hash bigint, node bigint, check_hash bigint, bands array<bigint>"


def signatures(docs: DataFrame, bands: int, rows: int, width: int = WIDTH) -> DataFrame:
    """doc_id, row_hash, node (hash of the word sequence; null without words), check_hash, bands."""
    factors = mix(np.arange(1, bands * rows + 1, dtype=_U)) | _U(1)

    def run(batches):
        for batch in batches:
            for w in words_of(batch.column(2)):
                h, m = w.hashes(folded=True), w.last - w.first
                node, check = span_hash(h, w.of[:-1], w.of[1:]), span_hash(mix(h + _U(1)), w.of[:-1], w.of[1:])
                s, own = shingles(h, w.of, width)
                full = np.flatnonzero(np.diff(w.of))
                begin = np.searchsorted(own, full)
                keys = np.zeros((len(full), bands), _U)
                for k in range(bands if len(full) else 0):
                    key = np.full(len(full), k, _U)
                    for f in factors[k * rows : (k + 1) * rows]:
                        key = mix(key * _U(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(s * f, begin))
                    keys[:, k] = key
                offsets = np.zeros(m + 1, np.int32)
                offsets[1:] = np.cumsum(np.where(np.diff(w.of) > 0, bands, 0))
                none = np.diff(w.of) == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, m), batch.column(1).slice(w.first, m), pa.array(node.view(np.int64), mask=none), pa.array(check.view(np.int64), mask=none), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))],
                    names=["doc_id", "row_hash", "node", "check_hash", "bands"],
                )

    return _keyed(docs).mapInArrow(run, SIGNED)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_hash"), F.col("text").cast("string").alias("text"))


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """u, v: each node of a band bucket and the bucket's smallest node."""
    entries = nodes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    least = entries.groupBy("bucket").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v <> most").select("bucket", "v")
    return entries.join(least, "bucket").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


VERIFIED = "node bigint, links bigint, root bigint"


def compare(sets: list[np.ndarray], nodes: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member (partners' copies at or above the threshold between left and right) and its root among linked members.

    left, right: which members stand on either side; a pair is looked at if one is left and the other right.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets) if n else np.zeros(0, _U)
    owner = np.repeat(np.arange(n), sizes)
    _, ids, count = np.unique(every, return_inverse=True, return_counts=True)
    order = np.argsort(ids, kind="stable")
    posted, start = owner[order], np.concatenate([[0], np.cumsum(count)])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    links, root = np.zeros(n, np.int64), np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in np.flatnonzero(left):
        own = ids[begin[a] : begin[a + 1]]
        own = own[count[own] > 1]
        lengths = count[own]
        if not len(own):
            continue
        at = np.repeat(start[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(posted[at], minlength=n)
        # one side's pairs are seen from the left member only; within one side, from the smaller member
        ok = right & (common >= threshold * (sizes + sizes[a] - common) - 1e-9) & (common > 0)
        ok[a] = False
        ok &= ~left | (np.arange(n) > a)
        b = np.flatnonzero(ok)
        if len(b):
            links[a] += copies[b].sum()
            links[b] += copies[a]
            r = find(int(a))
            for x in b:
                y = find(int(x))
                if y != r:
                    low, high = (r, y) if nodes[r] < nodes[y] else (y, r)
                    root[high] = low
                    r = low
    return links, np.array([find(i) for i in range(n)], np.int64)


def verified(docs: DataFrame, members: DataFrame, threshold: float, width: int = WIDTH) -> DataFrame:
    """node, links, root from each group. members: doc_id, row_hash, node, copies, label, size (of the candidate component)."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    m = members.select(F.col("doc_id").alias("d"), F.col("row_hash").alias("r"), "node", "copies", "label", blocks.alias("blocks"), "size")
    k = _keyed(docs)
    rows = k.join(m, k["doc_id"].eqNullSafe(m["d"]) & (k["row_hash"] == m["r"])).select("node", "copies", "label", "blocks", "text")

    def sets(batches):
        for batch in batches:
            for w in words_of(batch.column(4)):
                s, own = shingles(w.hashes(folded=True), w.of, width)
                cut = np.searchsorted(own, np.arange(w.last - w.first + 1))
                blobs = [np.unique(s[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(w.first, w.last - w.first) for c in range(4)], pa.array(blobs, pa.binary())], names=["node", "copies", "label", "blocks", "grams"])

    rows = rows.mapInArrow(sets, "node bigint, copies bigint, label bigint, blocks int, grams binary")
    total = F.lit(max(1, members.where(F.col("size") <= BLOCK).count() // (BLOCK // 2)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", own)
    # a block meets each block once: as (smaller, larger)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select("node", "copies", "grams", "block", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), total)).otherwise(F.col("label")).alias("group"), F.col("blocks"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def group(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table["node"].to_numpy(), return_index=True)
        copies, block = table["copies"].to_numpy()[first], table["block"].to_numpy()[first]
        grams = table["grams"]
        held = [np.frombuffer(grams[int(x)].as_py(), _U) for x in first]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        links, root = compare(held, nodes, copies, block == i, block == j, threshold)
        return pa.table({"node": nodes, "links": links, "root": nodes[root]})

    return rows.groupBy("group", "blocks", "i", "j").applyInArrow(group, VERIFIED)


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, row_hash, class_id (smallest doc_id of the class), n_links (other documents at or above the threshold), node, label (of the class; rows
    that share a doc_id may stand in several). node and label are null without words."""
    signed = settle(signatures(docs, *choose(threshold, recall)))
    nodes = settle(signed.where("node IS NOT NULL").groupBy("node", "check_hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("row_hash").alias("row_hash"))).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")))
    joined = components(candidate_edges(nodes))
    sizes = joined.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    members = spread_join(joined, sizes, "label", F.col("node")).join(nodes, "node").select("first.doc_id", "first.row_hash", "node", "copies", "label", "size")
    checked = settle(verified(docs, settle(members), threshold))
    labels = components(checked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies", F.col("first.doc_id").alias("first_id")).join(links, "node", "left").join(labels, "node", "left")
    known = known.withColumn("label", F.coalesce("label", "node"))
    named = known.groupBy("label").agg(F.min("first_id").alias("class_id"))
    known = spread_join(known, named, "label", F.col("node")).select("node", "label", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # rows without words go round the join; copies of one text share a node and are spread
    out = spread_join(signed.where("node IS NOT NULL").select("doc_id", "row_hash", "node"), known, "node", F.struct("doc_id", "row_hash"))
    none = signed.where("node IS NULL").select("doc_id", "row_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), "node", F.lit(None).cast("bigint").alias("label"))
    return out.select("doc_id", "row_hash", "class_id", F.col("n_links").cast("bigint").alias("n_links"), "node", "label").unionByName(none)


def representatives(docs: DataFrame, **rule) -> DataFrame:
    """docs with one row of each class, all columns kept: the one with the class's smallest doc_id. Rows without words all stay."""
    found = settle(classes(docs, **rule))
    # of a class the smallest doc_id; of rows that share it the smallest row hash
    keep = found.where("node IS NOT NULL").where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("row_hash").alias("row_hash"), F.first("class_id").alias("class_id"))
    keep = keep.select(F.col("class_id").alias("_ff_d"), F.col("row_hash").alias("_ff_r"))
    keyed = docs.withColumn("_ff_key", F.xxhash64("doc_id", "text")).withColumn("_ff_words", F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    kept = keyed.where("_ff_words").join(keep, keyed["doc_id"].eqNullSafe(keep["_ff_d"]) & (keyed["_ff_key"] == keep["_ff_r"]))
    return kept.dropDuplicates(["_ff_d", "_ff_r"]).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(keyed.where("NOT _ff_words").select(*[F.col(f"`{c}`") for c in docs.columns]))
