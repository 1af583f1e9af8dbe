"""Mixing sources to target weights: Sainte-Laguë apportionment of equal blocks of words, then seeded block selection.

1. ``source_targets``: sources by code point, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` of all words; a target
   stops at ``LIMIT`` times the source's size and the excess is shared again by weight. One row a source.
2. ``apportion``: blocks of ``block`` words go to the highest quotients target / (2a + 1), first to sources, then within each
   source to its shards. Only the quotients near the cut are compared: a divisor a little too large gives each party the
   blocks it surely has, one a little too small those it may have, and the two differ by about two rows a party.
3. In each shard (about ``SHARD_DOCS`` documents), documents stand in seeded order on a line of words cut into blocks; a
   seeded arc of consecutive blocks is taken, beside the whole line once where the quota exceeds the line.

Null or empty texts have size 0 and nothing is taken of them. Equal (doc_id, size) rows are ranked by size alone, so repeated
rows may swap their takes but the result is the same set of rows on each run. A source without words has target 0.
Empty table: no rows. Extra columns are kept by ``mix``. Only small rows (id, source, size) are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import settle

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
SEED = "mix-1"
SHARD_DOCS = 4096
MAX_BLOCK = 1024


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, n_docs, target. Capped sources come first when ordered by cap / weight, so one running sum finds the level."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn("cap", F.col("source_size") * limit)
    line = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) * share - before) / rest
    per = per.withColumn("level", level).withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    cut = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(every)["level"]
    return per.withColumn("target", F.when(F.col("open"), F.col("weight") * cut).otherwise(F.col("cap"))).select("source", "source_size", "n_docs", "target")


def apportion(parties: DataFrame, within: list[str], key: list[Column], votes: str, seats: str, into: str) -> DataFrame:
    """Sainte-Laguë: parties with column ``into``, their share of ``seats`` (constant within each group) by ``votes``; ties go to the smaller key."""
    group = Window.partitionBy(*within)
    total, m = F.sum(votes).over(group), F.count(F.lit(1)).over(group)
    n = F.col(seats).cast("double")
    counted = parties.withColumn("_ff_sum", total).withColumn("_ff_m", m)
    sure = F.greatest(F.floor(F.col(votes) * (n - F.col("_ff_m") / 2 - 1) / F.col("_ff_sum") + 0.5), F.lit(0))
    may = F.ceil(F.col(votes) * (n + F.col("_ff_m") / 2 + 1) / F.col("_ff_sum") + 0.5)
    some = (F.col("_ff_sum") > 0) & (F.col(votes) > 0) & (n > 0)
    counted = counted.withColumn("_ff_sure", F.when(some, sure).otherwise(0).cast("bigint")).withColumn("_ff_may", F.when(some, may).otherwise(0).cast("bigint"))
    counted = counted.withColumn("_ff_left", F.col(seats) - F.sum("_ff_sure").over(group))
    bids = counted.withColumn("_ff_a", F.explode_outer(F.when(F.col("_ff_may") > F.col("_ff_sure"), F.sequence(F.col("_ff_sure"), F.col("_ff_may") - 1))))
    bid = F.when(F.col("_ff_a").isNotNull(), F.col(votes) / (2 * F.col("_ff_a") + 1))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(bid.desc_nulls_last(), *key, F.col("_ff_a")))
    won = bids.withColumn("_ff_won", F.when(F.col("_ff_a").isNotNull() & (rank <= F.col("_ff_left")), 1).otherwise(0))
    keep = [c for c in parties.columns]
    return won.groupBy(*keep, "_ff_sure").agg(F.sum("_ff_won").alias("_ff_won")).withColumn(into, (F.col("_ff_sure") + F.col("_ff_won")).cast("bigint")).select(*keep, into)


def seeded(*parts: Column) -> Column:
    """A seeded number of 60 bits that any engine with MD5 can make."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary")), 1, 15), 16, 10).cast("bigint")


def plan(sizes: DataFrame, **rule) -> DataFrame:
    """sizes (doc_id, source, size) with source_size, target and taken."""
    sources = settle(source_targets(sizes, **rule).withColumn("shards", F.ceil(F.col("n_docs") / SHARD_DOCS).cast("bigint")))
    least = sources.where("target > 0").agg(F.min("target").alias("t"), F.sum("target").alias("s")).first()
    block = max(1, min(MAX_BLOCK, int((least["t"] or 0) // 1000)))
    seats = int((least["s"] or 0) / block + 0.5)
    quotas = apportion(sources.withColumn("seats", F.lit(seats).cast("bigint")), [], [F.col("source").asc_nulls_last()], "target", "seats", "quota")

    placed = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select(sizes["doc_id"], sizes["source"], "size", "source_size", "target", "shards")
    placed = placed.withColumn("draw", seeded(F.col("doc_id"))).withColumn("shard", F.pmod(seeded(F.lit("shard"), F.col("doc_id")), F.col("shards")))
    per_shard = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    per_shard = per_shard.join(quotas.select(F.col("source").alias("s"), "quota"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    shares = apportion(per_shard, ["source"], [F.col("shard")], "shard_size", "quota", "blocks").select(F.col("source").alias("s"), F.col("shard").alias("h"), "shard_size", "blocks")

    line = Window.partitionBy("source", "shard").orderBy("draw", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("stop", F.sum("size").over(line))
    dealt = placed.join(shares, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
    cells = F.ceil(F.col("shard_size") / block).cast("bigint")
    dealt = dealt.withColumn("cells", cells).withColumn("start", F.col("stop") - F.col("size"))
    dealt = dealt.withColumn("blocks", F.least(F.col("blocks"), 2 * F.col("cells")))
    first = F.pmod(seeded(F.lit("arc"), F.col("source"), F.col("shard")), F.greatest(F.col("cells"), F.lit(1)))
    dealt = dealt.withColumn("first", first).withColumn("arc", F.when(F.col("blocks") >= F.col("cells"), F.col("blocks") - F.col("cells")).otherwise(F.col("blocks")))
    overlap = lambda a, b: F.greatest(F.least(F.col("stop"), b) - F.greatest(F.col("start"), a), F.lit(0))
    over = F.greatest(F.col("first") + F.col("arc") - F.col("cells"), F.lit(0))
    taken = F.when(F.col("blocks") >= F.col("cells"), F.col("size")).otherwise(0) + overlap(F.col("first") * block, F.least(F.col("first") + F.col("arc"), F.col("cells")) * block) + overlap(F.lit(0), over * block)
    return dealt.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(0).cast("bigint").alias("taken"))


def sizes_of(docs: DataFrame) -> DataFrame:
    return settle(docs.select("doc_id", "source", words(F.col("text")).alias("size")))


def mix(docs: DataFrame, **rule) -> DataFrame:
    """The documents of the mix: docs with ``taken`` words (counting repeats) where any are taken. Of equal (doc_id, source, size) rows each has the same take."""
    name = "taken" if "taken" not in docs.columns else "_ff_taken"
    takes = plan(sizes_of(docs), **rule).groupBy("doc_id", "source", "size").agg(F.max("taken").alias("t"))
    takes = takes.where("t > 0").select(F.col("doc_id").alias("_ff_d"), F.col("source").alias("_ff_s"), F.col("size").alias("_ff_n"), F.col("t").alias(name))
    keyed = docs.withColumn("_ff_size", words(F.col("text")))
    same = keyed["doc_id"].eqNullSafe(takes["_ff_d"]) & keyed["source"].eqNullSafe(takes["_ff_s"]) & (keyed["_ff_size"] == takes["_ff_n"])
    return keyed.join(takes, same).select(*[keyed[f"`{c}`"] for c in docs.columns], name)
