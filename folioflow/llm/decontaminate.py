"""Benchmark decontamination: a hash set of benchmark n-grams is probed by document windows; hits are verified and removed.

Words are runs of a-z, 0-9 and everything beyond ASCII, after lowering A-Z. A window is ``WINDOW`` consecutive words of an item,
or a shorter item's words as a whole.

1. The set holds the hashes of all n-grams of the windows, n = ``gram(width)`` words; for ten words n is 6. Any place of a window
   in a document holds such an n-gram that starts at a multiple of ``width - n + 1`` words, so only every fifth place of a
   document is hashed and probes the set. Rows carry the hash, the place and the document's key, never text.
2. The documents with a hit n-gram, and no others, are read again: the windows around each hit are compared with the
   benchmark's as texts, so results do not depend on hashes.

The set is broadcast when it has at most ``BROADCAST_GRAMS`` n-grams (counted), else the probes are shuffled by hash.

Null or empty texts, or texts without words, have no hits; so have null items. Repeated rows get equal results; extra
columns are kept by ``clean``; empty tables give no rows or no hits. A text's memory is its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import settle, spread_join

WINDOW = 10
BROADCAST_GRAMS = 1_000_000
MAX_SHARE = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; cutting at separators leaves at most one empty piece at each end. Where all is ASCII, lower() lowers A-Z alone."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def gram(width: int) -> int:
    """Words of the n-grams by which windows of so many words are found."""
    return (width + 2) // 2


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """key (the window's words joined by spaces), width, items (distinct ids, as strings)."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("width", F.least(F.size("w"), F.lit(width)))
    keys = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.array_join(F.slice("w", i, F.col("width")), " "))
    return w.select("item", "width", F.explode(keys).alias("key")).groupBy("key", "width").agg(F.collect_set("item").alias("items"))


def _gram_hashes(w: Column, width: int, stride: int) -> Column:
    n = gram(width)
    starts = F.sequence(F.lit(1), F.size(w) - (n - 1), F.lit(stride))
    return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.xxhash64(F.lit(n), F.slice(w, i, n)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_grams(known: DataFrame, widths: list[int]) -> DataFrame:
    """h: the distinct hashes of all n-grams of the windows."""
    w = known.select("width", F.split("key", " ").alias("w"))
    own = F.coalesce(*[F.when(F.col("width") == k, _gram_hashes(F.col("w"), k, 1)) for k in widths])
    return w.select(F.explode_outer(own).alias("h")).where("h IS NOT NULL").distinct()


def _probed(docs: DataFrame, known: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, row_hash, copies, n_words, marks: each distinct row of docs with the numbers of its probes that the set holds."""
    cut = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    # the first probe of a row is null and stands for the row itself. Generators are outer ones: for inner ones the optimiser adds a
    # filter on the array's size and takes it below the projections, with the cutting of the text inside the lambda
    hashes = F.concat(F.array(F.lit(None).cast("bigint")), *[_gram_hashes(F.col("w"), k, k - gram(k) + 1) for k in widths])
    probes = cut.select("doc_id", "row_hash", F.size("w").alias("n_words"), hashes.alias("h")).select("doc_id", "row_hash", "n_words", F.posexplode_outer("h").alias("i", "h"))
    grams = benchmark_grams(known, widths)
    if grams.count() <= BROADCAST_GRAMS:
        found = probes.join(F.broadcast(grams.withColumn("hit", F.lit(True))), "h", "left").where("i = 0 OR hit")
    else:
        found = probes.where("i = 0").unionByName(spread_join(probes.where("h IS NOT NULL"), grams, "h", F.struct("doc_id", "row_hash", "i")))
    return found.groupBy("doc_id", "row_hash").agg(F.count_if(F.col("i") == 0).alias("copies"), F.max("n_words").alias("n_words"), F.collect_set(F.when(F.col("i") > 0, F.col("i") - 1)).alias("marks"))


def _spots(marks: Column, n_words: Column, widths: list[int]) -> Column:
    """The windows (pos, width) that hold the probed n-grams of these numbers; probes of one width stand after those of the width before."""
    per = [(k, k - gram(k) + 1, F.greatest(F.floor((n_words - gram(k)) / (k - gram(k) + 1)) + 1, F.lit(0))) for k in widths]

    def around(i: Column) -> Column:
        out, before = None, F.lit(0)
        for k, stride, count in per:
            at = (i - before) * stride
            low, high = F.greatest(at - stride + 1, F.lit(0)), F.least(at, n_words - k)
            near = F.when(low <= high, F.transform(F.sequence(low, high), lambda p: F.struct(p.cast("int").alias("pos"), F.lit(k).alias("width")))).otherwise(F.array().cast("array<struct<pos:int,width:int>>"))
            inside = (i >= before) & (i < before + count)
            out, before = F.when(inside, near) if out is None else out.when(inside, near), before + count
        return out

    return F.array_distinct(F.flatten(F.transform(marks, around)))


def searched(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, row_hash, copies, n_words, places, items of each distinct row of docs: places are the sorted word places that are hit (null without a hit), items the sorted item ids."""
    known = settle(benchmark_windows(benchmark, width))
    widths = sorted(r["width"] for r in known.select("width").distinct().collect()) or [width]  # at most width rows
    probed = settle(_probed(docs, known, widths))
    marked = probed.where(F.size("marks") > 0).select(F.col("doc_id").alias("d"), F.col("row_hash").alias("r"), "n_words", "marks")
    again = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), "text")
    again = again.join(marked, again["doc_id"].eqNullSafe(marked["d"]) & (again["row_hash"] == marked["r"])).select("d", "r", words(F.col("text")).alias("w"), _spots(F.col("marks"), F.col("n_words"), widths).alias("spots"))
    # w is bound by a lambda: a column that is named once, inside another lambda, would be computed anew for each spot
    spots = F.flatten(F.transform(F.array("w"), lambda w: F.transform("spots", lambda x: F.struct(x["pos"].alias("pos"), x["width"].alias("width"), F.array_join(F.slice(w, x["pos"] + 1, x["width"]), " ").alias("key")))))
    runs = again.select("d", "r", F.explode_outer(spots).alias("x")).select("d", "r", "x.pos", "x.width", "x.key")
    # a passage may stand in most documents
    runs = spread_join(runs.withColumn("_ff_window", F.concat_ws(":", "width", "key")), known.select(F.concat_ws(":", "width", "key").alias("_ff_window"), "items"), "_ff_window", F.struct("d", "r", "pos"))
    hits = runs.groupBy("d", "r").agg(F.collect_set(F.struct("pos", "width")).alias("runs"), F.flatten(F.collect_set("items")).alias("items"))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["pos"], x["pos"] + x["width"] - 1)))))
    hits = hits.select("d", "r", places.alias("places"), F.array_sort(F.array_distinct("items")).alias("items"))
    return probed.join(hits, probed["doc_id"].eqNullSafe(hits["d"]) & (probed["row_hash"] == hits["r"]), "left").select("doc_id", "row_hash", "copies", "n_words", "places", "items")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items of each document."""
    each = searched(docs, benchmark, width).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_share: float = MAX_SHARE) -> DataFrame:
    """docs without the hit words (with the separators after them); documents with more than max_share of their words hit go. n_chars is set anew."""
    found = searched(docs, benchmark, width).where("places IS NOT NULL").select(F.col("doc_id").alias("_ff_d"), F.col("row_hash").alias("_ff_r"), F.col("places").alias("_ff_places"), F.col("n_words").alias("_ff_words"))
    keyed = docs.withColumn("_ff_key", F.xxhash64("doc_id", "text"))
    both = keyed.join(found, keyed["doc_id"].eqNullSafe(found["_ff_d"]) & (keyed["_ff_key"] == found["_ff_r"]), "left")
    text, places, pieces = F.col("text"), F.col("_ff_places"), F.col("_ff_pieces")
    # each piece is a word with what follows it up to the next word; what stands before the first word stays. The pieces are a
    # column of their own: inside the lambda below they would be cut anew for every word
    both = both.withColumn("_ff_pieces", F.when(places.isNotNull(), F.regexp_extract_all(text, F.lit(rf"{WORD_ANY_CASE}[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))))
    head = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    spared = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), places)
    left = F.transform(spared, lambda i: F.element_at(pieces, i + 1))
    both = both.withColumn("_ff_text", F.when(places.isNotNull(), F.concat(head, F.array_join(left, ""))).otherwise(text))
    both = both.where(places.isNull() | (F.size(places) <= max_share * F.col("_ff_words")))
    out = both.select(*[F.col("_ff_text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
