"""Quality rules: document statistics, and lines that too many documents of one host repeat.

Lines are normalised (A-Z lowered, white space runs to one space) and hashed with their host (``source``; null is a host
of its own). A line's frequency is the number of distinct texts of the host that hold it, so copies of one document count
once. Lines in more than ``min_docs`` of them, on a host of any size, are boilerplate and are removed everywhere but in the
document with the smallest doc_id that holds them. A document is rejected when it fails the base rules or when less
than ``keep_share`` of its words is left.

Null or empty texts: no words, base_failed. Repeated rows: each gets its own (equal) row. Empty table: no rows.
Extra columns are ignored by ``measure``/``verdicts`` and kept by ``clean``. Long texts: time and memory follow their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import _U, buffers, int_column, per_row, settle, span_hash, words_of, _TABLE, _TABLE_FOLDED

MIN_DOCS = 50
KEEP_SHARE = 0.2
SALTS = 8  # a boilerplate line has more than MIN_DOCS rows, so its copies for spread rows stay fewer than those

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_LINE_SEED = _U(0x8CB92BA72F3D8DD7)

MEASURES = "doc_id bigint, row_hash bigint, host bigint, text_hash bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<bigint>, line_words array<bigint>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("host", pa.int64()), ("text_hash", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64()))])


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.ListArray:
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(rows, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def line_spans(w):
    """Lines of the rows of w that hold a word: row, normalised hash, words, raw hash."""
    n = len(w.data)
    cut = np.zeros(n + 1, bool)
    cut[w.offsets] = True
    cut[:n] |= w.data == 10
    marks = np.flatnonzero(cut)  # each line ends at a mark and begins after the one before, or at a row's own start
    row_end = np.isin(marks, w.offsets)
    newline = np.zeros(len(marks), bool)
    newline[marks < n] = w.data[marks[marks < n]] == 10
    begin = np.concatenate([[0], np.where(newline[:-1], marks[:-1] + 1, marks[:-1])])
    # a newline standing first in a row is at a row's offset as well: the line before it there is empty and has no word
    begin, end = begin, marks
    first, last = np.searchsorted(w.starts, begin), np.searchsorted(w.starts, end)
    ok = last > first
    begin, end, first, last = begin[ok], end[ok], first[ok], last[ok]
    row = np.searchsorted(w.offsets, begin, "right") - 1
    folded = span_hash(_TABLE_FOLDED[w.data], w.starts, w.ends)
    return row, span_hash(folded, first, last), last - first, span_hash(_TABLE[w.data], begin, end)


def _repeat_words(h: np.ndarray, of: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = len(h) - 2
    marked = np.zeros(len(h), bool)
    if n > 0:
        run = h[:n] * _U(0xD1342543DE82EF95) + h[1 : n + 1]
        run = (run * _U(0xD1342543DE82EF95) + h[2:]) ^ (rows[:n].astype(_U) * _U(0x9E3779B97F4A7C15))
        at = np.flatnonzero(rows[:n] == rows[2:])
        order = at[np.argsort(run[at], kind="stable")]
        same = run[order[1:]] == run[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for k in range(3):
            marked[order[twice] + k] = True
    return per_row(marked, of)


def _measure(batches):
    for batch in batches:
        ids, keys, hosts, texts = (batch.column(i) for i in (0, 1, 2, 3))
        column = batch.column(4)
        for w in words_of(column):
            m = w.last - w.first
            h, rows = w.hashes(), w.rows()
            row, line, words, raw = line_spans(w)
            order = np.lexsort((line, row))
            row, line, words = row[order], line[order], words[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
            group = np.cumsum(new) - 1
            raw_rows = row
            distinct = np.unique(np.stack([raw_rows.astype(_U), raw[order]]), axis=1)[0].astype(np.int64) if len(row) else row
            dup = np.bincount(row, minlength=m) - np.bincount(distinct, minlength=m)
            part = slice(w.first, w.last)
            yield pa.RecordBatch.from_arrays(
                [ids[part], keys[part], hosts[part], texts[part], pa.array(np.diff(w.of)), pa.array(per_row(w.inside & ((w.data & 0xC0) != 0x80), w.offsets)), pa.array(per_row(_SYMBOLS[w.data], w.offsets)), pa.array(dup), pa.array(_repeat_words(h, w.of, rows)),
                 _lists(line[new].view(np.int64), row[new], m), _lists(np.bincount(group, words).astype(np.int64) if len(row) else words, row[new], m)],
                schema=_SCHEMA,
            )


def measure(docs: DataFrame) -> DataFrame:
    """Statistics of each document, with the hashes of its distinct lines and the words they hold."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("doc_id", "source", "text").alias("row_hash"),
        F.xxhash64(F.lit("host"), F.col("source"), F.col("source").isNull()).alias("host"),
        F.xxhash64("text").alias("text_hash"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(_measure, MEASURES)


def frequent_lines(measured: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Lines that more than min_docs distinct texts of a host hold: host, line, first_doc."""
    lines = measured.select("host", "text_hash", "doc_id", F.explode("lines").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count_distinct("text_hash").alias("texts"), F.min("doc_id").alias("first_doc"))
    return counts.where(F.col("texts") > min_docs).select("host", "line", "first_doc")


def verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """One row per document: doc_id, row_hash, the measures, base_failed, n_removed_words, removed (hashes of its removed lines), kept."""
    measured = settle(measure(docs))
    common = frequent_lines(measured, min_docs)
    once = measured.dropDuplicates(["doc_id", "row_hash"])
    lines = once.select("doc_id", "row_hash", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("doc_id", "row_hash", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    gone = (
        lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        .join(common.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["host", "line", "salt"])
        .where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(F.col("doc_id").alias("d"), F.col("row_hash").alias("r"))
        .agg(F.sum("words").alias("n_removed_words"), F.collect_list("line").alias("removed"))
    )
    joined = measured.drop("lines", "line_words").join(gone, measured.doc_id.eqNullSafe(gone.d) & (measured.row_hash == gone.r), "left").drop("d", "r")
    out = joined.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("bigint")))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= F.lit(keep_share) * F.col("n_words")))


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, with all their columns, their boilerplate lines taken out of the text and n_chars set anew."""
    v = verdicts(docs, **limits).where("kept").select(F.col("doc_id").alias("_ff_d"), F.col("row_hash").alias("_ff_r"), F.col("removed").alias("_ff_gone")).dropDuplicates(["_ff_d", "_ff_r"])
    keyed = docs.withColumn("_ff_key", F.xxhash64("doc_id", "source", "text"))
    both = keyed.join(v, keyed["doc_id"].eqNullSafe(v["_ff_d"]) & (keyed["_ff_key"] == v["_ff_r"]))
    cols, schema = docs.columns, docs.schema

    def strip(batches):
        for batch in batches:
            gone = batch.column(len(cols))
            text = batch.column(cols.index("text"))
            texts = text.to_pylist()
            for i in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)):
                drop, lines = set(gone[int(i)].as_py()), texts[i].split("\n")
                column = pa.array(lines, pa.string())
                hashes = np.zeros(len(lines), _U)
                for w in words_of(column):
                    has = np.flatnonzero(np.diff(w.of))
                    hashes[w.first + has] = span_hash(w.hashes(folded=True), w.of[has], w.of[has + 1])
                texts[i] = "\n".join(x for x, h in zip(lines, hashes.view(np.int64).tolist()) if not h or h not in drop)
            arrays = [batch.column(k) for k in range(len(cols))]
            arrays[cols.index("text")] = pa.array(texts, text.type)
            yield pa.RecordBatch.from_arrays(arrays, names=cols)

    out = both.select(*[F.col(f"`{c}`") for c in cols], "_ff_gone").mapInArrow(strip, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in cols else out
