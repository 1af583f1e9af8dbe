"""Substring dedup: suffix automata of repeated passages, documents streamed through them for matching statistics.

A window is WIDTH consecutive words (white-space words, unchanged). A document's word is removed when a window over it also
starts in a document with a smaller doc_id. The reference is the corpus itself, so it is not broadcast whole; each reference
document's repeated passages are one reference shard, and its automaton is replicated only to the tasks that read documents
against it:

1. Anchors. A window's anchor is the least hash of its ANCHOR-word runs, so equal windows have equal anchors and one anchor
   serves about twenty windows. Anchors that more than one document has go into a Bloom filter of bounded size; a false
   positive only costs work.
2. Routing. Windows under such anchors travel as 64-bit hashes, once a task and window (only the task's smallest document
   has to ask; the others already know a smaller one). Those of one anchor meet in one segment; anchors of more than HOT
   documents are dealt by window instead. Each window's smallest document is its reference; runs of windows come out.
3. Matching. The reference document's passages become a suffix automaton, and each run's words stream through it: matching
   statistics of WIDTH or more give the maximal spans to remove. So what is removed has been compared word by word. A
   document that very many runs refer to has its automaton built in several tasks (about RUNS runs each).
4. The spans of a document are united and its other words are kept.

Null or empty texts have no words. A null doc_id is neither smaller nor larger than another: such rows keep their words and
are no reference. Rows with equal doc_id do not remove each other's words. Empty table: no rows. Extra columns are kept by
``removed`` only as far as doc_id. Texts are read whole; windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import _U, mix, release, settle, span_hash, text_bytes, words_of
from .lm import MAX_FILTER, SEGMENT_BYTES, Filter, _place, HASHES

WIDTH = 50
ANCHOR = 8
HOT = 1 << 16
RUNS = 1024
ANCHOR_BITS = 0.1  # of the filter, a byte of text; about ten an anchor
FLUSH = 400_000


def _windows(w, width: int, anchor: int):
    """Of the windows of the rows of w: word place in w, row, anchor; and the word hashes."""
    h = w.hashes()
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), h
    rows = w.rows()
    grams = h[: len(h) - anchor + 1].copy()
    for k in range(1, anchor):
        grams = grams * _U(0xD1342543DE82EF95) + h[k : k + len(grams)]
    least, span, need = mix(grams), 1, width - anchor + 1
    while span * 2 <= need:
        least, span = np.minimum(least[: len(least) - span], least[span:]), span * 2
    if span < need:
        least = np.minimum(least[:n], least[need - span : need - span + n])
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return at, rows[at], least[at], h


def _cuts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _segment(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _ids(batch, w):
    """doc_id and row_hash of w's rows, and which have a doc_id."""
    ids = batch.column(0).slice(w.first, w.last - w.first)
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).slice(w.first, w.last - w.first).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)


ANCHORS = "segment int, keys binary, low binary, high binary, n binary"


def _anchors(bits: int, width: int, anchor: int):
    def merged(held):
        key, low, high, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key, kind="stable")
        key, low, high, n = key[order], low[order], high[order], n[order]
        cut = _cuts(key)
        if not len(cut):
            return key, low, high, n
        return key[cut], np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.add.reduceat(n, cut)

    def rows(key, low, high, n):
        seg = _segment(key, bits)
        cut = _cuts(seg)
        blobs = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(key)))], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(seg[cut], pa.int32()), blobs(key), blobs(low), blobs(high), blobs(n)], names=["segment", "keys", "low", "high", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for w in words_of(batch.column(2)):
                ids, _, ok = _ids(batch, w)
                at, row, least, _ = _windows(w, width, anchor)
                cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])])) if len(at) else at
                cut = cut[ok[row[cut]]]
                doc = ids[row[cut]]
                held.append(merged([(least[cut], doc, doc, np.ones(len(cut), np.int64))]))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield rows(*merged(held))
                    held, size = [], 0
        if size:
            yield rows(*merged(held))

    return run, merged


def anchor_filter(rows: DataFrame, size: int, bits: int, width: int, anchor: int) -> Filter:
    """Anchors that more than one doc_id has (level 1), and those of more than HOT (level 2)."""
    run, merged = _anchors(bits, width, anchor)
    span = max(64, min(int(size * ANCHOR_BITS), MAX_FILTER * 8) >> bits)
    span += -span % 8

    def build(batches):
        for segment, parts in groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0]):
            held = []
            for _, key, low, high, n in parts:
                held.append((np.frombuffer(key, _U), np.frombuffer(low, np.int64), np.frombuffer(high, np.int64), np.frombuffer(n, np.int64)))
                if len(held) == 64:
                    held = [merged(held)]
            key, low, high, n = merged(held)
            marks = np.zeros(span, bool)
            for level, keys in ((1, key[low < high]), (2, key[(low < high) & (n > HOT)])):
                for i in range(HASHES):
                    marks[_place(keys, level, i, span).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(marks).tobytes()], pa.binary())], names=["segment", "bits"])

    built = rows.mapInArrow(run, ANCHORS).repartition("segment").sortWithinPartitions("segment").mapInArrow(build, "segment int, bits binary")
    return _collected(built, span, bits)


def _collected(built: DataFrame, span: int, bits: int) -> Filter:
    data = bytearray((1 << bits) * span // 8)
    for row in built.collect():
        data[row["segment"] * span // 8 : (row["segment"] + 1) * span // 8] = row["bits"]
    return Filter(data, 0, span, bits)


RUN_FIELDS = ("doc_id", "row_hash", "start", "n", "ref_doc", "ref_row", "ref_start")
RUN = ", ".join(f"{f} bigint" for f in RUN_FIELDS)
ROUTED = "segment int, hashes binary, runs binary, docs binary, sure binary"


def _runs(doc, row, pos, ref, ref_row, ref_pos) -> list[np.ndarray]:
    """The seven columns of runs: consecutive places of a document whose references are consecutive places of one document."""
    order = np.lexsort((pos, row, doc))
    doc, row, pos, ref, ref_row, ref_pos = (x[order] for x in (doc, row, pos, ref, ref_row, ref_pos))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1) | (ref[1:] != ref[:-1]) | (ref_row[1:] != ref_row[:-1]) | (ref_pos[1:] != ref_pos[:-1] + 1)
    cut = np.flatnonzero(new)
    return [x.astype(np.int64) for x in (doc[cut], row[cut], pos[cut], np.diff(np.append(cut, len(doc))), ref[cut], ref_row[cut], ref_pos[cut])]


def _resolve(hashes, doc, row, pos):
    """Entries with a smaller document under the same hash, with that reference; and which entries are of their hash's smallest document."""
    order = np.lexsort((pos, row, doc, hashes))
    hashes, doc, row, pos = hashes[order], doc[order], row[order], pos[order]
    cut = _cuts(hashes)
    first = np.repeat(cut, np.diff(np.append(cut, len(hashes))))
    late = doc > doc[first]
    f = first[late]
    return _runs(doc[late], row[late], pos[late], doc[f], row[f], pos[f]), order[~late]


def _route(shared, bits: int, width: int, anchor: int):
    def rows(held):
        hashes, anchors, doc, row, pos = (np.concatenate(x) for x in zip(*held))
        sure, ask = _resolve(hashes, doc, row, pos)
        hashes, seg, doc, row, pos = hashes[ask], anchors[ask], doc[ask], row[ask], pos[ask]
        order = np.lexsort((pos, row, doc, seg))
        hashes, seg, doc, row, pos = (x[order] for x in (hashes, seg, doc, row, pos))
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(seg)))
        cut = _cuts(seg)
        out = []
        for a, b in zip(cut, np.append(cut[1:], len(seg))):
            i, j = np.searchsorted(begin, (a, b))
            own = begin[i:j]
            docs, which = np.unique(np.stack([doc[own], row[own]], axis=1), axis=0, return_inverse=True)
            out.append((int(seg[a]), hashes[a:b].tobytes(), np.stack([which.ravel(), pos[own], length[i:j]]).astype(np.uint32).tobytes(), docs.tobytes(), b""))
        if len(sure[0]):
            out.append((int(sure[0][0] % (1 << bits)), b"", b"", b"", np.stack(sure).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["segment", "hashes", "runs", "docs", "sure"]) if out else None

    def run(batches):
        f = shared.value
        held, size = [], 0
        for batch in batches:
            for w in words_of(batch.column(2)):
                ids, keys, ok = _ids(batch, w)
                at, row, least, h = _windows(w, width, anchor)
                cut = _cuts(least)
                level = np.repeat(f.counts(least[cut]), np.diff(np.append(cut, len(least)))) if len(cut) else np.zeros(0)
                use = np.flatnonzero((level > 0) & ok[row])
                at, row, least, level = at[use], row[use], least[use], level[use]
                own = span_hash(h, at, at + width)
                seg = _segment(np.where(level > 2, own, mix(least)), bits)
                held.append((own, seg, ids[row], keys[row], at - w.of[row]))
                size += len(at)
                if size >= FLUSH:
                    if (out := rows(held)) is not None:
                        yield out
                    held, size = [], 0
        if size and (out := rows(held)) is not None:
            yield out

    return run


def _meet(batches):
    def batch_of(columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(RUN_FIELDS))

    for _, parts in groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0]):
        held = []
        for _, hashes, runs, docs, sure in parts:
            if sure:
                yield batch_of(np.frombuffer(sure, np.int64).reshape(7, -1))
                continue
            which, pos, length = np.frombuffer(runs, np.uint32).reshape(3, -1).astype(np.int64)
            docs = np.frombuffer(docs, np.int64).reshape(-1, 2)
            begin = np.concatenate([[0], np.cumsum(length)[:-1]])
            places = np.repeat(pos - begin, length) + np.arange(length.sum())
            own = np.repeat(which, length)
            held.append((np.frombuffer(hashes, _U), docs[own, 0], docs[own, 1], places))
        if held:
            runs, _ = _resolve(*(np.concatenate(x) for x in zip(*held)))
            held = []
            release()
            if len(runs[0]):
                yield batch_of(runs)


class Automaton:
    """Suffix automaton over words of several passages; matches never cross from one passage into the next."""

    def __init__(self, passages):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for k, words in enumerate(passages):
            last = self._add(last, k)  # a number, equal to no word
            for w in words:
                last = self._add(last, w)

    def _add(self, last: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        return cur

    def statistics(self, words):
        """For each word, the length of the longest suffix up to it that the passages hold."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            yield n


def spans(statistics, width: int):
    """Maximal word spans covered by matches of width or more."""
    begin = end = None
    for i, n in enumerate(statistics):
        if n >= width:
            if begin is not None and i + 1 - width <= end:
                end = i + 1
            else:
                if begin is not None:
                    yield begin, end
                begin, end = i + 1 - width, i + 1
    if begin is not None:
        yield begin, end


def _united(intervals):
    out = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


PASSAGES = "ref_doc bigint, ref_row bigint, salt int, is_run int, doc_id bigint, row_hash bigint, start bigint, text string"
SPANS = "doc_id bigint, row_hash bigint, start bigint, stop bigint"


def _passages(width: int):
    """Texts with their list of places: the passages of a reference (once a salt), or the runs of a document."""

    def run(batches):
        out, size = [], 0
        for batch in batches:
            for doc, key, text, salts, places in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().split()
                said = lambda a, b: b" ".join(words[a:b]).decode()  # noqa: E731, B023
                if salts is not None:
                    text = "\n".join(said(a, b) for a, b in _united((p["start"], p["start"] + p["n"] + width - 1) for p in places))
                    out += [(doc, key, s, 0, None, None, None, text) for s in range(salts)]
                    size += len(text) * salts
                else:
                    for (ref, ref_row, salt), own in groupby(sorted(places, key=lambda p: (p["ref_doc"], p["ref_row"], p["salt"])), key=lambda p: (p["ref_doc"], p["ref_row"], p["salt"])):
                        for a, b in _united((p["start"], p["start"] + p["n"] + width - 1) for p in own):
                            out.append((ref, ref_row, salt, 1, doc, key, a, said(a, b)))
                            size += len(out[-1][-1])
                if size > 1 << 22:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    def _batch(out):
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in PASSAGES.split(", ")])

    return run


def _match(width: int):
    def run(batches):
        at, automaton, out = None, None, []
        for batch in batches:
            for ref, ref_row, salt, is_run, doc, key, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not is_run:
                    at, automaton = (ref, ref_row, salt), Automaton(p.encode().split() for p in text.split("\n"))
                elif at == (ref, ref_row, salt):
                    out += [(doc, key, start + a, start + b) for a, b in spans(automaton.statistics(text.encode().split()), width)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "row_hash", "start", "stop"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "row_hash", "start", "stop"])

    return run


def _row_key(doc: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(_U)) ^ row.view(_U))


def _row_filter(keys: DataFrame) -> Filter:
    """A Bloom filter of (doc_id, row_hash) rows, of bounded size."""
    n = keys.count()
    bits = min(12, max(0, (n // 100_000).bit_length()))
    span = max(64, min(n * 10, MAX_FILTER * 8) >> bits)
    span += -span % 8

    def blobs(batches):
        for batch in batches:
            key = np.sort(_row_key(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            seg = _segment(key, bits)
            cut = _cuts(seg)
            yield pa.RecordBatch.from_arrays([pa.array(seg[cut], pa.int32()), pa.array([key[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(key)))], pa.binary())], names=["segment", "keys"])

    def build(batches):
        for segment, parts in groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0]):
            marks = np.zeros(span, bool)
            for _, key in parts:
                for i in range(HASHES):
                    marks[_place(np.frombuffer(key, _U), 1, i, span).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(marks).tobytes()], pa.binary())], names=["segment", "bits"])

    built = keys.mapInArrow(blobs, "segment int, keys binary").repartition("segment").sortWithinPartitions("segment").mapInArrow(build, "segment int, bits binary")
    return _collected(built, span, bits)


def _maybe(shared, wanted: bool):
    """Rows of (doc_id, row_hash, text) that the filter may hold, or those it does not."""

    def run(batches):
        f = shared.value
        for batch in batches:
            ids = batch.column(0)
            held = f.counts(_row_key(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy())) > 0
            held &= ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(held == wanted))

    return run


REMOVED = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"


def _cut(digest: bool):
    def run(batches):
        for batch in batches:
            docs, n, gone, kept = batch.column(0), [], [], []
            places = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            for text, own in zip(batch.column(2).to_pylist(), places):
                words = (text or "").encode().split()
                n.append(len(words))
                if own:
                    keep, at = [], 0
                    for a, b in _united((p["start"], p["stop"]) for p in own):
                        keep += words[at:a]
                        at = b
                    words = keep + words[at:]
                gone.append(n[-1] - len(words))
                joined = b" ".join(words)
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays([docs, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def removed(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (its SHA-256 if digest) of each row of docs (doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_hash"), F.col("text").cast("string").alias("text"))
    size = text_bytes(docs)
    bits = min(20, max(2, int(size // SEGMENT_BYTES).bit_length()))
    anchors = sc.broadcast(anchor_filter(rows, size, bits, width, anchor))
    runs = settle(rows.mapInArrow(_route(anchors, bits, width, anchor), ROUTED).repartition("segment").sortWithinPartitions("segment").mapInArrow(_meet, RUN))

    refs = runs.groupBy("ref_doc", "ref_row", "ref_start").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("uses"))
    # settled, so that both sides of the join below are exchanged for it and the runs of one reference can be split
    refs = settle(refs.groupBy("ref_doc", "ref_row").agg(F.collect_list(F.struct(F.col("ref_start").alias("start"), "n")).alias("places"), F.ceil(F.sum("uses") / RUNS).cast("int").alias("salts")))
    salts = refs.select(F.col("ref_doc").alias("rd"), F.col("ref_row").alias("rr"), "salts")
    own = runs.join(salts, (F.col("ref_doc") == F.col("rd")) & (F.col("ref_row") == F.col("rr"))).withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_hash"), F.col("salts")).cast("int"))
    place = "array<struct<start:bigint,n:bigint,ref_doc:bigint,ref_row:bigint,salt:int>>"
    own = own.groupBy(F.col("doc_id").alias("d"), F.col("row_hash").alias("r")).agg(F.collect_list(F.struct("start", "n", "ref_doc", "ref_row", "salt")).cast(place).alias("places"))
    nulls = [F.lit(None).cast(t) for t in ("bigint", "bigint", "int")]
    wanted = own.select("d", "r", F.lit(None).cast("int").alias("salts"), "places").unionByName(
        refs.select(F.col("ref_doc").alias("d"), F.col("ref_row").alias("r"), "salts", F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["n"].alias("n"), nulls[0].alias("ref_doc"), nulls[1].alias("ref_row"), nulls[2].alias("salt"))).cast(place).alias("places"))
    )
    touched = sc.broadcast(_row_filter(runs.select("doc_id", "row_hash").union(runs.select("ref_doc", "ref_row")).distinct()))
    columns = "doc_id bigint, row_hash bigint, text string"
    some = rows.mapInArrow(_maybe(touched, True), columns).dropDuplicates(["doc_id", "row_hash"])
    texts = some.join(wanted, (F.col("doc_id") == F.col("d")) & (F.col("row_hash") == F.col("r"))).select("doc_id", "row_hash", "text", "salts", "places")
    routed = texts.mapInArrow(_passages(width), PASSAGES).repartition("ref_doc", "ref_row", "salt").sortWithinPartitions("ref_doc", "ref_row", "salt", "is_run")
    found = routed.mapInArrow(_match(width), SPANS).groupBy(F.col("doc_id").alias("d"), F.col("row_hash").alias("r")).agg(F.collect_list(F.struct("start", "stop")).alias("places"))

    alone, cut = _maybe(touched, False), _cut(digest)
    untouched = rows.mapInArrow(lambda batches: cut(alone(batches)), REMOVED)  # one Python worker a task
    changed = rows.mapInArrow(_maybe(touched, True), columns).join(found, (F.col("doc_id") == F.col("d")) & (F.col("row_hash") == F.col("r")), "left")
    return untouched.unionByName(changed.select("doc_id", "row_hash", "text", "places").mapInArrow(_cut(digest), REMOVED))
