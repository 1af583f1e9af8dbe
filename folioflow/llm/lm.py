"""Language-model scores from a log-frequency Bloom filter, beside an exact unigram base score.

Tokens are white-space words with A-Z lowered, then one end token a text. Counting sends sorted 64-bit n-gram hashes with
their counts, combined per task, to segments; no n-gram travels as text and none is collected. Collisions of 64-bit hashes
are the only inexactness of the counts.

* Filter: a pair (u, w) with count c is stored at levels 1 .. 1 + floor(log2 c) of its context's segment, as is the context
  u. A head word (below) may have any number of followers: its pairs go to segments by both words, and its own count is
  taken from the head in the same classes; other contexts have fewer than N / HEAD pairs. A count is read back by probing level after level until one is missing. Segments are built where their n-grams meet
  and hold ``BITS_PER_ENTRY`` bits for each (n-gram, level) they store, counted there: with ``HASHES`` probes a level that
  is not stored is found in about 1% of the cases ((1 - e^-0.5)^5 = 0.9%), whatever the corpus. A filter of at most
  ``MAX_FILTER`` bytes is broadcast and texts are scored beside it; a larger one lies in shards of that size, and each batch of
  texts sends its distinct keys to the shards that hold them and gets their levels back. Both ways give equal scores.
* Score: sum of log10 P(w|u) with P(w|u) = (c(u,w) + ALPHA * P1(w)) / (max(c(u), c(u,w)) + ALPHA); P1 is the
  unigram probability from the word's exact count.
* Head: words with count * HEAD >= N. There are at most HEAD of them whatever the corpus, so they are broadcast. The others
  leave their part of the sums open: they are asked for with the level of their pair, and a join brings their counts, for
  the score as for the base score.

Null or empty text: the end token alone. A null doc_id belongs to the training rows. Repeated rows get equal results;
extra columns are ignored; an empty table gives no rows. Long texts are read piece by piece.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import _U, buffers, mix, pieces, release, settle, text_bytes, words_of

HEAD = 1 << 21
BITS_PER_ENTRY = 10
MAX_FILTER = 96 << 20
SEGMENT_BYTES = 8 << 20
MAX_BITS = 24
BATCH = 4 << 20
HASHES = 5
LEAST_SPAN = 64
LEVELS = 48
ALPHA = 2.0
FLUSH = 1_000_000
END = _U(0x5EED0E4D5EED0E4D)
_TOP = _U(0xFFFFFF0000000000)  # MAX_BITS bits name the segment
_LOW = _U(0x000000FFFFFFFFFF)

COUNTS = "segment int, keys binary, counts binary, n bigint, distinct_keys bigint"
_COUNTS = pa.schema([("segment", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("distinct_keys", pa.int64())])


def sequence(w) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the rows of w with the end tokens, and where each row begins."""
    rows = np.arange(w.last - w.first)
    of = w.of + np.arange(len(w.of))
    out = np.empty(of[-1], _U)
    ends = of[1:] - 1
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = w.hashes(folded=True)
    out[ends] = END
    return out, of


def shifted(values: np.ndarray, of: np.ndarray, first) -> np.ndarray:
    """The value before each one in its row; ``first`` where a row begins."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[of[:-1]] = first
    return out


def context_keys(u: np.ndarray) -> np.ndarray:
    m = mix(u)
    return (m & _TOP) | (mix(m + _U(0x243F6A8885A308D3)) & _LOW)


def pair_keys(u: np.ndarray, w: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """spread: contexts whose pairs go to segments by both words."""
    both = mix(u * _U(0x9E3779B97F4A7C15) ^ mix(w))
    return np.where(spread, both, (mix(u) & _TOP) | (both & _LOW))


def middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    return np.where(level == 0, 0.0, (3 * np.exp2(np.maximum(level - 1, 0)) - 1) / 2)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 0)


def _unique_sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts[:0]


def _blobs(keys: np.ndarray, counts: np.ndarray, bits: int):
    segments = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1]]))
    ends = np.append(cut[1:], len(keys))
    small = counts.astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [pa.array(segments[cut], pa.int32()), pa.array([keys[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()), pa.array([small[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
         pa.array([int(counts[a:b].sum()) for a, b in zip(cut, ends)], pa.int64()), pa.array(ends - cut, pa.int64())],
        schema=_COUNTS,
    )


def count_keys(docs: DataFrame, keys_of, bits: int) -> DataFrame:
    """Counts of keys_of(words) over the texts of docs, one row a segment and task."""

    def run(batches):
        held, n, total = [], 0, 0
        for batch in batches:
            for w in words_of(batch.column(0)):
                keys, counts = np.unique(keys_of(w), return_counts=True)
                held.append((keys, counts))
                n, total = n + len(keys), total + int(counts.sum())
                if n >= FLUSH or total >> 31:  # a count fits in 32 bits
                    yield _blobs(*_unique_sum(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), bits)
                    held, n, total = [], 0, 0
        if n:
            yield _blobs(*_unique_sum(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), bits)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTS)


def _segments(batches):
    """(segment, keys, counts) with all rows of a segment, which stand together, summed."""
    at, held = None, []

    def done():
        return at, *_unique_sum(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    for batch in batches:
        for segment, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if segment != at and held:
                yield done()
                held = []
                release()
            at = segment
            held.append((np.frombuffer(keys, _U), np.frombuffer(counts, np.uint32).astype(np.int64)))
            if sum(len(h[0]) for h in held) > 4 * FLUSH:
                held = [done()[1:]]
    if held:
        yield done()


def gathered(counts: DataFrame) -> DataFrame:
    def run(batches):
        for segment, keys, n in _segments(batches):
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([n.astype(np.int64).tobytes()], pa.binary()), pa.array([int(n.sum())], pa.int64()), pa.array([len(keys)], pa.int64())], schema=_COUNTS)

    return counts.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, COUNTS)


def _place(keys: np.ndarray, level: int, probe: int, span: int | np.ndarray) -> np.ndarray:
    r = mix(keys + _U((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    low, high = r & _U(0xFFFFFFFF), (r >> _U(32)) | _U(1)
    return (((low + _U(probe) * high) & _U(0xFFFFFFFF)) * np.asarray(span, _U)) >> _U(32)


def build_filter(counts: DataFrame, span: int | None = None) -> DataFrame:
    """segment and its bits from counted keys: span of them, or else BITS_PER_ENTRY for each of its (key, level) entries."""

    def run(batches):
        for segment, keys, n in _segments(batches):
            level = levels(n)
            size = span or max(LEAST_SPAN, -(-int(level.sum()) * BITS_PER_ENTRY // 8) * 8)
            bits = np.zeros(size, bool)
            j = 1
            while len(keys):
                for i in range(HASHES):
                    bits[_place(keys, j, i, size).astype(np.int64)] = True
                j += 1
                keys, level = keys[level >= j], level[level >= j]
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["segment", "bits"])

    return counts.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment int, bits binary")


class Filter:
    """Segments first..first+n-1 of a log-frequency Bloom filter. spans: the bits of each segment, or of every one."""

    def __init__(self, data: bytearray, first: int, spans: int | np.ndarray, bits: int):
        self.data, self.first, self.bits = data, first, bits
        self.spans = np.full(len(data) * 8 // spans, spans, _U) if np.isscalar(spans) else spans.astype(_U)
        self.starts = np.cumsum(self.spans) - self.spans

    def segment(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The middle of the counts of each key's highest stored level; 0 if it has none. All keys belong to these segments."""
        return middle(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        data = np.frombuffer(self.data, np.uint8)
        own = self.segment(keys) - self.first
        base, span = self.starts[own], self.spans[own]
        alive, level = np.arange(len(keys)), np.zeros(len(keys), np.int64)
        for j in range(1, LEVELS):
            for i in range(HASHES):  # most misses are seen at the first probe
                at = base[alive] + _place(keys[alive], j, i, span[alive])
                alive = alive[(data[(at >> _U(3)).astype(np.int64)] >> (_U(7) - (at & _U(7))).astype(np.uint8)) & 1 == 1]
            if not len(alive):
                break
            level[alive] = j
        return level


def held_out(doc_id: Column, modulus: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == 1, F.lit(False))


def _probes(w, look):
    """Of the words w: token hashes, where rows begin, distinct tokens and each token's place in them, their head counts, the place of
    each token's context, and the keys to ask for: the pairs, and the contexts that are not head words."""
    h, of = sequence(w)
    uniq, inv = np.unique(h, return_inverse=True)
    known = look(uniq)
    before = shifted(inv, of, int(np.searchsorted(uniq, END)))
    return h, of, uniq, inv, known, before, pair_keys(uniq[before], h, known[before] > 0), context_keys(uniq[known == 0])


def _built(train: DataFrame, bits: int, look) -> DataFrame:
    """The segments of the filter. look: counts of head words, 0 for others."""

    def keys_of(w):
        _, _, uniq, _, known, before, pairs, _ = _probes(w, look)
        return np.concatenate([pairs, context_keys(uniq[before[known[before] == 0]])])

    return settle(build_filter(count_keys(train, keys_of, bits)))


def _whole(built: DataFrame, bits: int) -> Filter:
    """All segments in one filter; asked for where they are at most MAX_FILTER bytes."""
    data, sizes = [b"\0" * (LEAST_SPAN // 8)] * (1 << bits), np.full(1 << bits, LEAST_SPAN // 8, np.int64)  # a segment without keys is all zeros
    for row in built.toLocalIterator():
        data[row["segment"]], sizes[row["segment"]] = row["bits"], len(row["bits"])
    return Filter(bytearray().join(data), 0, sizes * 8, bits)


ROUTED = "dealt bigint, part bigint, batch bigint, data binary, doc_id bigint, row_hash bigint, text string"


def _batched(rows: DataFrame) -> DataFrame:
    """rows with the number of a batch: neighbours with about BATCH bytes of text, or one longer text."""

    def run(batches):
        number, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = buffers(batch.column(2))
            for i, j in pieces(offsets, BATCH):
                size = int(offsets[j] - offsets[i])
                if number is None or held + size > BATCH:
                    number, held = int.from_bytes(os.urandom(8), "little") >> 1, 0
                held += size
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, number)), *(c.slice(i, j - i) for c in batch.columns)], names=["batch", "doc_id", "row_hash", "text"])

    return settle(rows.mapInArrow(run, "batch bigint, doc_id bigint, row_hash bigint, text string"))


def _runs(batches, column: int):
    """(value, record batches) of each run of equal values in a column without nulls."""
    at, held = None, []
    for batch in batches:
        values = batch.column(column).to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else [0]
        for i, j in zip(cut[:-1], cut[1:]):
            if held and values[i] != at:
                yield at, held
                held = []
            at = values[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield at, held


def _texts(held: list, column: int) -> pa.Array:
    return pa.concat_arrays([b.column(column) for b in held])


def _asked(texts: pa.Array, look) -> np.ndarray:
    """The distinct keys of a batch, sorted; so they stand by segment."""
    return np.unique(np.concatenate([k for w in words_of(texts) for k in _probes(w, look)[6:]]))


def _routed(rows: DataFrame, built: DataFrame, bits: int, size: int, look, scored) -> DataFrame:
    """The scored rows by a filter of size bytes that lies in shards of about half of MAX_FILTER."""
    shard_bits = min(bits, max(1, (2 * size // MAX_FILTER).bit_length()))
    batched = _batched(rows)

    def asking(batches):
        for number, held in _runs(batches, 0):
            keys = _asked(_texts(held, 3), look)
            shard = (keys >> _U(64 - shard_bits)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[cut[:-1]]), pa.array(np.zeros(len(cut) - 1, np.int64)), pa.array(np.full(len(cut) - 1, number)), pa.array([keys[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                names=["dealt", "part", "batch", "data"],
            )

    def answering(batches):
        at, f, data = None, None, {}
        for batch in batches:
            for shard, part, number, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != at:
                    at, f, data = shard, None, {}
                    release()
                if part < 0:  # a segment; they come first
                    data[-part - 1] = blob
                    continue
                if f is None:
                    first = shard << (bits - shard_bits)
                    held = [data.get(k, b"\0" * (LEAST_SPAN // 8)) for k in range(first, first + (1 << (bits - shard_bits)))]
                    f, data = Filter(bytearray().join(held), first, np.array([len(b) * 8 for b in held]), bits), {}
                levels = f.levels(np.frombuffer(blob, _U)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([shard], pa.int64()), pa.array([number], pa.int64()), pa.array([levels.tobytes()], pa.binary())], names=["dealt", "part", "batch", "data"])

    def closing(batches):
        for _, held in _runs(batches, 0):
            answers = [np.frombuffer(d, np.uint8) for b in held for d in b.column(3).to_pylist() if d is not None]
            whole = pa.Table.from_batches(held)
            whole = whole.filter(pc.is_null(whole["data"]))
            texts = pa.concat_arrays(whole["text"].chunks)
            keys, levels = _asked(texts, look), np.concatenate(answers).astype(np.int64)
            if len(keys) != len(levels):
                raise ValueError("the answers are not those of the batch's keys")
            find = lambda k: levels[np.searchsorted(keys, k)]  # noqa: E731, B023
            ids, hashes = pa.concat_arrays(whole["doc_id"].chunks), pa.concat_arrays(whole["row_hash"].chunks)
            for w in words_of(texts):
                yield scored(w, ids, hashes, find)

    blob = "dealt bigint, part bigint, batch bigint, data binary"
    segments = built.select(F.shiftright("segment", bits - shard_bits).cast("bigint").alias("dealt"), (-F.col("segment").cast("bigint") - 1).alias("part"), F.lit(0).cast("bigint").alias("batch"), F.col("bits").alias("data"))
    asked = batched.mapInArrow(asking, blob)
    answers = segments.unionByName(asked).repartition("dealt").sortWithinPartitions("dealt", "part").mapInArrow(answering, blob)
    texts = batched.select(F.col("batch").alias("dealt"), F.lit(1 << 62).cast("bigint").alias("part"), "*")
    met = answers.unionByName(texts, allowMissingColumns=True).select(*[c.split()[0] for c in ROUTED.split(", ")])
    return met.repartition("dealt").sortWithinPartitions("dealt", "part").mapInArrow(closing, PARTS)


# a text's own row has level -1, its tokens as tf and its closed sums; a request has the level of its pairs
PARTS = "token bigint, doc_id bigint, row_hash bigint, level int, tf bigint, head_known bigint, base double, score double"


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Of each row of docs (doc_id, text): n_tokens, n_known, train_tokens, base_score, score; train (text) is learned from."""
    sc = docs.sparkSession.sparkContext
    size = text_bytes(train)
    bits = min(MAX_BITS, max(2, int(size // SEGMENT_BYTES).bit_length()))
    words = settle(gathered(count_keys(train, lambda w: sequence(w)[0], bits)))
    stats = words.agg(F.sum("n").alias("n"), F.sum("distinct_keys").alias("v")).first()
    n, v = int(stats["n"] or 0), int(stats["v"] or 0)
    floor = n + 0.5 * (v + 1)

    def split(head: bool):
        def run(batches):
            for batch in batches:
                for keys, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    k, c = np.frombuffer(keys, _U), np.frombuffer(counts, np.int64)
                    ok = (c * HEAD >= n) == head
                    if head:
                        yield pa.RecordBatch.from_arrays([pa.array([k[ok].tobytes()], pa.binary()), pa.array([c[ok].tobytes()], pa.binary())], names=["keys", "counts"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(k[ok].view(np.int64)), pa.array(c[ok])], names=["token", "c"])

        return run

    rows = words.mapInArrow(split(True), "keys binary, counts binary").collect()  # at most HEAD words in all
    keys = np.concatenate([np.zeros(0, _U), *[np.frombuffer(r["keys"], _U) for r in rows]])
    counts = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["counts"], np.int64) for r in rows]])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    head = sc.broadcast((keys, counts))

    def look(uniq: np.ndarray) -> np.ndarray:
        k, c = head.value
        at = np.minimum(np.searchsorted(k, uniq), max(len(k) - 1, 0))
        return np.where(k[at] == uniq, c[at], 0) if len(k) else np.zeros(len(uniq), np.int64)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_hash"), F.col("text").cast("string").alias("text"))

    def scored(w, ids, hashes, find):
        h, of, uniq, inv, known, before, pairs, contexts = _probes(w, look)
        levels_of_contexts = levels(known)
        levels_of_contexts[known == 0] = find(contexts)
        cu, level, tail = middle(levels_of_contexts), find(pairs), known[inv] == 0
        cuw = middle(level)
        logs = np.log10(np.where(tail, 1.0, cuw + ALPHA * (known[inv] + 0.5) / floor) / (np.maximum(cu[before], cuw) + ALPHA))
        m, c = w.last - w.first, known[inv]
        row = np.searchsorted(of, np.flatnonzero(tail), "right") - 1
        both, tf = np.unique((row.astype(np.int64) * len(uniq) + inv[tail]) * LEVELS + level[tail], return_counts=True)
        level, both = both % LEVELS, both // LEVELS
        owner = pa.array(np.concatenate([np.arange(m), both // len(uniq)]) + w.first)
        of_row = hashes.take(owner)
        none = np.zeros(len(both), np.int64)
        per_text = lambda x: np.concatenate([np.add.reduceat(x, of[:-1]), none])
        token = np.concatenate([of_row.slice(0, m).to_numpy(), uniq[both % len(uniq)].view(np.int64)])
        columns = (token, ids.take(owner), of_row, np.concatenate([np.full(m, -1), level]).astype(np.int32), np.concatenate([np.diff(of), tf]), per_text((c > 0).astype(np.int64)), per_text(np.where(c > 0, np.log10(c + 0.5), 0.0)), per_text(logs))
        return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=[v.split()[0] for v in PARTS.split(", ")])

    built = _built(train, bits, look)
    filter_bytes = int(built.agg(F.sum(F.length("bits")).alias("n")).first()["n"] or 0)
    if filter_bytes <= MAX_FILTER:
        shared = sc.broadcast(_whole(built, bits))

        def scoring(batches):
            for batch in batches:
                for w in words_of(batch.column(2)):
                    yield scored(w, batch.column(0), batch.column(1), shared.value.levels)

        parts = rows.mapInArrow(scoring, PARTS)
    else:
        parts = _routed(rows, built, bits, filter_bytes, look, scored)
    found = parts.join(words.mapInArrow(split(False), "token bigint, c bigint"), "token", "left")
    own, c = F.col("level") < 0, F.coalesce("c", F.lit(0)) + 0.5
    cuw = F.when(F.col("level") == 0, 0.0).otherwise((3 * F.pow(F.lit(2.0), F.col("level") - 1) - 1) / 2)
    sums = found.groupBy("doc_id", "row_hash").agg(
        F.sum(own.cast("int")).alias("m"),
        F.sum(F.when(own, F.col("tf"))).alias("n_tokens"),
        F.sum(F.when(own, F.col("head_known")).when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.when(own, F.col("base")).otherwise(F.col("tf") * F.log10(c))).alias("base"),
        F.sum(F.when(own, F.col("score")).otherwise(F.col("tf") * F.log10(cuw + F.lit(ALPHA / floor) * c))).alias("score"),
    )
    m = F.col("m").cast("int")  # equal rows share a key: the sums hold each of them once, and are dealt out again
    each = sums.select("doc_id", *[(F.col(k) / m).cast(t).alias(k) for k, t in (("n_tokens", "bigint"), ("n_known", "bigint"), ("base", "double"), ("score", "double"))], F.explode(F.sequence(F.lit(1), m)).alias("k"))
    return each.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(floor)))).alias("base_score"), "score")
