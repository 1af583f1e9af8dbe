"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD, with calibrated rejection.

A text's subwords are its byte 2-, 3- and 4-grams (A-Z lowered, everything but letters a-z and bytes beyond ASCII a space),
hashed into BUCKETS rows of an embedding table; the text is their mean. The model is fitted on the driver from a sample of
at most SAMPLE labelled rows, drawn by a hash of the row; each row arrives as bucket counts, so its size is bounded by
BUCKETS. A fifth of the sample sets the softmax temperature and the score under which a prediction counts as rejected.
Predicting folds embeddings and output layer into one table of BUCKETS x languages, and reads whole texts.

Null texts and texts without a letter are ``und`` with score 0. Without labelled rows every text is ``und``. A single language
is always predicted. Repeated rows get equal results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import _FOLD, buffers, pieces

SAMPLE = 2000
BUCKETS = 1 << 15
DIM = 16
EPOCHS = 5
RATE = 20.0
BATCH = 32
HOLD_BACK = 5
ACCEPT = 0.99  # share of right predictions that the rejection score lets pass

_FOLDED = _FOLD.copy()
_FOLDED[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def subwords(data: np.ndarray, offsets: np.ndarray):
    """For each width, the bucket at each byte place; BUCKETS where no subword starts (past the row's end, or two spaces first)."""
    b = _FOLDED[data].astype(np.uint32)
    n = len(b)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    blank = np.ones(n, bool)
    blank[:-1] = (b[:-1] == 32) & (b[1:] == 32)
    h = b * np.uint32(0x9E3779B1)
    for width in (2, 3, 4):
        at = np.full(n, BUCKETS, np.int32)
        if n >= width:
            h = h[: n - width + 1] * np.uint32(0x01000193) + b[width - 1 :] * np.uint32(0x85EBCA6B)
            x = h ^ (h >> np.uint32(15))
            x = (x * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
            ok = (left[: len(x)] >= width) & ~blank[: len(x)]
            at[: len(x)] = np.where(ok, x, BUCKETS)
        yield at


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS + 1) x languages, the last row zero
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of each row's languages."""
        rows = len(offsets) - 1
        total, count = np.zeros((rows, len(self.languages))), np.zeros(rows)
        full = np.flatnonzero(np.diff(offsets))
        for at in subwords(data, offsets):
            if len(full):
                total[full] += np.add.reduceat(self.table[at], offsets[full], axis=0)
                count[full] += np.add.reduceat((at < BUCKETS).astype(np.int64), offsets[full])
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


FEATURES = "lang string, draw bigint, buckets binary, counts binary"


def _features(batches):
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        for i in range(batch.num_rows):
            seen = np.zeros(BUCKETS + 1, np.int64)
            own = data[offsets[i] : offsets[i + 1]]
            for a in range(0, max(len(own), 1), 1 << 20):  # a little overlap keeps the subwords at the cuts
                part = own[a : a + (1 << 20)]
                for at in subwords(part, np.array([0, len(part)])):
                    seen += np.bincount(at, minlength=BUCKETS + 1)
            b = np.flatnonzero(seen[:BUCKETS])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([b.astype(np.int32).tobytes()]), pa.array([seen[b].astype(np.float32).tobytes()])], names=["lang", "draw", "buckets", "counts"])


def sample(labelled: DataFrame, most: int = SAMPLE) -> list[tuple]:
    """At most ``most`` distinct labelled rows (doc_id, text, lang) as lang and bucket counts, the same ones on each run.

    Rows are drawn by a hash of all three, so neither a repeated id nor repeated rows change the bound; equal rows are one.
    """
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "lang", "text"), F.lit(1 << 40))
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", draw.alias("draw"), "text")
    n = rows.agg(F.approx_count_distinct("draw").alias("n")).first()["n"]
    if n > most:
        rows = rows.where(F.col("draw") < int((1 << 40) * min(1.0, 2 * most / n)))  # about twice as many as are taken
    got = rows.dropDuplicates(["draw"]).mapInArrow(_features, FEATURES).orderBy("draw", "lang").limit(most).collect()
    return [(r["lang"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in got]


def fit(rows: list[tuple], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model | None:
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(r[0]) for r in rows])
    k = len(languages)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    share = [r[2] / max(r[2].sum(), 1) for r in rows]
    train = np.array([i for i in range(len(rows)) if i % HOLD_BACK != 0] or range(len(rows)))
    steps, done = epochs * -(-len(train) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(train)
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            at = np.concatenate([rows[i][1] for i in pick])
            weight = np.concatenate([share[i] for i in pick])
            lengths = np.array([len(rows[i][1]) for i in pick])
            owner = np.repeat(np.arange(len(pick)), lengths)
            x = np.zeros((len(pick), DIM), np.float32)
            full = lengths > 0
            if full.any():
                begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])[full]
                x[full] = np.add.reduceat(emb[at] * weight[:, None], begin, axis=0)
            p = softmax((x @ out + bias).astype(np.float64)).astype(np.float32)
            p[np.arange(len(pick)), y[pick]] -= 1
            lr = rate * (1 - done / steps) / len(pick)
            done += 1
            back = p @ out.T
            out -= 0.1 * lr * (x.T @ p)
            bias -= 0.01 * lr * p.sum(axis=0)
            np.subtract.at(emb, at, (lr * 10 * weight)[:, None] * back[owner])
    table = np.zeros((BUCKETS + 1, k), np.float32)
    table[:BUCKETS] = emb @ out
    held = [i for i in range(len(rows)) if i % HOLD_BACK == 0]
    logits = np.array([(table[rows[i][1]] * share[i][:, None]).sum(axis=0) + bias for i in held]).reshape(-1, k)
    grid = np.geomspace(0.05, 20, 60)
    doubt = 1 / (len(held) + 2)  # even without an error among n rows, one of about n may be wrong
    loss = []
    for t in grid:
        logs = -np.log(np.maximum(softmax(logits / t), 1e-300))
        loss.append(((1 - doubt) * logs[np.arange(len(held)), y[held]] + doubt * logs.mean(axis=1)).mean())
    best = float(grid[int(np.argmin(loss))])
    probs = softmax(logits / best)
    right = probs.argmax(axis=1) == y[held]
    floor = float(np.quantile(probs.max(axis=1)[right], 1 - ACCEPT)) if right.any() else 0.0
    return Model(languages, table, bias, best, floor)


PREDICTED = "lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected (the score is under the calibrated one, or und)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            letter = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in pieces(offsets):
                score, name = np.zeros(j - i), np.full(j - i, "und", object)
                if m is not None:
                    own = offsets[i : j + 1] - offsets[i]
                    p = m.scores(data[offsets[i] : offsets[j]], own)
                    ok = letter[i:j]
                    score = np.where(ok, p.max(axis=1), 0.0)
                    name = np.where(ok, np.array(m.languages, object)[p.argmax(axis=1)], "und")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(name, pa.string()), pa.array(score), pa.array((name == "und") | (score < (m.reject_below if m else 1)))], names=["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"doc_id bigint, {PREDICTED}")
