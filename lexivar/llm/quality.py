"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words (whole texts, no prefix). Each passage is encoded from its words and its form: every word, lower-cased, is hashed to
one of BUCKETS learned vectors, whose mean over the passage is added to a linear map of the passage's counts (letter case, symbols, digits, bars, sentence marks, word
lengths, repeats within the passage and in the document so far, standardised), so h = tanh(mean E[word] + W x + b). Gated attention tanh(V h) * sigmoid(U h) weighs the passages; the weighted mean of the h is scored by a
logistic unit. All parts are learned together from the documents' labels by Adam.

Fitting uses at most MAX_TRAIN labelled documents, those of the least hash of their id, so that the driver holds a bounded amount;
scoring covers every row. Rows: a null or wordless text is a bag without passages and gets the score of a zero representation.
Null ids are scored (held_out false). Labels other than 0 and 1 are left out; repeated labels of a document count by majority, ties
as 1. Without labels every score is 0.5. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .text import pieces, words

PASSAGE = 64
MAX_TRAIN = 6000
HIDDEN, GATES, EPOCHS, RATE = 16, 8, 24, 0.01
BUCKETS, DECAY = 4096, 1e-4

_CLASSES = {
    "upper": lambda b: (b >= 65) & (b <= 90),
    "digit": lambda b: (b >= 48) & (b <= 57),
    "mark": lambda b: np.isin(b, list(b".,;:?")),
    "symbol": lambda b: np.isin(b, list(b"!#$%&*@<>{}[]=~^+/\\_")),
    "bar": lambda b: b == 124,
    "line": lambda b: b == 10,
    "wide": lambda b: b >= 0xC3,
}
_TABLES = [f(np.arange(256)) for f in _CLASSES.values()]
FEATURES = len(_TABLES) + 5


def _repeats(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the value stood in its group before."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    out = np.zeros(len(group), bool)
    same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    out[order[1:]] = same
    return out


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each passage, the bucket of each word, each passage's first word and each document's first passage (one more at the end of the last two)."""
    hashed, starts, ends, at = words(data, offsets)
    counts = np.diff(at)
    per = -(-counts // PASSAGE)
    to = np.r_[0, np.cumsum(per)]
    if not to[-1]:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.uint16), np.zeros(1, np.int64), to
    doc = np.repeat(np.arange(len(counts)), per)
    a = at[:-1][doc] + (np.arange(to[-1]) - to[:-1][doc]) * PASSAGE
    b = np.minimum(a + PASSAGE, at[1:][doc])
    first, last, n = starts[a], ends[b - 1], (b - a).astype(float)
    size = (last - first).astype(float)
    out = np.empty((len(a), FEATURES), np.float32)
    sums = np.zeros(len(data) + 1, np.int32)
    for j, t in enumerate(_TABLES):
        np.cumsum(t[data], out=sums[1:], dtype=np.int32)
        out[:, j] = (sums[last] - sums[first]) / size
    word_doc, word_part = np.repeat(np.arange(len(counts)), counts), np.repeat(np.arange(len(a)), b - a)
    pair = hashed.copy()
    pair[1:] += hashed[:-1] * np.uint64(0x9E3779B97F4A7C15)
    for j, flag in enumerate((_repeats(word_part, hashed), _repeats(word_part, pair), _repeats(word_doc, pair), ends - starts == 1)):
        out[:, len(_TABLES) + j] = np.bincount(word_part, flag, minlength=len(a)) / n
    out[:, -1] = np.bincount(word_part, ends - starts, minlength=len(a)) / n / 10
    return out, ((hashed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.uint16), np.r_[a, len(hashed)], to


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder, gated attention and output unit."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        init = lambda *s: r.standard_normal(s) / np.sqrt(s[0])
        self.mean, self.scale = mean, scale
        self.p = {"E": 0.1 * r.standard_normal((BUCKETS, HIDDEN)), "W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATES), "U": init(HIDDEN, GATES), "w": init(GATES), "c": init(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, word: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.p
        bag = np.repeat(np.arange(len(at) - 1), np.diff(at))
        own = np.empty((len(x), HIDDEN))
        for i in range(0, len(x), 4096):  # in runs of passages that fit the cache
            part = first[i : i + 4097]
            own[i : i + 4096] = np.add.reduceat(p["E"][word[part[0] : part[-1]]], part[:-1] - part[0]) / np.diff(part)[:, None]
        h = np.tanh(own + ((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = np.exp(np.clip((t * s) @ p["w"], -20, 20))
        alpha = e / np.bincount(bag, e, minlength=len(at) - 1)[bag]
        z = np.stack([np.bincount(bag, alpha * h[:, j], minlength=len(at) - 1) for j in range(HIDDEN)], 1)
        return _sigmoid(z @ p["c"] + p["d"]), {"bag": bag, "h": h, "t": t, "s": s, "alpha": alpha, "z": z}

    def gradients(self, x: np.ndarray, word: np.ndarray, first: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        out, k = self.forward(x, word, first, at)
        bag, h, t, s, alpha, z = (k[n] for n in ("bag", "h", "t", "s", "alpha", "z"))
        dl = (out - y) / len(y)
        dz = np.outer(dl, p["c"])[bag]
        da = (dz * h).sum(1)
        de = alpha * (da - np.bincount(bag, alpha * da, minlength=len(y))[bag])
        dt, ds = np.outer(de, p["w"]) * s * (1 - t**2), np.outer(de, p["w"]) * t * s * (1 - s)
        dh = (alpha[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
        counts = np.diff(first)
        each = np.repeat(dh / counts[:, None], counts, axis=0)
        dwords = np.stack([np.bincount(word, each[:, j], minlength=BUCKETS) for j in range(HIDDEN)], 1)
        return {"E": dwords + DECAY * p["E"], "W": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ dl, "d": dl.sum(keepdims=True)}


def fit(bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> Model | None:
    """Adam over shuffled batches of bags (counts, words, words a passage); the seed is fixed, so equal input gives an equal model."""
    if not bags:
        return None
    every = np.concatenate([b[0] for b in bags])
    model = Model(every.mean(0) if len(every) else np.zeros(FEATURES), every.std(0) + 1e-3 if len(every) else np.ones(FEATURES))
    r, m1, m2, step = np.random.default_rng(2), {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(bags))
        for i in range(0, len(order), 128):
            pick = order[i : i + 128]
            at = np.r_[0, np.cumsum([len(bags[j][0]) for j in pick])]
            x, word, n = (np.concatenate([bags[j][k] for j in pick]) for k in range(3))
            g, step = model.gradients(x, word, np.r_[0, np.cumsum(n, dtype=np.int64)], at, labels[pick]), step + 1
            for k in model.p:
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g[k], 0.999 * m2[k] + 0.001 * g[k] ** 2
                model.p[k] = model.p[k] - RATE * (0.3 if epoch > EPOCHS * 0.7 else 1) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = MAX_TRAIN) -> Model | None:
    y = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.when(F.avg(F.col(label)) >= 0.5, 1.0).otherwise(0.0).alias("y"))
    y = y.orderBy(F.xxhash64("id"), "id").limit(max_docs)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            x, word, first, at = passages(data, offsets)
            ends = list(zip(at[:-1], at[1:]))
            cut = [[x[a:b].tobytes() for a, b in ends], [word[first[a] : first[b]].tobytes() for a, b in ends], [np.diff(first[a : b + 1]).astype(np.uint8).tobytes() for a, b in ends]]
            yield pa.record_batch([part.column("id"), part.column("y"), *(pa.array(c, pa.binary()) for c in cut)], ["id", "y", "x", "w", "n"])

    # At most max_docs rows of one id and one number: small enough to broadcast.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).join(F.broadcast(y.withColumn("id", F.col("id").cast("long"))), "id")
    found = sorted(rows.mapInArrow(describe, "id long, y double, x binary, w binary, n binary").collect(), key=lambda r: (r["id"], bytes(r["x"]), bytes(r["w"])))
    bags = [(np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES), np.frombuffer(r["w"], np.uint16), np.frombuffer(r["n"], np.uint8)) for r in found]
    return fit(bags, np.array([r["y"] for r in found]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            p = np.full(part.num_rows, 0.5) if sent.value is None else sent.value.forward(*passages(data, offsets))[0]
            yield pa.record_batch([part.column("id"), pa.array(p)], ["id", "score"])

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(predict, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs, rest = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5
    model = train(docs, table(spark, sf_dir, "labels").where(rest != 0))
    return score(docs, model).select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
