"""A quality classifier over bytes: learned filters, max-pooled over overlapping chunks of the whole text.

Each filter sums a weight for each of six bytes; filters step by two bytes. A chunk is 512 bytes, the next begins 256
further on, and a filter's response to a chunk is its highest, or 0. A text's mean and highest responses over its
chunks make its probability, by a logistic layer. Everything is numpy: at scoring, two neighbouring bytes' weights
come from one table, so that a filter bank is three look-ups a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import bytewise as bw
from tidemill.llm.store import bounded_batches, cut

TAPS, FILTERS, HALF = 6, 16, 256
STEPS = HALF // 2
#: Defaults of fit(): labelled rows that are learned from at most, half of each label, and their longest text in bytes.
MAX_ROWS, MAX_BYTES = 3000, 1 << 15
UPDATES, BATCH, RATE = 620, 48, 0.01
THRESHOLD = 0.3


@dataclass
class Model:
    taps: np.ndarray  # (TAPS, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    head: np.ndarray  # (2 * FILTERS,)
    offset: float

    def pairs(self) -> np.ndarray:
        """Weights of two bytes, read as a little-endian number, for each of the filter's three steps."""
        return np.stack([(self.taps[k + 1][:, None, :] + self.taps[k][None, :, :]).reshape(65536, FILTERS) for k in range(0, TAPS, 2)]).astype(np.float32)


def _halves(s: bw.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts' bytes, each from a border of HALF on and followed by TAPS zeros at least; halves of each; steps that begin in a text)."""
    size = np.diff(s.offsets)
    halves = (size + TAPS + HALF - 1) // HALF
    begin = (np.cumsum(halves) - halves) * HALF
    data = np.zeros(int(halves.sum()) * HALF + TAPS, np.uint8)
    data[bw.ranges(begin, size)] = s.data
    live = np.arange(int(halves.sum()) * STEPS) * 2 - np.repeat(begin, halves * STEPS) < np.repeat(size, halves * STEPS)
    return data, halves, live


def _chunks(per_half: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left half, right half, row) of each chunk: neighbouring halves, or a row's only one."""
    chunks = np.maximum(halves - 1, 1)
    left = bw.ranges(np.cumsum(halves) - halves, chunks)
    return left, left + np.repeat(halves > 1, chunks), np.repeat(np.arange(len(halves)), chunks)


def _pool(response: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Mean and highest response of each row's chunks."""
    starts = np.searchsorted(row, np.arange(rows))
    count = np.bincount(row, minlength=rows)[:, None]
    return np.concatenate([np.add.reduceat(response, starts, axis=0) / count, np.maximum.reduceat(response, starts, axis=0)], axis=1)


def scores(texts: pa.Array, model: Model, pairs: np.ndarray | None = None) -> np.ndarray:
    """The probability that each text's label is 1."""
    pairs = model.pairs() if pairs is None else pairs
    out = []
    for s in bw.slices(texts, 1 << 18):
        data, halves, live = _halves(s)
        u = data.view("<u2")
        n = len(live)
        best = np.empty((n // STEPS, FILTERS), np.float32)
        for a in range(0, n, 1 << 13):
            z = min(n, a + (1 << 13))
            got = pairs[0][u[a:z]] + pairs[1][u[a + 1 : z + 1]]
            got += pairs[2][u[a + 2 : z + 2]]
            got[~live[a:z]] = -np.inf
            best[a // STEPS : z // STEPS] = got.reshape(-1, STEPS, FILTERS).max(axis=1)
        left, right, row = _chunks(best, halves)
        response = np.maximum(np.maximum(best[left], best[right]) + model.bias.astype(np.float32), 0)
        z = _pool(response, row, s.rows) @ model.head + model.offset
        out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
    return np.concatenate(out) if out else np.zeros(0)


def learn(texts: list[str], labels: np.ndarray, weights: np.ndarray, updates: int = UPDATES, seed: int = 5) -> Model:
    """Fit by Adam on weighted cross entropy; a filter's gradient goes to the bytes of its highest response to a chunk."""
    rng = np.random.default_rng(seed)
    p = {"taps": rng.normal(0, 0.25, (TAPS, 256, FILTERS)), "bias": np.zeros(FILTERS), "head": rng.normal(0, 0.3, 2 * FILTERS), "offset": np.zeros(1)}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, epochs = 0, max(1, round(updates / -(-len(texts) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            g = _gradient(p, [texts[i] for i in pick], labels[pick], weights[pick])
            step += 1
            rate = RATE * (0.3 if epoch >= epochs * 2 // 3 else 1.0)
            for k, v in p.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(p["taps"], p["bias"], p["head"], float(p["offset"][0]))


def _gradient(p: dict, texts: list[str], labels: np.ndarray, weights: np.ndarray) -> dict:
    s = next(bw.slices(pa.array(texts, pa.string()), 1 << 40))
    data, halves, live = _halves(s)
    n = len(live)
    at = np.arange(n) * 2
    z = np.zeros((n, FILTERS))
    for k in range(TAPS):
        z += p["taps"][k][data[at + k]]
    z[~live] = -1e30
    z = z.reshape(-1, STEPS, FILTERS)
    where = z.argmax(axis=1)
    best = np.take_along_axis(z, where[:, None, :], axis=1)[:, 0]
    where = where + np.arange(len(best))[:, None] * STEPS
    left, right, row = _chunks(best, halves)
    from_right = best[right] > best[left]
    raw = np.where(from_right, best[right], best[left]) + p["bias"]
    response = np.maximum(raw, 0)
    rows = len(texts)
    pooled = _pool(response, row, rows)
    prob = 1 / (1 + np.exp(-np.clip(pooled @ p["head"] + p["offset"][0], -40, 40)))
    d = (prob - labels) * weights / weights.sum()
    g = {"head": pooled.T @ d + 1e-4 * p["head"], "offset": np.array([d.sum()])}
    count = np.bincount(row, minlength=rows)
    top = pooled[:, FILTERS:]
    is_top = response == top[row]
    first = np.zeros_like(is_top)  # of equal highest responses the first
    seen = np.cumsum(is_top, axis=0)
    starts = np.searchsorted(row, np.arange(rows))
    before = np.concatenate([np.zeros((1, FILTERS), seen.dtype), seen])[starts]
    first = is_top & (seen - before[row] == 1)
    d_response = d[row][:, None] * (p["head"][:FILTERS] / count[row][:, None] + p["head"][FILTERS:] * first)
    d_raw = d_response * (raw > 0)
    g["bias"] = d_raw.sum(axis=0)
    pos = np.where(from_right, where[right], where[left]) * 2
    f = np.broadcast_to(np.arange(FILTERS), pos.shape)
    g["taps"] = np.stack([np.bincount((data[pos + k].astype(np.int64) * FILTERS + f).ravel(), d_raw.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in range(TAPS)]) + 1e-5 * p["taps"]
    return g


def training_rows(id_col: str) -> Column:
    """Whether a row may be learned from: a known doc_id whose crc32, as text, modulo 5 is not 0."""
    return F.col(id_col).isNotNull() & (F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) != 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model | None:
    """Learn from labelled training rows, of texts of max_bytes at most: max_rows of these, the first by a hash of doc_id,
    up to half of each label; weights restore the labels' shares. Both bounds are on what is learned from, and on what
    comes to the driver; scores are of whole texts of any length. None if no such row has a label."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") <= max_bytes)
    known = labels.filter(training_rows(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    fit_for = known.join(rows.select("doc_id"), "doc_id", "left_semi")  # before any are picked, so that none is missed
    by = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]
    picked = [fit_for.filter(F.col("label") == x).orderBy(*by).limit(max_rows // 2) for x in (0, 1)]
    chosen = cut(picked[0].union(picked[1]), "labelled")  # max_rows rows at most
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    got = rows.join(F.broadcast(chosen), "doc_id").orderBy(*by).limit(2 * max_rows).select("text", "label").toArrow()  # some doc_ids may repeat
    texts, label = got.column("text").to_pylist(), np.array(got.column("label").to_pylist(), float)
    if not texts:
        return None
    share = np.array([totals.get(int(x), 1) / max(1, int((label == x).sum())) for x in label])
    return learn(texts, label, share * len(texts) / share.sum())


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pairs = model.pairs()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1), model, pairs), pa.float64())], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted: one row for each row of docs; score is the probability of label 1 of the whole text.

    Null texts are scored as empty ones, whose every response is 0. Without a model (no labels) every score is 0.5.
    Nothing but the text is read for a score. Repeated rows and null doc_ids give rows like any others.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.select("doc_id", F.lit(0.5).alias("score")) if model is None else rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
