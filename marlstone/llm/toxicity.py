"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained in numpy from confirmed
toxic documents and unlabelled text. With the class prior pi its risk is
pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]); when the second part falls below zero the
step goes against it, which keeps the classifier from fitting unlabelled text as clean. Features
that are no more frequent in toxic than in unlabelled text, or no less, get no weight: ``screen``
leaves them out before any risk is lowered. Scores are then set on the scale of probabilities with
labelled rows that took no part in training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import table
from .language_id import remainder

BITS = 17
#: Bounds of the sample: confirmed toxic, unlabelled, and labelled rows for the final scale; those with the smallest hashes of doc_id.
POSITIVE, UNLABELLED, SCALE = 4000, 8000, 2500
CUT = 0.7
#: Beginnings of words that are features besides the word.
STARTS = (3, 5)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, one after the other, and where each text's begin (one more at the end)."""
    n = len(offs) - 1
    inside = _LETTER[data]
    start, end = inside.copy(), inside.copy()
    if data.size:
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = offs[(offs > 0) & (offs < data.size)]
        start[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(s, offs)
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    keys = [tk.span_hashes(data, s, e)]
    for k in STARTS:
        keys.append(tk.mix(tk.span_hashes(data, s, np.minimum(e, s + k)) + np.uint64(k)))
    shift = np.uint64(64 - BITS)
    cells = np.unique(np.concatenate([(doc << np.uint64(BITS)) | (h >> shift) for h in keys]))
    at = np.searchsorted(cells, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))
    return (cells & np.uint64((1 << BITS) - 1)).astype(np.int64), at


def scores(cells: np.ndarray, at: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    """Sum of the weights of a text's features."""
    total = np.concatenate([[0.0], np.cumsum(w[cells])])
    return total[at[1:]] - total[at[:-1]] + bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def screen(positive: list[np.ndarray], unlabelled: list[np.ndarray], least_z: float = 4.0, least_lift: float = 2.0) -> np.ndarray:
    """Features whose share of documents differs between the two samples: beyond chance, and by a factor of two."""
    dims = 1 << BITS
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    p = np.bincount(np.concatenate([*positive, np.zeros(0, np.int64)]), minlength=dims) / n_p
    u = np.bincount(np.concatenate([*unlabelled, np.zeros(0, np.int64)]), minlength=dims) / n_u
    both = (p * n_p + u * n_u) / (n_p + n_u)
    z = (p - u) / np.sqrt(np.maximum(both * (1 - both) * (1 / n_p + 1 / n_u), 1e-12))
    lift = (p + 0.5 / n_p) / (u + 0.5 / n_u)
    return np.flatnonzero((np.abs(z) >= least_z) & ((lift >= least_lift) | (lift <= 1 / least_lift)))


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative risk with logistic loss, by Adam on mini-batches of the screened features."""
    rng, dims = np.random.default_rng(seed), 1 << BITS
    out = np.zeros(dims)
    chosen = screen(positive, unlabelled)
    if not len(chosen):
        return out, float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0
    place = np.full(dims, -1)
    place[chosen] = np.arange(len(chosen))
    positive, unlabelled = ([place[r][place[r] >= 0] for r in rows] for rows in (positive, unlabelled))
    theta = np.zeros(len(chosen) + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def batch(rows: list[np.ndarray], k: int):
        got = [rows[i] for i in rng.integers(0, len(rows), min(k, len(rows)))]
        return np.concatenate(got), np.concatenate([[0], np.cumsum([len(r) for r in got])])

    def gradient(cells, at, slope):
        g = np.bincount(cells, weights=np.repeat(slope, np.diff(at)), minlength=len(theta))
        g[-1] += slope.sum()
        return g

    for t in range(1, steps + 1):
        (pc, pa_), (uc, ua) = batch(positive, 256), batch(unlabelled, 1024)
        gp, gu = scores(pc, pa_, theta[:-1], theta[-1]), scores(uc, ua, theta[:-1], theta[-1])
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        slope_u, slope_p = sigmoid(gu) / len(gu), -prior * sigmoid(gp) / len(gp)
        if negative >= 0:
            slope_p = slope_p - prior * sigmoid(-gp) / len(gp)
        else:  # undo what was fitted too far
            slope_u, slope_p = -slope_u, -slope_p
        g = gradient(pc, pa_, slope_p) + gradient(uc, ua, slope_u)
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate / (1 + 3 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    out[chosen] = theta[:-1]
    return out, float(theta[-1])


def scale(g: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a > 0 and c such that sigmoid(a * g + c) fits the labels (Platt), by Newton steps; a weak prior keeps separable data finite."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(g.std(), 1e-9)
    x = np.column_stack([(g - g.mean()) / spread, np.ones(len(g))])
    k = np.array([1.0, 0.0])
    ridge = np.array([1e-3, 1e-6])
    for _ in range(50):
        p = sigmoid(x @ k)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, x.T @ (t - p) - ridge * k)
        k = k + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    a = max(k[0], 1e-6) / spread
    return float(a), float(k[1] - a * g.mean())


def _collect(it):
    for batch in it:
        for b in tk.pieces(batch, "text", 4 << 20):
            cells, at = features(*tk.buffers(b.column("text")))
            rows = [cells[i:j].astype("<u4").tobytes() for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("toxic"), pa.array(rows, pa.binary())], ["doc_id", "part", "toxic", "cells"])


def _score(w: np.ndarray, bias: float, a: float, c: float):
    def run(it):
        for batch in it:
            for b in tk.pieces(batch, "text", 4 << 20):
                g = scores(*features(*tk.buffers(b.column("text"))), w, bias)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sigmoid(a * g + c))], ["doc_id", "score"])

    return run


class Model:
    def __init__(self, weights: np.ndarray, bias: float, a: float, c: float):
        self.weights, self.bias, self.a, self.c = weights, bias, a, c

    def predict(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
        """(doc_id, score, predicted) for each row; null text counts as empty."""
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        out = rows.mapInArrow(_score(self.weights.astype(np.float32), self.bias, self.a, self.c), "doc_id long, score double")
        return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on rows of ``docs``. labels (doc_id, toxic): 1 is confirmed toxic, 0 clean.

    The unlabelled sample is drawn from all rows whatever their label, and the prior for it is the toxic share
    of the labelled rows. A quarter of the rows, by hash, takes no part in that; those of it with a label set
    the final scale. A doc_id with several labels counts as toxic if any says so. At most POSITIVE + UNLABELLED
    + SCALE distinct documents reach the driver, however often a row repeats.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null").withColumn("t", F.xxhash64("text"))
    ids = rows.select("doc_id", "t").distinct().join(known, "doc_id", "left").withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id", "t"))
    held = F.pmod("h", F.lit(4)) == 0
    share = ids.where("toxic is not null").agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not share:
        return Model(np.zeros(1 << BITS), 0.0, 1.0, -5.0)
    lots = [(ids.where(~held & (F.col("toxic") == 1)), POSITIVE), (ids.where(~held), UNLABELLED), (ids.where(held & F.col("toxic").isNotNull()), SCALE)]
    # Each lot in an order of its own, so that the unlabelled do not begin with the same documents as the toxic.
    parts = [lot.orderBy(F.xxhash64("h", F.lit(k)), "doc_id").limit(n).select("doc_id", "t", F.lit(k).alias("part"), "toxic") for k, (lot, n) in enumerate(lots)]
    picked = parts[0].unionByName(parts[1]).unionByName(parts[2])  # at most the three bounds together
    sample = rows.join(F.broadcast(picked), ["doc_id", "t"]).select("doc_id", "part", "toxic", "text")
    # Copies of a row are one row again before anything reaches the driver.
    got = sample.mapInArrow(_collect, "doc_id long, part int, toxic int, cells binary").distinct().collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.cells), r.part))
    rows: list[list] = [[], [], []]
    for r in got:
        rows[r.part].append((np.frombuffer(r.cells, "<u4").astype(np.int64), r.toxic))
    w, bias = nnpu([c for c, _ in rows[0]], [c for c, _ in rows[1]], float(share))
    held = rows[2]
    g = np.array([w[c].sum() + bias for c, _ in held])
    return Model(w, bias, *scale(g, np.array([y == 1 for _, y in held], float)))


def op8_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of documents.

    Whole texts are read, however long. Null and empty texts get the score of a text without features. A null doc_id is not held out and teaches
    nothing. Rows that repeat are scored as often as they come. Without a toxic label all is clean. An empty
    table gives an empty result. Other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    model = train(docs.where(remainder("doc_id", 3) != 1), labels.where(remainder("doc_id", 3) != 1))
    return model.predict(docs).select("doc_id", (F.coalesce(remainder("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "score", "predicted")


ORACLE: dict[str, str] = {}
