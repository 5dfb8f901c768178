"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by FTRL-proximal with elastic-net penalties, one document at a time, then calibrated by
a temperature fitted on a part of the sample that took no part in training.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import table

BITS = 13
ORDERS = (1, 2, 3)
#: Documents of a language that the model is fitted on: those with the smallest hashes of doc_id. Counts cover all documents.
PER_LANGUAGE = 800
#: The part of the sample that only sets the temperature.
CALIBRATION = 4
#: Texts that are counted together: a row of 2**BITS counts takes up to 12 bytes a cell.
ROWS = 1024
_MULTIPLY = np.random.default_rng(5).integers(1, 2**31, (max(ORDERS), max(ORDERS)), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point its lower case, or 32 for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts and where each text's begin (one more at the end)."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return _folded()[points], leads[offs]


def counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts, a row for each text, and whether the text has a letter. A run of non-letters counts as one blank."""
    c, at = characters(data, offs)
    n, d = len(at) - 1, 1 << BITS
    doc = np.repeat(np.arange(n), np.diff(at))
    letters = np.zeros(n, bool)
    keep = c != 32
    letters[doc[keep]] = True
    keep[1:] |= c[:-1] != 32
    c, doc = c[keep], doc[keep]
    out = np.zeros(n * d, np.float32)
    for k in ORDERS:
        m = len(c) - k + 1
        if m <= 0:
            break
        h = c[:m] * _MULTIPLY[k - 1, 0]
        for j in range(1, k):
            h = (h ^ (h >> np.uint32(15))) + c[j : m + j] * _MULTIPLY[k - 1, j]
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        place = doc[:m] * d + (h >> np.uint32(32 - BITS))
        whole = doc[:m] == doc[k - 1 :]
        out += np.bincount(place[whole], minlength=n * d).astype(np.float32)
    return out.reshape(n, d), letters


def tf_idf(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf, out=tf)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.maximum(norm, 1e-12)[:, None]
    return x


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression, per-coordinate FTRL-proximal; l1 keeps weights exactly zero, l2 small."""

    def __init__(self, classes: int, dims: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002):
        self.z, self.n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx=slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, idx: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(idx)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        s = (np.sqrt(self.n[idx] + g * g) - np.sqrt(self.n[idx])) / self.alpha
        self.z[idx] += g - s * w
        self.n[idx] += g * g


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The T that minimises the negative log likelihood of softmax(logits / T), by golden section in log T."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    lo, hi, r = -4.0, 4.0, (5**0.5 - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    fa, fb = loss(a), loss(b)
    for _ in range(40):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - r * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + r * (hi - lo)
            fb = loss(b)
    return float(np.exp((lo + hi) / 2))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 4, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights (the last row is the bias) and temperature from sparse TF-IDF rows."""
    model, rng, dims = Ftrl(classes, 1 << BITS), np.random.default_rng(seed), 1 << BITS
    rows = [(np.append(i, dims), np.append(x, 1.0)) for i, x in rows]
    held = np.arange(len(rows)) % CALIBRATION == 0
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    for _ in range(epochs):
        for k in rng.permutation(train):
            model.step(*rows[k], int(y[k]))
    w = model.weights()
    logits = np.array([x @ w[i] for i, x in (rows[k] for k in np.flatnonzero(held))]).reshape(-1, classes)
    return w, temperature(logits, y[held])


def _document_counts(it):
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in it:
        for b in tk.pieces(batch, "text", 1 << 20, ROWS):
            tf, _ = counts(*tk.buffers(b.column("text")))
            df += (tf > 0).sum(axis=0)
            n += len(tf)
    i = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(df[i], n))], ["feature", "df"])


def _sparse(idf: np.ndarray):
    def run(it):
        for batch in it:
            for b in tk.pieces(batch, "text", 1 << 20, ROWS):
                x = tf_idf(counts(*tk.buffers(b.column("text")))[0], idf)
                cells = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("lang"), pa.array([i.astype("<u2").tobytes() for i in cells]), pa.array([r[i].astype("<f4").tobytes() for r, i in zip(x, cells)])],
                    ["doc_id", "lang", "i", "x"],
                )

    return run


def _predict(classes: list[str], w: np.ndarray, idf: np.ndarray, t: float):
    def run(it):
        for batch in it:
            for b in tk.pieces(batch, "text", 1 << 20, ROWS):
                tf, letters = counts(*tk.buffers(b.column("text")))
                if classes:
                    p = softmax((tf_idf(tf, idf) @ w[:-1] + w[-1]) / t)
                    best = p.argmax(axis=1)
                    lang = np.where(letters, np.array(classes, object)[best], "und")
                    score = np.where(letters, p[np.arange(len(p)), best], 0.0)
                else:
                    lang, score = np.full(len(tf), "und", object), np.zeros(len(tf))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(lang, pa.string()), pa.array(score.astype(np.float64))], ["doc_id", "row", "lang_pred", "score"])

    return run


class Model:
    """What ``train`` returns: classes, weights, inverse document frequencies and temperature; a few hundred kB."""

    def __init__(self, classes, weights, idf, t):
        self.classes, self.weights, self.idf, self.temperature = classes, weights, idf, t

    def predict(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.struct(*keep).alias("row") if keep else F.lit(0).alias("row"), F.col(text).alias("text"))
        kind = dict(rows.dtypes)
        out = rows.mapInArrow(
            _predict(self.classes, self.weights.astype(np.float32), self.idf, self.temperature),
            f"doc_id {kind['doc_id']}, row {kind['row']}, lang_pred string, score double",
        )
        return out.select("doc_id", *[f"row.{k}" for k in keep], "lang_pred", "score")


def _accept(predict, least: float):
    def run(it):
        for batch in it:
            for b in tk.pieces(batch, "text", 1 << 20, ROWS):
                named = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int32()), b.column("text")], ["doc_id", "row", "text"])
                for got in predict(iter([named])):
                    lang, score = got.column("lang_pred").to_pylist(), np.asarray(got.column("score"))
                    yield b.filter(pa.array([x != "und" for x in lang]) if least <= 0 else pa.array([x != "und" and p >= least for x, p in zip(lang, score)]))

    return run


def accept(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows of ``docs`` (with a column text) whose language is recognised with a score of at least ``least``; all columns stay."""
    predict = _predict(model.classes, model.weights.astype(np.float32), model.idf, model.temperature)
    return docs.mapInArrow(_accept(predict, least), docs.schema)


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on rows with a language; document frequencies come from all of them, weights from PER_LANGUAGE of each language.

    At most PER_LANGUAGE distinct documents of each language reach the driver, however often a row repeats.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = 1 << BITS
    found = rows.select("text").mapInArrow(_document_counts, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(d), 0
    for r in found:  # at most 2**BITS + 1 rows
        if r.feature < 0:
            n = r.df
        else:
            df[r.feature] = r.df
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # Texts are told apart by (doc_id, hash); those whose hash is below four times the wanted share of their language are ranked, so no language is ranked whole.
    rows = rows.withColumn("h", F.xxhash64("text"))
    ids = rows.select("doc_id", "h", "lang").distinct().withColumn("r", F.xxhash64("doc_id", "h"))
    often = ids.groupBy("lang").agg(F.count("*").alias("n"))
    near = ids.join(often, "lang").where(F.pmod("r", F.lit(1 << 30)) < F.ceil(F.lit(4.0 * PER_LANGUAGE * (1 << 30)) / F.col("n")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("r", F.lit(1 << 30)), "r", "doc_id"))
    ids = near.withColumn("k", nth).where(F.col("k") <= PER_LANGUAGE).select("doc_id", "h", "lang")
    sample = rows.join(F.broadcast(ids), ["doc_id", "h", "lang"], "left_semi").select("doc_id", "lang", "text")  # PER_LANGUAGE rows a language
    # Copies of a row are one row again before anything reaches the driver.
    got = sample.mapInArrow(_sparse(idf), "doc_id long, lang string, i binary, x binary").distinct().collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.lang, bytes(r.x), bytes(r.i)))
    classes = sorted({r.lang for r in got})
    if not classes:
        return Model([], np.zeros((d + 1, 1)), idf, 1.0)
    y = np.array([classes.index(r.lang) for r in got])
    cells = [(np.frombuffer(r.i, "<u2").astype(np.int64), np.frombuffer(r.x, "<f4").astype(np.float64)) for r in got]
    w, t = fit(cells, y, len(classes))
    return Model(classes, w, idf, t)


def remainder(doc_id: str, m: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % m


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of documents.

    Whole texts are read, however long. Null texts and texts without a letter are ``und`` with score 0. A null doc_id is not held out and teaches
    nothing. Rows that repeat are predicted as often as they come. Without a labelled row all is ``und``.
    An empty table gives an empty result. Other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(docs.where(remainder("doc_id", 5) != 0))
    out = model.predict(docs.select("doc_id", "text"))
    return out.select("doc_id", (F.coalesce(remainder("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "lang_pred", "score")


ORACLE: dict[str, str] = {}
