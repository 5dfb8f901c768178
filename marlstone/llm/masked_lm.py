"""Document scores by masked pseudo-likelihood.

A small network predicts each word from the words on both sides of it: the embeddings of the
WIDTH words before and after, each weighted by place, pass a tanh layer; the output is a softmax
over groups of the vocabulary and one within the group. A document's score is the sum of the log
probabilities of all its words. Vocabulary counts cover every document, and in training every word
of every document is masked and predicted once: in round r the places whose number in their
document leaves the remainder r by ROUNDS. Tasks train on their own documents and the models are
averaged by words seen (iterative parameter mixing) after each round.

The network has numbers for the OWN most frequent words only; the others share numbers. A word of a
shared number has its own share of it: its count in the corpus over that of the number. The counts of
all words are a table that grows with the corpus, and scoring joins it by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import table, written

#: Words of their own number, numbers shared by the rest (by hash), groups of the output, embedding size, window and rounds.
OWN, SHARED, GROUP, DIM, WIDTH, ROUNDS = 1792, 256, 32, 16, 2, 2
VOCAB = OWN + SHARED
EDGE = VOCAB  # stands before the first and after the last word
BATCH = 4096
PARTS = 64  # slices in which models are summed


def _count(it):
    for batch in it:
        for b in tk.pieces(batch, "text"):
            data, offs = tk.buffers(b.column("text"))
            s, e, _ = tk.words(data, offs)
            keys, n = np.unique(tk.span_hashes(data, s, e), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


class Vocabulary:
    """Numbers of words: the OWN most frequent have their own, others share SHARED numbers by hash. ``log_total`` has the log of a shared number's count, 0 for others."""

    def __init__(self, top: np.ndarray, totals: np.ndarray):
        order = np.argsort(top)
        self.keys, self.rank = top[order], order.astype(np.int64)
        self.log_total = np.zeros(VOCAB)
        self.log_total[OWN:] = np.log(np.maximum(totals, 1))

    def numbers(self, h: np.ndarray) -> np.ndarray:
        out = OWN + (h % np.uint64(SHARED)).astype(np.int64)
        if len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            out = np.where(self.keys[k] == h, self.rank[k], out)
        return out


def vocabulary(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, DataFrame]:
    """Numbers, and the table (word, n) of all words of all documents; of the table, OWN words and SHARED sums reach the driver."""
    counted = docs.select(F.col(text).alias("text")).mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted, "words")
    top = counted.orderBy(F.desc("n"), "word").limit(OWN).collect()
    keys = np.array([r.word for r in top], np.int64).view(np.uint64)
    # An unsigned remainder by SHARED, a power of two, is the low bits.
    low = F.col("word").bitwiseAND(F.lit(SHARED - 1)).cast("int").alias("low")
    totals = np.zeros(SHARED, np.int64)
    for r in counted.groupBy(low).agg(F.sum("n").alias("n")).collect():
        totals[r.low] = r.n
    for k, r in zip(keys, top):
        totals[int(k) % SHARED] -= r.n
    return Vocabulary(keys, totals), counted


def _order(numbers: np.ndarray) -> np.ndarray:
    """Places in ascending order of numbers, which fit 16 bits: sorted by their digits, not by comparing."""
    return np.argsort(numbers.astype(np.uint16), kind="stable")


def _softmax(z: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Turns the columns of z into their softmax; returns the log probability of the given row of each."""
    z -= z.max(0)
    logp = z[row, n]
    np.exp(z, out=z)
    total = z.sum(0)
    z /= total
    logp -= np.log(total)
    return logp


class Network:
    """Parameters as float32 arrays; ``flat`` and ``set`` turn them into one vector and back."""

    SHAPES = {"E": (VOCAB + 1, DIM), "P": (2 * WIDTH, DIM), "b": (DIM,), "G": (DIM, VOCAB // GROUP), "g": (VOCAB // GROUP,), "W": (VOCAB, DIM), "w": (VOCAB,)}

    def __init__(self, flat: np.ndarray | None = None, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in self.SHAPES.items()}
        self.p["P"] += 1
        if flat is not None:
            self.set(flat)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            v[...] = flat[at : at + v.size].reshape(v.shape)
            at += v.size

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self.p["E"][context]
        a = e[:, 0] * self.p["P"][0]
        for k in range(1, 2 * WIDTH):
            a += e[:, k] * self.p["P"][k]
        a += self.p["b"]
        return e, np.tanh(a, out=a)

    def _output(self, h: np.ndarray, y: np.ndarray):
        """Log probabilities of y, which ascend, and for training the two softmaxes, by groups of the vocabulary.

        The softmaxes have a column for each word, so that maxima and sums run over whole rows at once.
        """
        across = np.ascontiguousarray(h.T)
        n, group = np.arange(len(y)), y // GROUP
        z = self.p["G"].T @ across
        z += self.p["g"][:, None]
        logp = _softmax(z, group, n)
        cut = np.searchsorted(y, np.arange(0, VOCAB + 1, GROUP))
        inner = np.empty((GROUP, len(y)), np.float32)
        for k in np.flatnonzero(np.diff(cut)).tolist():
            own, rows = slice(k * GROUP, (k + 1) * GROUP), slice(cut[k], cut[k + 1])
            np.add(self.p["W"][own] @ across[:, rows], self.p["w"][own][:, None], out=inner[:, rows])
        place = y - group * GROUP
        logp += _softmax(inner, place, n)
        return logp, z, group, inner, place, cut

    def log_probs(self, context: np.ndarray, y: np.ndarray) -> np.ndarray:
        order = _order(y)
        out = np.empty(len(y), np.float32)
        out[order] = self._output(self.hidden(context[order])[1], y[order])[0]
        return out

    def step(self, context: np.ndarray, y: np.ndarray, rate: float, seen: dict) -> float:
        """One AdaGrad step on the mean negative log probability."""
        order = _order(y)
        context, y = context[order], y[order]
        e, h = self.hidden(context)
        logp, pz, group, inner, place, cut = self._output(h, y)
        n, size = np.arange(len(y)), np.float32(len(y))
        pz[group, n] -= 1
        pz /= size
        inner[place, n] -= 1
        inner /= size
        grad = {"G": (pz @ h).T, "g": pz.sum(1), "W": np.zeros_like(self.p["W"]), "w": np.zeros_like(self.p["w"])}
        dh = pz.T @ self.p["G"].T
        for k in np.flatnonzero(np.diff(cut)).tolist():
            own, rows = slice(k * GROUP, (k + 1) * GROUP), slice(cut[k], cut[k + 1])
            part = inner[:, rows]
            grad["W"][own] = part @ h[rows]
            grad["w"][own] = part.sum(1)
            dh[rows] += part.T @ self.p["W"][own]
        da = dh * (1 - h * h)
        grad["b"] = da.sum(0)
        grad["P"] = np.einsum("nkd,nd->kd", e, da)
        # Rows of E by sorted number, so that each number's gradients are summed in one run.
        flat = context.ravel()
        by = _order(flat)
        ascending = flat[by]
        starts = np.flatnonzero(np.r_[True, ascending[1:] != ascending[:-1]])
        numbers = ascending[starts]
        grad["E"] = np.zeros_like(self.p["E"])
        grad["E"][numbers] = np.add.reduceat(da[by // (2 * WIDTH)] * self.p["P"][by % (2 * WIDTH)], starts, axis=0)
        for k, g in grad.items():
            seen[k] = seen.get(k, 1e-6) + g * g
            self.p[k] -= rate * g / np.sqrt(seen[k])
        return float(-logp.mean())


def contexts(ids: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the WIDTH words before and after the places ``at``; EDGE outside the text."""
    doc = np.searchsorted(first, at, "right") - 1
    lo, hi = first[doc], first[doc + 1]
    cols = []
    for k in [*range(-WIDTH, 0), *range(1, WIDTH + 1)]:
        j = at + k
        ok = (j >= lo) & (j < hi)
        cols.append(np.where(ok, ids[np.clip(j, 0, max(len(ids) - 1, 0))], EDGE))
    return np.column_stack(cols)


def _numbers(b: pa.RecordBatch, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offs = tk.buffers(b.column("text"))
    s, e, first = tk.words(data, offs)
    h = tk.span_hashes(data, s, e)
    return vocab.numbers(h), first, h


def _train(vocab: Vocabulary, start: np.ndarray, turn: int, rate: float):
    def run(it):
        net, seen, words = Network(start), {}, 0
        for batch in it:
            for b in tk.pieces(batch, "text", 4 << 20):
                ids, first, _ = _numbers(b, vocab)
                words += len(ids)
                place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
                at = np.flatnonzero(place % ROUNDS == turn)
                at = at[np.argsort(tk.mix(at.astype(np.uint64)))]
                for k in range(0, len(at), BATCH):
                    take = at[k : k + BATCH]
                    net.step(contexts(ids, first, take), ids[take], rate, seen)
        if words:
            parts = np.array_split(net.flat().astype(np.float64) * words, PARTS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PARTS), pa.int32()), pa.array([words] * PARTS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "words", "sums"]
            )

    return run


def _add(key, rows):
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for chunk in rows.column("sums").chunks for x in chunk)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([int(np.asarray(rows.column("words")).sum())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})


_SUMS = "part int, words long, sums binary"


def train(docs: DataFrame, vocab: Vocabulary, text: str = "text", rounds: int = ROUNDS, rate: float = 0.1) -> Network:
    """Average of the tasks' models, ``rounds`` times. Models are summed slice by slice on the executors; one model reaches the driver."""
    flat = Network().flat()
    rows = docs.select(F.col(text).alias("text"))
    for turn in range(rounds):
        made = rows.mapInArrow(_train(vocab, flat, turn, rate), _SUMS)
        # Sums of at most 64 models first, so that no task reads the slices of all of them.
        part = made.withColumn("lot", F.floor(F.spark_partition_id() / 64).cast("int"))
        some = part.groupBy("part", "lot").applyInArrow(_add, _SUMS)
        got = sorted(some.groupBy("part").applyInArrow(_add, _SUMS).collect(), key=lambda r: r.part)
        if got:
            flat = np.concatenate([np.frombuffer(r.sums, np.float64) / r.words for r in got]).astype(np.float32)
    return Network(flat)


def _shared(ids: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Of each text, the distinct words of shared numbers and how often they come."""
    at = np.flatnonzero(ids >= OWN)
    doc, word = np.searchsorted(first, at, "right") - 1, h[at]
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])] if len(at) else np.zeros(0, bool))
    offs = pa.array(np.searchsorted(doc[new], np.arange(len(first))), pa.int32())
    return tuple(pa.ListArray.from_arrays(offs, pa.array(x)) for x in (word[new].view(np.int64), np.diff(np.append(new, len(at))).astype(np.int64)))


_PARTS = "row long, doc_id long, n_words long, known double, word array<long>, times array<long>"


def _score(vocab: Vocabulary, flat: np.ndarray):
    def run(it):
        net = Network(flat)
        row = TaskContext.get().partitionId() << 40
        for batch in it:
            for b in tk.pieces(batch, "text", 4 << 20):
                ids, first, h = _numbers(b, vocab)
                logp = np.empty(len(ids))
                for k in range(0, len(ids), BATCH):
                    at = np.arange(k, min(k + BATCH, len(ids)))
                    logp[at] = net.log_probs(contexts(ids, first, at), ids[at])
                logp -= vocab.log_total[ids]
                sums = np.concatenate([[0.0], np.cumsum(logp)])
                n = np.diff(first)
                total = np.where(n > 0, sums[first[1:]] - sums[first[:-1]], 0.0)
                rows = pa.array(np.arange(row, row + len(n), dtype=np.int64))
                row += len(n)
                yield pa.RecordBatch.from_arrays([rows, b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(total), *_shared(ids, first, h)], [c.split()[0] for c in _PARTS.split(", ")])

    return run


def score(docs: DataFrame, vocab: Vocabulary, counted: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) for each row: the summed log probability of every word given both sides.

    The log probability of a word of a shared number is that of the number, less the log of the number's count (both
    from the network's pass), plus the log of the word's own count, which comes by a join. Words that ``counted``
    lacks count as one. No text is shuffled.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = written(rows.mapInArrow(_score(vocab, net.flat()), _PARTS), "scores")
    each = made.select("row", F.explode(F.arrays_zip("word", "times")).alias("x")).select("row", "x.word", "x.times")
    # The log of a count of one is 0. No word here is one of the OWN most frequent, so no key is hot.
    own = each.join(counted.where("n > 1"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("own"))
    out = made.drop("word", "times").join(own, "row", "left")
    out = out.select("doc_id", "n_words", (F.col("known") + F.coalesce("own", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def op9_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of documents under a network trained on all of them.

    Null and texts without words have no words, likelihood 0 and no mean. Rows that repeat count as often as they
    come. An empty table gives an empty result. Other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab, counted = vocabulary(docs)
    return score(docs, vocab, counted, train(docs, vocab))


ORACLE: dict[str, str] = {}
