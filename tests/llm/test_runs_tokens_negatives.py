"""Runs of repeated patterns, byte-level ids and hard negatives against brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from marlstone.llm import byte_bpe, hard_negatives, periodic
from marlstone.llm import textkit as tk

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, exponent=4, least=6):
    """Every period, every stretch that keeps it; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q) and j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in found.items())


def random_words(r):
    k, out = r.choice([1, 2, 3, 6]), []
    for _ in range(r.randint(0, 9)):
        out += [f"w{r.randint(0, k)}" for _ in range(r.randint(1, 5))] * r.randint(1, 9)
        if r.random() < 0.4:
            a = r.randrange(len(out))
            out += out[a : a + r.randint(1, 80)]
    return out


@pytest.mark.parametrize("exponent,least,rounds", [(4, 6, 64), (4, 6, 0), (3, 1, 64), (2, 2, 1)])
def test_runs_equal_comparison_of_all_periods(monkeypatch, exponent, least, rounds):
    monkeypatch.setattr(periodic, "ROUNDS", rounds)
    r = random.Random(exponent + rounds)
    for _ in range(150):
        texts = [random_words(r) for _ in range(r.randint(1, 6))]
        key = np.array([zlib.crc32(w.encode()) for t in texts for w in t], np.uint64)
        seq = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        first = np.cumsum([0, *map(len, texts)])
        want = [(a + o, b + o, q) for t, o in zip(texts, first) for a, b, q in plain_runs(t, exponent, least)]
        assert sorted(map(tuple, periodic.find_runs(key, seq, exponent, least).tolist())) == sorted(want)


def test_longest_previous_factors_by_comparison():
    r = random.Random(4)
    for _ in range(60):
        w = [r.randint(0, 2) for _ in range(r.randint(1, 50))]
        lpf, source = periodic.longest_previous(periodic.Suffixes(np.array(w, np.uint64), np.zeros(len(w), np.int64)))
        for i in range(len(w)):
            common = [next((k for k in range(len(w) - i) if w[i + k] != w[j + k]), len(w) - i) for j in range(i)]
            assert lpf[i] == max(common, default=0) and (not lpf[i] or common[source[i]] == lpf[i])


def contract_words(doc_id, text):
    w = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def run_rows(rows):
    for doc_id, text in rows:
        w = contract_words(doc_id, text)
        runs = sorted(plain_runs(w), key=lambda x: (x[0], x[2]))
        gone = {i for a, b, q in runs for i in range(a + q, b)}
        best = min(runs, key=lambda x: (x[0] - x[1], x[0], x[2]), default=None)
        top = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
        lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
        yield doc_id, len(runs), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(x for i, x in enumerate(w) if i not in gone)))


def documents(folder, rows):
    pq.write_table(pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "runs": pa.array([1] * len(rows)), "ids": pa.array(["x"] * len(rows)), "_text": pa.array([2] * len(rows))}), f"{folder}/documents.parquet")
    return str(folder)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op11_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tk, "pieces", lambda batch, text, most=20_000, f=tk.pieces: f(batch, text, most))
    r = random.Random(2)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "a " * 5000), (5, "A a A a A a A a A a"), (6, "é\x0bé é é\té é x\x85y"), (7, "x" * 100_000)]
    rows += [(i, r.choice([" ", "\n", "  "]).join(random_words(r))) for i in range(8, 300)]
    rows += [(i, " ".join(f"u{j}" for j in range(r.randint(1, 400)))) for i in range(300, 700)]  # a tenth of these are rearranged
    rows += [(20, "the same id with another text"), (20, "the same id with another text")]
    got = periodic.op11_periodic_runs(spark, documents(tmp_path, rows)).select(*COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, run_rows(rows))) and sum(x.n_runs > 0 for x in got) > 150


def test_op11_one_text_above_a_piece(spark):
    words = [f"w{i}" for i in range(1_300_000)]
    words[700_000:700_040] = ["p", "q"] * 20
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = periodic.collapse(docs).selectExpr("runs", "length(collapsed) as n", "md5(collapsed) as h").collect()[0]
    assert [tuple(x) for x in got.runs] == [(700_000, 40, 2)]
    left = " ".join(words[:700_002] + words[700_040:])
    assert (got.n, got.h) == (len(left), hashlib.md5(left.encode()).hexdigest())


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = [*"abXY09'.,!- \n\t\r\x0b\x0c\x85\xa0　 \x1c\x1f日本テé²٣。、’ſ‍😀", "  ", "\n\n", "'s", "'ll", " '", "      ", "<|endoftext|>"]


def test_parts_of_long_texts_have_the_ids_of_the_whole(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART", 30)
    monkeypatch.setattr(byte_bpe, "RUN", 6)
    monkeypatch.setattr(byte_bpe, "_WHITE_RUN", regex.compile(f"[{byte_bpe.WHITE}]{{6,}}"))
    codec, r = byte_bpe.Codec(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN), random.Random(1)
    for _ in range(8000):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 150)))
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text) and codec.decode(np.array(ids, "<u4")) == text.encode()


def test_white_space_beyond_the_stack_of_the_library(library):
    codec = byte_bpe.codec(public_tokenizers.path(byte_bpe.RANKS))
    for tail in ("", "a", " \na"):
        text = "x" + " " * 3_000_000 + tail
        ids = codec.encode(text)
        assert codec.decode(np.array(ids, "<u4")) == text.encode() and len(ids) >= 2_999_990
    short = "x" + " " * 200_000 + "a\n" + "\n" * 100_000
    assert codec.encode(short) == library.encode_ordinary(short)


def test_decode_takes_any_ids_and_refuses_other_numbers(library):
    codec = byte_bpe.codec(public_tokenizers.path(byte_bpe.RANKS))
    ids = library.encode_ordinary("日本😀")
    assert b"".join(codec.decode(np.array([i], "<u4")) for i in ids).decode() == "日本😀"
    with pytest.raises(ValueError):
        codec.decode(np.array([50256], "<u4"))


def test_op12_equals_the_library(spark, tmp_path, library):
    r = random.Random(3)
    rows = [(None, "no id"), (1, None), (2, ""), (3, "<|endoftext|>"), (4, "\x00\x7f"), (5, "word " * 400_000), (6, "z" * 300_000), (7, "twice"), (7, "twice"), (7, "other")]
    rows += [(i, "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 300)))) for i in range(10, 200)]
    rows += [(i, "") for i in range(1000, 12_000)]
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = byte_bpe.op12_byte_bpe(spark, documents(tmp_path, rows)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def plain_negatives(rows, anchors, positives=5, negatives=3, least=50, most=95):
    """rows: distinct (id, label, vector); rows that share an id are told apart by their place."""
    out = []
    for k, (a, label, v) in enumerate(rows):
        if a not in anchors:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), i, other) for j, (i, other, w) in enumerate(rows) if j != k and len(w) == len(v)]
        scores.sort(key=lambda s: (-s[0], s[1]))
        for p, i, _ in [s for s in scores if s[2] == label][:positives]:
            fits = [s for s in scores if s[2] != label and least * p <= 100 * s[0] <= most * p][:negatives]
            out += [(a, i, n + 1, s[1], p, s[0]) for n, s in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_mine_brute_force(spark, monkeypatch, seed):
    for name, value in (("LEAF", 16), ("TREE", 150), ("BLOCK", 7), ("CHUNK", 11)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = np.random.default_rng(seed)
    rows = [(i, int(r.integers(0, 4)) if i % 3 else 0, r.integers(-4, 5, 5).tolist()) for i in range(700)]  # label 0 has more than a third
    rows += [(i, 1, [2, 1, 0, -1, 3]) for i in range(700, 1100)] + [(i, 2, [2, 1, 0, -1, 2]) for i in range(1100, 1300)]  # copies and ties
    rows += [(1300, 5, [1] * 5), (1301, 3, [0] * 5), (1302, 3, [1, 2]), (1303, 2, [1, 1]), (1304, 3, [2, 2])]
    anchors = [i for i, *_ in rows if i % 20 == 0 or i >= 1295]
    df = spark.createDataFrame(rows, "id long, label int, v array<bigint>")
    got = hard_negatives.mine(df.unionByName(df.where("id < 50")), df.where(F.col("id").isin(anchors)))
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, set(anchors))


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(0, 1, [4, 0]), (0, 1, [3, 3]), (5, 1, [5, 1]), (6, 2, [3, 0]), (7, 2, [2, 2]), (7, 3, [2, 1])]
    df = spark.createDataFrame(rows, "id long, label int, v array<bigint>")
    got = hard_negatives.mine(df, df.where("id = 0"))
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, {0})


def test_ball_tree_prunes_and_stays_exact():
    r = np.random.default_rng(5)
    centres = r.integers(-400, 401, (30, 12))
    of = r.integers(0, 30, 12_000)
    x, labels = centres[of] + r.integers(-3, 4, (12_000, 12)), of % 5
    tree = hard_negatives.BallTree(hard_negatives.build(x), np.arange(12_000), np.arange(12_000), labels, x)
    asked = np.arange(0, 12_000, 400)
    lo, hi = np.full(30, hard_negatives.LOWEST), np.full(30, hard_negatives.HIGHEST)
    ask, score, ids, _ = tree.search(x[asked], labels[asked], asked, np.arange(30), lo, hi, True, 5)
    for k, a in enumerate(asked):
        s = x @ x[a]
        rows = np.flatnonzero((labels == labels[a]) & (np.arange(12_000) != a))
        assert ids[ask == k].tolist() == rows[np.lexsort((rows, -s[rows]))][:5].tolist() and score[ask == k][0] == s[rows].max()
    assert tree.computed < 0.4 * 30 * 12_000


def test_op13_leaves_out_null_and_non_finite(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 2, [1.0, 0.25]), (2, 2, [0.9, 0.5]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 1, [nan, 1.0]), (6, 1, [inf, 1.0]), (8, 1, [None, 1.0]), (None, 1, [1.0, 1.0]), (7, 1, [0.75, 0.5]), (14, 9, [0.5, 0.5])]
    cols = list(zip(*rows))
    pq.write_table(pa.table({"vec_id": pa.array(cols[0], pa.int64()), "label": pa.array(cols[1], pa.int32()), "embedding": pa.array(cols[2], pa.list_(pa.float32())), "row": ["?"] * len(rows), "tree": ["?"] * len(rows)}), f"{tmp_path}/embeddings.parquet")
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = hard_negatives.op13_hard_negatives(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == plain_negatives(kept, {0}) and got
