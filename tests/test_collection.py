"""Documents under several configurations, search with the best one, answers with their evidence, tables as text and as cells."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import collection, layout, providers
from marlstone.sources import ir, shapes
from marlstone.sources.tables import Tables

ELEMENTS = "doc string, title string, page int, y double, kind string, ord int, text string"


class Short(providers.HashingEmbedder):
    """Gives no vector for long texts, and embeds queries in its own way."""

    asked: list = []

    def embed(self, texts):
        return F.when(F.length(texts) < 30, super().embed(texts))

    def embed_query(self, texts):
        self.asked.append(1)
        return providers.HashingEmbedder.embed(self, texts)


@pytest.fixture
def made(spark, tmp_path):
    rows = [("a", "Alpha", 1, 1.0, "heading", 1, "1 Power"), ("a", "Alpha", 1, 2.0, "text", 2, "The bus gives 28 volts."), ("a", "Alpha", 2, 1.0, "text", 3, "A long text about the heater of the unit, which is TBD."), ("b", "Beta", 1, 1.0, "text", 1, "Torque shall be low.")]
    c = collection.Collection(Tables(spark, f"file://{tmp_path}/c"), [collection.Configuration("para", "paragraph"), collection.Configuration("short", "paragraph", {}, Short(16))])
    counts = c.ingest(spark.createDataFrame(rows, ELEMENTS))
    assert sorted(tuple(r) for r in counts.collect()) == [("icd_para", 4, 0), ("icd_short", 3, 1)]
    return c


def test_ingest_again_replaces_a_document_in_all_indices(spark, made):
    at = made.tables.version()
    counts = made.ingest(spark.createDataFrame([("a", "Alpha", 1, 1.0, "text", 1, "New text.")], ELEMENTS))
    assert sorted(tuple(r) for r in counts.collect()) == [("icd_para", 1, 0), ("icd_short", 1, 0)] and made.tables.version() == at + 1
    for c in made.configurations:
        assert sorted((r.document_hash, r.text) for r in made.chunks(c).collect()) == [("a", "New text."), ("b", "Torque shall be low.")]
    assert made.tables.read("icd_short__quarantine").count() == 0 and made.tables.read("icd_para", at).count() == 4
    with pytest.raises(ValueError):
        collection.Collection(made.tables, [made.configurations[0]] * 2)


def test_search_uses_the_best_configuration_of_the_last_run(spark, made):
    runs = spark.createDataFrame([("r1", "para/rrf", 0.9), ("r2", "para/rrf", 0.4), ("r2", "short/rrf", 0.5)], "run_id string, config string, mean_recall double")
    assert made.best(runs).name == "short" and made.best(None).name == "para" and made.best(runs.where("run_id = 'none'")).name == "para"
    assert made.best(spark.createDataFrame([("r", "gone/x", 1.0)], "run_id string, config string, mean_recall double")).name == "para"
    queries = spark.createDataFrame([(1, "heater unit"), (2, "torque")], "query_id long, query string")
    first = lambda **o: {r.query_id: r.chunk_id for r in made.search(queries, **o).where("rank = 1").collect()}
    assert first(mode="keyword") == {1: "a_2", 2: "b_0"} and first(mode="vector", runs=runs)[2] == "b_0" and Short.asked
    assert {r.chunk_id for r in made.search(queries, "keyword", by={"document_hash": "b"}).collect()} == {"b_0"}


class Down(providers.ExtractiveGenerator):
    def answer(self, question, context):
        return F.lit(None).cast("string")


def test_answers_with_evidence_failures_and_nothing_found(spark, made):
    queries = spark.createDataFrame([(1, "heater unit volts"), (2, "zzz"), (3, "torque")], "query_id long, query string")
    got = {r.query_id: r for r in made.ask(queries, mode="keyword").collect()}
    assert got[2].answer == collection.NOTHING and got[2].confidence == "low" and got[2].warning == collection.NOTHING_WARNING and got[2].n_passages == 0 and not got[2].generated
    assert got[1].n_passages == 2 and got[1].open_items and got[1].generated and got[1].warning is None and got[3].contractual and not got[3].open_items
    down = {r.query_id: r for r in made.ask(queries, mode="keyword", generator=Down()).collect()}
    assert down[3].answer == collection.FAILED + "[1] b_0: Torque shall be low.\n\n" and not down[3].generated and down[2].answer == collection.NOTHING


def test_tables_as_text(spark):
    rows = [{"id": "r1", "cells": {"a": {"value": "1"}, "b": {"value": None}}}, {"id": "r2", "cells": {"b": {"value": "x"}}}]
    t = spark.createDataFrame([({"id": "t", "columns": [{"id": "a"}, {"id": "b"}], "rows": rows},), ({"id": "u", "columns": [], "rows": []},)], f"t {ir.TABLE}")
    assert [r.x for r in t.select(collection.table_text(F.col("t")).alias("x")).collect()] == ["1 | \n | x", ""]
    docs = [{"rows": [["a", 1, None], {"cells": [{"text": "b"}, {}]}]}, {"cells": [{"text": "x"}, {"text": ""}, {"text": "y"}]}, {}]
    v, _ = shapes.parse(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, text string"))
    assert [r.x for r in v.orderBy("id").select(shapes.table_text(F.col("v")).alias("x")).collect()] == ["a | 1 | \nb | ", "x | y", ""]


def test_table_cells_equal_a_loop(spark):
    r = random.Random(6)
    pages = {p: [(r.choice(["t", "u ", " ", ""]) + str(k) * (r.random() < 0.9), float(r.randint(0, 200)), round(r.choice([55, 60, 90, 92, 95, 101, 400, 731, 733]) + r.random(), 2)) for k in range(r.randint(0, 14))] for p in range(40)}
    rows = [("d", p, t, x, y, x + 9, y + 9) for p, s in pages.items() for t, x, y in s]
    got = {}
    for c in layout.table_cells(spark.createDataFrame(rows, "doc string, page int, text string, x0 double, y0 double, x1 double, y1 double")).collect():
        got.setdefault(c.page, []).append((c.row, c.col, c.text, c.id, c.rows, c.columns))
    want = {}
    for p, spans in pages.items():
        kept = sorted((y, x, t.strip()) for t, x, y in spans if t.strip() and 60 <= y <= 732)
        lines = []
        for s in kept:
            home = next((line for line in lines if abs(s[0] - line[0][0]) < 5), None)
            lines.append([s]) if home is None else home.append(s)
        if len(kept) >= 4 and len(lines) >= 2 and max(map(len, lines)) >= 2:
            want[p] = [(i, j, s[2], f"cell-p{p:02d}-r{i}-c{j}", len(lines), max(map(len, lines))) for i, line in enumerate(lines) for j, s in enumerate(sorted(line, key=lambda s: (s[1], s[0], s[2])))]
    assert {p: sorted(v) for p, v in got.items()} == want and len(want) > 10
