"""Nested documents taken apart and put together; windows and joins of streams that come out of order."""

import datetime
import random

from pyspark.sql import functions as F

from marlstone.operators import assemble
from marlstone.sources import ir
from marlstone.streaming import events

T0 = datetime.datetime(2024, 1, 1)


def block(r, page, place):
    return {"id": f"b{page}-{place}", "block_type": r.choice(["paragraph", "heading", None]), "page": page, "bbox": {"x0": 1.0, "y0": float(place), "x1": 2.0, "y1": 3.0}, "text_verbatim": r.choice(["text", "", None]), "reading_order": place, "style": {"font_size_pt": 9.5, "bold": True}, "confidence": 0.5, "is_ocr": False}


def random_documents(n=12):
    r, out = random.Random(4), []
    for d in range(n):
        pages = []
        for p in r.sample(range(1, 30), r.randint(0, 6)):
            table = {"id": f"t{p}", "caption": None, "page": p, "rows": [{"id": "r1", "cells": {"a": {"value": "1", "row_span": 2}, "b": {"value": None}}}]}
            pages.append({"page_number": p, "width_pt": 612.0, "height_pt": 792.0, "classification": r.choice([None, {"page_number": p, "classifications": ["scanned"], "confidence": 0.25}]), "text_blocks": [block(r, p, k) for k in range(r.randint(0, 5))], "tables": [table] * r.randint(0, 2), "figures": [{"id": "f", "page": p, "caption": "c"}] * r.randint(0, 1)})
        out.append(({"filename": f"{d}.pdf", "sha256": f"h{d}", "page_count": len(pages)}, sorted(pages, key=lambda p: p["page_number"])))
    return out


def test_documents_survive_taking_apart_storing_and_putting_together(spark, tmp_path):
    docs = spark.createDataFrame(random_documents(), ir.DOCUMENT.replace(", _corrupt_record string", "")).cache()
    assemble.write_pages(assemble.page_rows(docs), f"file://{tmp_path}/pages", buckets=4)
    stored = assemble.read_pages(spark, f"file://{tmp_path}/pages", buckets=4)
    flat = assemble.flatten(stored)
    pages = assemble.assemble_pages(flat["sizes"], flat["classes"], **{n: flat[n] for n in assemble.PARTS})
    about = docs.select(F.col("metadata.sha256").alias("doc"), "metadata")
    got = {r.metadata.sha256: r for r in assemble.documents(pages, about).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        mine = got[d.metadata.sha256]
        assert mine.metadata == d.metadata and mine.provenance.source_document == d.metadata.filename and len(mine.pages) == len(d.pages)
        for a, b in zip(mine.pages, d.pages):
            assert (a.page_number, a.text_blocks, a.tables, a.figures) == (b.page_number, b.text_blocks, b.tables, b.figures)
            assert a.classification == b.classification if b.classification else (a.classification.classifications, a.classification.native_text_available) == (["native_digital_text"], True)
    one = assemble.read_pages(spark, f"file://{tmp_path}/pages", ["h3"], buckets=4)
    assert {r.doc for r in one.collect()} <= {"h3"} and one.count() == len(random_documents()[3][1])
    assert "PartitionFilters: [" in (plan := one._jdf.queryExecution().toString()) and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_pages_without_class_blocks_or_size(spark):
    sizes = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 1.0, 2.0)], "doc string, page int, width_pt double, height_pt double")
    classes = spark.createDataFrame([], f"doc string, page int, classification {ir.CLASSES}")
    flat = spark.createDataFrame([("a", 2, 5, "y", "late"), ("a", 2, 1, "x", "early"), ("a", 9, 1, "z", "no such page"), ("b", 1, 1, "w", "no such document")], "doc string, page int, ord int, block_id string, text string")
    got = assemble.assemble_pages(sizes, classes, text_blocks=flat.select("doc", "page", "ord", assemble.block_item(flat).alias("item"))).orderBy("page_number").collect()
    assert [[b.text_verbatim for b in p.text_blocks] for p in got] == [[], ["early", "late"]]
    assert got[0].classification.classifications == ["native_digital_text"] and got[0].tables == [] and not got[1].text_blocks[0].is_ocr
    empty = assemble.assemble_pages(sizes.limit(0), classes)
    assert empty.count() == 0 and assemble.documents(empty, spark.createDataFrame([], f"doc string, metadata {ir.METADATA}")).count() == 0


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, batch int"


def stream_rows(minutes_of_batch):
    """Batches of (minute, user, type)."""
    rows, n = [], 0
    for k, batch in enumerate(minutes_of_batch):
        for minute, user, kind in batch:
            rows.append((n, T0 + datetime.timedelta(minutes=minute), user, kind, 1.0, k))
            n += 1
    return rows


def test_windows_close_with_the_watermark_and_late_rows_are_kept_apart(spark):
    batches = [[(10, 1, "a"), (70, 1, "a")], [(55, 1, "a"), (200, 1, "a")], [(20, 1, "a"), (150, 1, "a"), (175, 1, "a")], [(400, 1, "a")]]
    rows = spark.createDataFrame(stream_rows(batches), EVENTS)
    # After batch 1 the watermark is 170 minutes: of batch 2 minute 20 lies in a closed window, 150 and 175 in one that ends at 180.
    got = events.run_batches(rows, lambda s: events.tumbling(s, late="30 minutes"), "t").collect()
    assert sorted((int((r.w - T0).total_seconds() // 3600), r.n) for r in got) == [(0, 2), (1, 1), (2, 2), (3, 1)]
    late = events.late_rows(rows, F.date_trunc("hour", "ts") + F.expr("interval 1 hour"), "30 minutes")
    assert sorted(int((r.ts - T0).total_seconds() // 60) for r in late.collect()) == [20]


def test_interval_join_of_streams_equals_the_batch_join_with_bounded_state(spark):
    r = random.Random(6)
    batches = [[(k * 600 + r.randint(-60, 600), r.randint(1, 4), r.choice("ab")) for _ in range(150)] for k in range(5)]
    rows = spark.createDataFrame(stream_rows(batches), EVENTS)
    progress: list = []
    got = events.run_batches(rows, lambda s: events.followed(s.where("event_type = 'a'"), s.where("event_type = 'b'"), "user_id", "30 minutes", "61 minutes"), "j", 5, progress)
    a, b = (rows.where(f"event_type = '{k}'").select("user_id", F.col("event_id").alias(f"{k}_id"), F.col("ts").alias(f"{k}_ts")) for k in "ab")
    want = a.join(b, "user_id").where("b_ts >= a_ts and b_ts <= a_ts + interval 30 minutes").select("user_id", "a_id", "a_ts", "b_id", "b_ts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    state = [sum(s.numRowsTotal for s in p.stateOperators) for p in progress if p.stateOperators]
    assert max(state) < 350 < rows.count() and state[-1] < 150


def test_arrivals_keep_all_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = events.arrivals(e.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got.count() == e.count() and {r.batch for r in got.select("batch").distinct().collect()} == {0, 1, 2, 3}
    assert events.arrivals(e.withColumn("ts", F.col("ts").cast("timestamp")).limit(0)).count() == 0
