"""Structured Streaming over the event table: windows with watermarks, and the journal as a stateful stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.store import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # As a pattern the path may be one file or a folder of part files.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events[.]parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(df: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet table and read it; progress is kept in a checkpoint beside it.

    In complete mode each batch holds the whole result, so the last one is read; in the others all are.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)

    made: list[int] = []

    def put(batch: DataFrame, epoch: int) -> None:
        made.append(epoch)
        batch.write.mode("overwrite").parquet(f"{path}/data/epoch={epoch}")  # the same epoch again replaces itself

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    out = spark.read.schema(df.schema)
    if mode == "complete":
        return out.parquet(f"{path}/data/epoch={max(made)}") if made else spark.createDataFrame([], df.schema)
    return out.option("recursiveFileLookup", True).parquet(f"{path}/data") if made else spark.createDataFrame([], df.schema)


def arrivals(events: DataFrame, batches: int = 4, jitter: int = 7200) -> DataFrame:
    """Events with ``batch``, the part of the time in which each arrives: up to ``jitter`` seconds after it happened, by a rule on its event_id, so that rows come out of order."""
    at = F.unix_seconds("ts") + F.pmod(F.col("event_id") * 7919, F.lit(jitter))
    rows = events.withColumn("_at", at)
    span = rows.agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    return rows.crossJoin(F.broadcast(span)).withColumn("batch", F.expr(f"int({batches} * (_at - _lo) div (_hi - _lo + 1))")).drop("_at", "_lo", "_hi")  # one row of bounds


def _feed(rows: DataFrame, path: str) -> tuple[DataFrame, Callable[[int], None]]:
    """A stream over a folder, and what puts one batch of ``rows`` there."""
    spark = rows.sparkSession
    rows.write.partitionBy("batch").parquet(f"{path}/dealt")
    plain = rows.drop("batch").schema
    dealt = spark.read.schema(StructType([*plain.fields, StructField("batch", IntegerType())])).parquet(f"{path}/dealt")
    dealt.limit(0).drop("batch").write.parquet(f"{path}/feed")
    return spark.readStream.schema(plain).parquet(f"{path}/feed"), lambda k: dealt.where(F.col("batch") == k).drop("batch").write.mode("append").parquet(f"{path}/feed")


def _run(writer, path: str) -> list:
    q = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q.recentProgress


def run_batches(rows: DataFrame, build: Callable[[DataFrame], DataFrame], tag: str, batches: int = 4, progress: list | None = None) -> DataFrame:
    """Feed rows (with ``batch``) to a stream, a batch at a time, and read what it has put out in append mode.

    The stream ends after each batch and goes on from its checkpoint, so watermark and state pass from run to run. ``progress`` gets the progress of all runs.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, tag)
    source, give = _feed(rows, path)
    out = build(source)
    made: list[int] = []

    def put(batch: DataFrame, epoch: int) -> None:
        made.append(epoch)
        batch.write.mode("overwrite").parquet(f"{path}/data/epoch={epoch}")

    for k in range(batches):
        give(k)
        seen = _run(out.writeStream.outputMode("append").foreachBatch(put), path)
        if progress is not None:
            progress += seen
    return spark.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{path}/data") if made else spark.createDataFrame([], out.schema)


def late_rows(rows: DataFrame, end: Column, late: str, tag: str = "late", batches: int = 4) -> DataFrame:
    """The rows of a fed stream that came too late: their ``end`` (of their window, say) is not after the watermark that the batches before have left.

    A batch writes its late rows and its latest time beside each other under its number; the same batch again replaces both.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, tag)
    source, give = _feed(rows, path)
    made: list[int] = []

    def put(batch: DataFrame, epoch: int) -> None:
        before = [f"{path}/marks/epoch={n}" for n in made if n < epoch]
        mark = spark.read.schema("mark timestamp").parquet(*before).agg(F.max("mark")).head()[0] if before else None  # one value a batch
        batch.where(end <= F.lit(mark).cast("timestamp") - F.expr(f"interval {late}")).write.mode("overwrite").parquet(f"{path}/data/epoch={epoch}")
        batch.agg(F.max("ts").cast("timestamp").alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/epoch={epoch}")
        made.append(epoch)

    for k in range(batches):
        give(k)
        _run(source.writeStream.foreachBatch(put), path)
    return spark.read.schema(source.schema).option("recursiveFileLookup", True).parquet(f"{path}/data") if made else spark.createDataFrame([], source.schema)


def followed(left: DataFrame, right: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """Rows of two streams (key, ts, event_id): each left row with the right rows of its key that happen from then until ``within`` later.

    Both sides have a watermark, and the interval tells Spark until when a row can still be matched, so older rows leave the state.
    """
    a = left.withWatermark("ts", late).select(F.col(key).alias("a_key"), F.col("ts").alias("a_ts"), F.col("event_id").alias("a_id"))
    b = right.withWatermark("ts", late).select(F.col(key).alias("b_key"), F.col("ts").alias("b_ts"), F.col("event_id").alias("b_id"))
    near = (F.col("a_key") == F.col("b_key")) & (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"interval {within}"))
    return a.join(b, near).select(F.col("a_key").alias(key), "a_id", "a_ts", "b_id", "b_ts")


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("w"), "event_type", "n", F.round("v", 4).alias("v"))


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size, step))
    return g.agg(F.count("*").alias("n")).select(F.col("window.start").alias("w"), "n")


def sessions(events: DataFrame, gap: str = "1 day", late: str = "0 seconds") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("w_start"), F.col("session_window.end").alias("w_end"), "n")


def _journal(key, frames: Iterator[pd.DataFrame], state):
    """Undo and redo stacks of one session, kept between batches."""
    u, r = json.loads(state.get[0]) if state.exists else ([], [])
    rows = pd.concat(list(frames)).sort_values("seq")
    for seq, action in zip(rows["seq"].tolist(), rows["action"].tolist()):
        if action == "edit":
            u.append(seq)
            r = []
        elif action == "undo" and u:
            r.append(u.pop())
        elif action == "redo" and r:
            u.append(r.pop())
    state.update((json.dumps([u, r]),))
    yield pd.DataFrame({"session": [key[0]], "applied": [",".join(map(str, u))], "undone": [",".join(map(str, r))], "last_seq": [int(rows["seq"].max())]})


def journal(actions: DataFrame) -> DataFrame:
    """State of each session after each batch of actions (session, seq, action)."""
    return actions.select("session", "seq", "action").groupBy("session").applyInPandasWithState(_journal, "session long, applied string, undone string, last_seq long", "stacks string", "update", "NoTimeout")
