"""Open items as state: an append-only log of updates, merged with a snapshot when read, and the history of each item.

Tables (``sources.tables``): ``items`` (the snapshot, a row an item), ``updates`` (what came since), ``history``
(changes up to the snapshot), ``rejected`` (updates of unknown items), ``correlations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Tables

ITEMS = "item_id string, document_hash string, status string, owner string, resolution string, rationale string, resolved_at timestamp, resolved_by string, modified_at timestamp"
UPDATES = "item_id string, document_hash string, seq long, at timestamp, status string, owner string, resolution string, rationale string, by string"
_COLUMNS = [c.split()[0] for c in ITEMS.split(", ")]
HISTORY = "item_id string, document_hash string, seq long, at timestamp, field string, old_value string, new_value string, by string"


def _given(column: str):
    """A value counts as given if it is neither null nor empty."""
    return F.nullif(F.col(column), F.lit(""))


def replay(items: DataFrame, updates: DataFrame) -> DataFrame:
    """Items after updates in order of seq: the status is the last one; owner, resolution and rationale the last that were given; time and person of the last resolution stay.

    Updates of one item and seq are in no order; the greater status counts as later. Items without updates stay as they are.
    """
    order = F.struct("seq", "status")
    last = lambda c: F.max_by(_given(c), F.when(_given(c).isNotNull(), order))
    resolved = F.when(F.col("status") == "resolved", order)
    g = updates.groupBy("item_id").agg(
        F.max_by("status", order).alias("s"), last("owner").alias("o"), last("resolution").alias("r"), last("rationale").alias("w"), F.max_by("at", order).alias("m"),
        F.max_by(F.struct("at", "by"), resolved).alias("d"),
    )
    rows = items.join(g.withColumnRenamed("item_id", "_i"), F.col("item_id") == F.col("_i"), "left")
    return rows.select(
        "item_id", "document_hash", F.coalesce("s", "status").alias("status"), F.coalesce("o", "owner").alias("owner"), F.coalesce("r", "resolution").alias("resolution"), F.coalesce("w", "rationale").alias("rationale"),
        F.when(F.col("d").isNotNull(), F.col("d.at")).otherwise(F.col("resolved_at")).alias("resolved_at"), F.when(F.col("d").isNotNull(), F.col("d.by")).otherwise(F.col("resolved_by")).alias("resolved_by"),
        F.coalesce("m", "modified_at").alias("modified_at"),
    )


def changes(items: DataFrame, updates: DataFrame) -> DataFrame:
    """(item_id, document_hash, seq, at, field, old_value, new_value, by): a row for each update, with the status before it."""
    w = Window.partitionBy("item_id").orderBy("seq", "status")
    rows = updates.join(items.select("item_id", F.col("status").alias("_before")), "item_id")
    return rows.select("item_id", "document_hash", "seq", "at", F.lit("status").alias("field"), F.coalesce(F.lag("status").over(w), "_before").alias("old_value"), F.col("status").alias("new_value"), "by")


class ItemStates:
    """The items of all documents with their history, kept over sessions.

    Every write is a version of ``tables``; a document's items, updates and history go when its document_hash is deleted.
    """

    def __init__(self, tables: Tables):
        self.tables = tables
        if "items" not in tables.names():
            empty = lambda s: tables.spark.createDataFrame([], s)
            tables.commit(put={"items": empty(ITEMS), "updates": empty(UPDATES), "rejected": empty(UPDATES), "history": empty(HISTORY)})

    def add(self, items: DataFrame) -> DataFrame:
        """Take items whose item_id is not there yet, one of each id; a status that is null is open. Gives those that were refused."""
        known = self.tables.read("items").select("item_id")
        shaped = items.select([(F.col(c) if c in items.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in ITEMS.split(", "))]).withColumn("status", F.coalesce("status", F.lit("open")))
        nth = F.row_number().over(Window.partitionBy("item_id").orderBy(*_COLUMNS[1:]))
        once = shaped.where("item_id is not null").withColumn("_nth", nth).where("_nth = 1").drop("_nth")
        at = self.tables.version()
        self.tables.commit(put={"items": once.join(known, "item_id", "left_anti").select(*_COLUMNS)}, base=at)
        return shaped.where("item_id is not null").join(known, "item_id", "left_semi")

    def update(self, updates: DataFrame) -> int:
        """Append updates (item_id, seq, at, status, owner, resolution, rationale, by); those of unknown items are kept apart."""
        known = self.tables.read("items").select(F.col("item_id").alias("_i"), F.col("document_hash").alias("_h"))
        rows = updates.join(known, F.col("item_id") == F.col("_i"), "left")
        cols = [(F.col("_h") if c == "document_hash" else F.col(c)).cast(t).alias(c) for c, t in (x.split() for x in UPDATES.split(", "))]
        return self.tables.commit(put={"updates": rows.where("_i is not null").select(*cols), "rejected": rows.where("_i is null").select(*cols)}, base=self.tables.version())

    def state(self, version: int | None = None) -> DataFrame:
        return replay(self.tables.read("items", version), self.tables.read("updates", version))

    def history(self, version: int | None = None) -> DataFrame:
        read = lambda n: self.tables.read(n, version)
        return read("history").unionByName(changes(read("items"), read("updates")))

    def compact(self) -> int:
        """Make the state the snapshot, move the changes of the log to the history and empty the log, in one version."""
        at = self.tables.version()
        log = self.tables.read("updates", at)
        return self.tables.commit(replace={"items": self.state(at), "history": self.history(at), "updates": log.limit(0)}, base=at)

    def save_correlations(self, pairs: DataFrame) -> int:
        return self.tables.commit(replace={"correlations": pairs})


def update_first(items: DataFrame, updates: DataFrame, *order: str) -> DataFrame:
    """Items with the status (and resolution, if given) of updates (item_id, status, resolution): of items with one id only the first in ``order`` changes."""
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    u = updates.select(F.col("item_id").alias("_i"), F.col("status").alias("_s"), F.col("resolution").alias("_r"))
    rows = items.withColumn("_nth", nth).join(u, (F.col("item_id") == F.col("_i")) & (F.col("_nth") == 1), "left")
    return rows.withColumn("status", F.coalesce("_s", "status")).withColumn("resolution", F.coalesce(F.nullif("_r", F.lit("")), "resolution")).drop("_nth", "_i", "_s", "_r")


def save_journal(tables: Tables, actions: DataFrame) -> int:
    """Append actions (session, seq, ...) to the table ``actions``; an action that is there already (session and seq) is not added again."""
    at = tables.version()
    if "actions" in tables.names(at):
        actions = actions.join(tables.read("actions", at).select("session", "seq"), ["session", "seq"], "left_anti")
    return tables.commit(put={"actions": actions}, base=at)


def load_journal(tables: Tables, version: int | None = None) -> DataFrame:
    return tables.read("actions", version)
