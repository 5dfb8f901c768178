"""Table functions over ordered groups: a state is kept from row to row, so a group's work grows with its rows.

Each takes a table argument with ``PARTITION BY ... ORDER BY``. ``register`` makes them known to SQL; from Python a
function is called with ``df.asTable().partitionBy(...).orderBy(...)``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import lit, udtf
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _like(table: AnalyzeArgument, *columns: str) -> StructType:
    """The named columns of a table argument; a missing one is an error of the query."""
    held = {f.name: f for f in table.dataType.fields}
    out = StructType()
    for c in columns:
        if c not in held:
            raise ValueError(f"the table has no column {c}")
        out = out.add(c, held[c].dataType)
    return out


@udtf
class UndoRedo:
    """Actions (session, seq, action) of a session in order of seq: a row (session, seq, undone, place) for each edit on one of the two stacks after the last action.

    An edit clears what could be redone; undo and redo of nothing do nothing, nor do other actions.
    """

    def __init__(self):
        self.done, self.undone, self.session = [], [], None

    @staticmethod
    def analyze(actions: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_like(actions, "session", "seq").add("undone", BooleanType()).add("place", IntegerType()))

    def eval(self, row):
        self.session = row["session"]
        if row["action"] == "edit":
            self.done.append(row["seq"])
            self.undone.clear()
        elif row["action"] == "undo" and self.done:
            self.undone.append(self.done.pop())
        elif row["action"] == "redo" and self.undone:
            self.done.append(self.undone.pop())

    def terminate(self):
        for undone, stack in ((False, self.done), (True, self.undone)):
            for place, seq in enumerate(stack):
                yield self.session, seq, undone, place


@udtf
class AnchorGroups:
    """Rows (key, ord, value) of a group in order: (key, ord, value, anchor, number). A new number begins where the value is ``tolerance`` or more away from the anchor, the first value of the number."""

    def __init__(self):
        self.anchor, self.number = None, -1

    @staticmethod
    def analyze(rows: AnalyzeArgument, tolerance: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_like(rows, "key", "ord", "value").add("anchor", DoubleType()).add("number", IntegerType()))

    def eval(self, row, tolerance):
        value = row["value"]
        if value is not None and (self.anchor is None or abs(value - self.anchor) >= tolerance):
            self.anchor, self.number = float(value), self.number + 1
        yield row["key"], row["ord"], value, self.anchor if value is not None else None, self.number if value is not None else None


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@udtf
class PackTexts:
    """Texts (doc, ord, text) of a document in order, filled into chunks of at most ``max_tokens``: (doc, chunk, first_ord, last_ord, n_tokens, text).

    Sentences are kept whole; one above the budget is a chunk of its own. A sentence has 1.3 tokens a word, cut to an integer. Null and blank texts are passed over.
    """

    def __init__(self):
        self.doc, self.chunk, self.held, self.size, self.first, self.last = None, 0, [], 0, None, None

    @staticmethod
    def analyze(rows: AnalyzeArgument, max_tokens: AnalyzeArgument) -> AnalyzeResult:
        like = _like(rows, "doc", "ord")
        schema = StructType().add("doc", like["doc"].dataType).add("chunk", IntegerType()).add("first_ord", like["ord"].dataType).add("last_ord", like["ord"].dataType)
        return AnalyzeResult(schema.add("n_tokens", LongType()).add("text", StringType()))

    def _out(self):
        row = (self.doc, self.chunk, self.first, self.last, self.size, " ".join(self.held))
        self.chunk, self.held, self.size = self.chunk + 1, [], 0
        return row

    def eval(self, row, max_tokens):
        self.doc = row["doc"]
        for sentence in _SENTENCE.split(row["text"] or ""):
            n = len(sentence.split()) * 13 // 10
            if not sentence.strip():
                continue
            if self.held and self.size + n > max_tokens:
                yield self._out()
            if not self.held:
                self.first = row["ord"]
            self.held.append(sentence)
            self.size, self.last = self.size + n, row["ord"]

    def terminate(self):
        if self.held:
            yield self._out()


NAMES = {"undo_redo": UndoRedo, "anchor_groups": AnchorGroups, "pack_texts": PackTexts}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL, e.g. ``SELECT * FROM undo_redo(TABLE(actions) PARTITION BY session ORDER BY seq)``."""
    for name, f in NAMES.items():
        spark.udtf.register(name, f)


def undo_redo(actions: DataFrame) -> DataFrame:
    return UndoRedo(actions.select("session", "seq", "action").asTable().partitionBy("session").orderBy("seq"))


def anchor_groups(rows: DataFrame, tolerance: float, *by: str) -> DataFrame:
    """rows: (key, ord, value); ``by`` names what is a group, ``key`` unless told otherwise."""
    return AnchorGroups(rows.asTable().partitionBy(*(by or ("key",))).orderBy("value", "ord"), lit(float(tolerance)))


def pack_texts(rows: DataFrame, max_tokens: int) -> DataFrame:
    return PackTexts(rows.select("doc", "ord", "text").asTable().partitionBy("doc").orderBy("ord"), lit(max_tokens))
