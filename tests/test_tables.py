"""Tables that change together, uploads and deletes by content, item states and their history."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import journal, states
from marlstone.sources import store, tables


@pytest.fixture
def made(spark, tmp_path):
    return tables.Tables(spark, f"file://{tmp_path}/t")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols or df.columns).collect())


def frame(spark, data, schema="document_hash string, n long"):
    return spark.createDataFrame(data, schema)


def test_versions_deletes_and_compaction(spark, made):
    assert made.version() == 0 and made.names() == []
    made.commit(put={"index": frame(spark, [("a", 1), ("b", 2)]), "ir": frame(spark, [("a", 9), (None, 8)])})
    gone = frame(spark, [("a", 0), (None, 0)])
    made.commit(drop={"index": gone, "ir": gone})
    made.commit(put={"index": frame(spark, [("a", 3)])})  # put again after the delete
    assert rows(made.read("index")) == [("a", 3), ("b", 2)] and [r.n for r in made.read("ir").collect()] == [8]
    assert rows(made.read("index", 1)) == [("a", 1), ("b", 2)] and rows(made.removed("index", 2)) == [("a", 1)]
    assert made.compact("index") == 4 and rows(made.read("index")) == [("a", 3), ("b", 2)]
    assert len(made.manifest()["index"]["parts"]) == 1 and not made.manifest()["index"]["deletes"] and rows(made.read("index", 3)) == [("a", 3), ("b", 2)]
    made.vacuum()
    assert rows(made.read("index")) == [("a", 3), ("b", 2)] and made.version() == 4
    with pytest.raises(KeyError):
        made.read("none")
    with pytest.raises(ValueError):
        made.commit(put={"index": frame(spark, [("a", "x")], "document_hash string, n string")})


def test_deletes_and_additions_of_one_commit(spark, made):
    made.commit(put={"index": frame(spark, [("a", 1)])})
    made.commit(put={"index": frame(spark, [("a", 2)])}, drop={"index": frame(spark, [("a", 0)]), "unknown": frame(spark, [("a", 0)])})
    assert rows(made.read("index")) == [("a", 2)]


def test_a_commit_that_breaks_off_changes_nothing(spark, made, monkeypatch):
    made.commit(put={"index": frame(spark, [("a", 1)]), "items": frame(spark, [("a", 5)])})

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(made, "_publish", broken)
        with pytest.raises(OSError):
            tables.delete_documents(made, frame(spark, [("a", 0)]))
    assert made.version() == 1 and rows(made.read("index")) == [("a", 1)] and rows(made.read("items")) == [("a", 5)]
    bad = frame(spark, [("b", 1)]).withColumn("n", F.raise_error(F.lit("in the middle")).cast("long"))
    with pytest.raises(Exception, match="in the middle"):
        made.commit(put={"index": frame(spark, [("b", 2)]), "items": bad})
    assert made.version() == 1 and rows(made.read("index")) == [("a", 1)]


def test_writers_meet(spark, made):
    made.commit(put={"index": frame(spark, [("a", 1)])})
    publish, other = made._publish, tables.Tables(spark, made.root)
    first = []

    def late(version, manifest):
        if not first:
            first.append(other.commit(put={"index": frame(spark, [("b", 2)])}))
        return publish(version, manifest)

    made._publish = late
    assert made.commit(put={"index": frame(spark, [("c", 3)])}) == 3 and first == [2]
    assert rows(made.read("index")) == [("a", 1), ("b", 2), ("c", 3)]
    first.clear()
    with pytest.raises(tables.Conflict):
        made.compact("index")
    assert rows(other.read("index")) == [("a", 1), ("b", 2), ("b", 2), ("c", 3)]


FILES = "path string, filename string, sha256 string, curated boolean"


def test_upload_by_content_and_cascading_delete(spark, tmp_path):
    made = tables.Tables(spark, f"file://{tmp_path}/d", keys={"files": "path"})
    up = lambda data: {r.path: (r.saved_path, r.state) for r in tables.upload(made, spark.createDataFrame(data, FILES)).collect()}
    assert up([("digital/a.pdf", "a.pdf", "A", True)]) == {"digital/a.pdf": ("digital/a.pdf", "saved")}
    got = up([("uploads/b.PDF", "b.PDF", "B", False), ("uploads/c.pdf", "c.pdf", "B", False), ("uploads/a.pdf", "a.pdf", "A", False), ("uploads/x.txt", "x.txt", "X", False), ("uploads/n.pdf", "n.pdf", None, False)])
    assert got == {
        "uploads/b.PDF": ("uploads/b.PDF", "saved"), "uploads/c.pdf": ("uploads/b.PDF", "duplicate"), "uploads/a.pdf": ("digital/a.pdf", "duplicate"),
        "uploads/x.txt": (None, "rejected"), "uploads/n.pdf": (None, "rejected"),
    }
    made.commit(put={"index_a": frame(spark, [("A", 1), ("A", 2), ("B", 3)]), "ir": frame(spark, [("A", 1), ("B", 1)]), "items": frame(spark, [("B", 1)])})
    version, report = tables.delete_documents(made, spark.createDataFrame([("A",), ("Z",)], "h string"))
    assert rows(report) == [("A", "index_a", 2), ("A", "ir", 1)]
    assert rows(made.read("index_a")) == [("B", 3)] and rows(made.read("files"), "path") == [("digital/a.pdf",), ("uploads/b.PDF",)]  # curated files stay
    version, report = tables.delete_documents(made, spark.createDataFrame([("B",)], "h string"))
    assert rows(report) == [("B", "files", 1), ("B", "index_a", 1), ("B", "ir", 1), ("B", "items", 1)]
    assert rows(made.read("files"), "path") == [("digital/a.pdf",)] and made.read("items").isEmpty() and made.read("index_a", version - 1).count() == 1


T0 = datetime.datetime(2024, 1, 1)
UPDATE = "item_id string, seq long, at timestamp, status string, owner string, resolution string, rationale string, by string"


def plain_states(items, updates):
    """The same by a loop over the updates."""
    state = {i: dict(status="open", owner=o, resolution=None, resolved_by=None) for i, o in items}
    history = []
    for i, seq, _, status, owner, resolution, _, by in sorted(updates, key=lambda u: u[1]):
        if i not in state:
            continue
        s = state[i]
        history.append((i, seq, s["status"], status, by))
        s["status"] = status
        s["owner"], s["resolution"] = owner or s["owner"], resolution or s["resolution"]
        if status == "resolved":
            s["resolved_by"] = by
    return sorted((i, *(str(v) for v in s.values())) for i, s in state.items()), sorted(map(str, history))


@pytest.mark.parametrize("seed", [1, 2])
def test_state_equals_a_replay_after_any_writes_and_compactions(spark, tmp_path, seed):
    r = random.Random(seed)
    kept = states.ItemStates(tables.Tables(spark, f"file://{tmp_path}/s", keys={}))
    items = [(f"i{k}", r.choice([None, "ann"])) for k in range(6)]
    kept.add(spark.createDataFrame([(i, "h" + i[1], o) for i, o in items], "item_id string, document_hash string, owner string"))
    done, seq = [], 0
    for _ in range(5):
        new = []
        for _ in range(r.randint(0, 7)):
            seq += 1
            new.append((f"i{r.randint(0, 7)}", seq, T0 + datetime.timedelta(hours=seq), r.choice(["open", "assigned", "resolved", "verified"]), r.choice([None, "", "bob", "cy"]), r.choice([None, "", "5 V", "6 V"]), None, r.choice([None, "eve"])))
        kept.update(spark.createDataFrame(new, UPDATE))
        done += new
        if r.random() < 0.5:
            kept.compact()
        state, history = plain_states(items, done)
        assert sorted((x.item_id, str(x.status), str(x.owner), str(x.resolution), str(x.resolved_by)) for x in kept.state().collect()) == state
        assert sorted(str((x.item_id, x.seq, x.old_value, x.new_value, x.by)) for x in kept.history().collect()) == history
    refused = kept.tables.read("rejected").count()
    assert refused == sum(u[0] in ("i6", "i7") for u in done)
    before = kept.state().count()
    tables.delete_documents(kept.tables, spark.createDataFrame([("h1",)], "h string"))
    assert kept.state().count() == before - 1 and not kept.history().where("item_id = 'i1'").count()
    assert kept.add(spark.createDataFrame([("i2", "h2", "zed"), ("i1", "h1", "new")], "item_id string, document_hash string, owner string")).count() == 1
    assert {(x.item_id, x.status) for x in kept.state().where("item_id = 'i1'").collect()} == {("i1", "open")}


def test_update_of_the_first_of_equal_ids(spark):
    items = spark.createDataFrame([("a", 2, "open", None), ("a", 1, "open", "old"), ("b", 1, "open", None)], "item_id string, ord int, status string, resolution string")
    got = states.update_first(items, spark.createDataFrame([("a", "resolved", ""), ("z", "x", "y")], "item_id string, status string, resolution string"), "ord")
    assert rows(got, "item_id", "ord", "status") == [("a", 1, "resolved"), ("a", 2, "open"), ("b", 1, "open")] and got.where("ord = 1 and item_id = 'a'").head().resolution == "old"


def test_journal_is_saved_in_parts_and_loaded(spark, made):
    acts = [("s", 1, "edit"), ("s", 2, "edit"), ("s", 3, "undo"), ("t", 1, "edit"), ("s", 4, "redo"), ("s", 5, "undo")]
    of = lambda a: spark.createDataFrame(a, "session string, seq long, action string")
    states.save_journal(made, of(acts[:3]))
    states.save_journal(made, of(acts[2:]))  # the third action comes twice
    made.compact("actions")
    got = states.load_journal(made)
    assert rows(got) == sorted(acts) and rows(journal.stacks(got).select("session", F.col("applied").cast("string"))) == [("s", "[1]"), ("t", "[1]")]


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        store.scratch(Cluster, "x")


def test_rows_are_made_once_for_two_tables(spark, tmp_path):
    """What is put and what is set aside come from one pass, also where one of them is empty; vacuum keeps both."""
    from pyspark.sql import functions as F

    from marlstone.sources.tables import Tables

    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "document_hash string, n int").mapInPandas(count, "document_hash string, n int")
    t = Tables(spark, f"file://{tmp_path}/t")
    t.commit(put={"x": rows}, split={"x": (F.col("n") > 0, "x_bad")})
    assert seen.value == 3 and sorted(r.document_hash for r in t.read("x").collect()) == ["a", "c"] and [tuple(r) for r in t.read("x_bad").collect()] == [("b", None)]
    t.commit(put={"x": rows.where("n = 3")}, drop={k: rows.where("n = 3").select("document_hash") for k in ("x", "x_bad")}, split={"x": (F.col("n") > 0, "x_bad")})
    t.vacuum()
    assert sorted(tuple(r) for r in t.read("x").collect()) == [("a", 1), ("c", 3)] and t.read("x_bad").count() == 1
