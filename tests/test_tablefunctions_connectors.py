"""Table functions, paged remote sources and the staged benchmark against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import benchmark, tablefunctions
from marlstone.sources import connectors


def test_undo_redo_in_sql(spark):
    tablefunctions.register(spark)
    acts = [("s", 1, "edit"), ("s", 2, "edit"), ("s", 3, "undo"), ("s", 4, "undo"), ("s", 5, "redo"), ("t", 1, "redo"), ("t", 2, "open"), ("u", 1, "edit"), ("u", 2, "undo"), ("u", 3, "edit")]
    spark.createDataFrame(random.Random(1).sample(acts, len(acts)), "session string, seq long, action string").createOrReplaceTempView("acts_view")
    got = spark.sql("SELECT * FROM undo_redo(TABLE(acts_view) PARTITION BY session ORDER BY seq)").collect()
    assert sorted(tuple(r) for r in got) == [("s", 1, False, 0), ("s", 2, True, 0), ("u", 3, False, 0)]
    with pytest.raises(Exception, match="no column seq"):
        spark.sql("SELECT * FROM undo_redo(TABLE(SELECT session FROM acts_view) PARTITION BY session)").collect()


def test_anchor_groups_equal_a_loop(spark):
    r = random.Random(2)
    rows = [(k, i, r.choice([None, round(r.uniform(0, 60), 1)])) for k in "ab" for i in range(60)]
    got = {(x.key, x.ord): (x.anchor, x.number) for x in tablefunctions.anchor_groups(spark.createDataFrame(rows, "key string, ord int, value double"), 5.0).collect()}
    for k in "ab":
        anchor, n = None, -1
        for _, i, v in sorted((x for x in rows if x[0] == k and x[2] is not None), key=lambda x: (x[2], x[1])):
            if anchor is None or abs(v - anchor) >= 5:
                anchor, n = v, n + 1
            assert got[k, i] == (anchor, n)
    assert all(got[k, i] == (None, None) for k, i, v in rows if v is None) and len(got) == 120


def test_pack_texts_equal_a_loop(spark):
    r = random.Random(3)
    rows = [(d, i, r.choice([None, "", "  ", " ".join(r.choice(["word", "end.", "what?", "x"]) for _ in range(r.randint(1, 40)))])) for d in (1, 2) for i in range(25)]
    got = sorted(tuple(x) for x in tablefunctions.pack_texts(spark.createDataFrame(rows, "doc long, ord int, text string"), 12).collect())
    want = []
    for d in (1, 2):
        chunks, now = [], []
        for _, i, t in [x for x in rows if x[0] == d]:
            for s in [s for s in __import__("re").split(r"(?<=[.!?])\s+", t or "") if s.strip()]:
                n = len(s.split()) * 13 // 10
                if now and sum(x[1] for x in now) + n > 12:
                    chunks.append(now)
                    now = []
                now.append((i, n, s))
        chunks += [now] if now else []
        want += [(d, k, c[0][0], c[-1][0], sum(x[1] for x in c), " ".join(x[2] for x in c)) for k, c in enumerate(chunks)]
    assert got == sorted(want) and len(want) > 20


SPACES = [{"id": str(s), "key": f"K{s}", "name": f"space {s}"} for s in range(5)]
PAGES = [{"id": f"{s}-{p}", "title": f"t{p}", "space_id": str(s), "version": p} for s in range(5) for p in range(7 * s)]


class Flaky(connectors.Client):
    """Every page fails the first times it is asked for in a process; answers are paged by place."""

    def __init__(self, options):
        self.options, self.failed = options, set()

    def page(self, kind, parent, cursor, limit):
        if (kind, parent, cursor) not in self.failed:
            self.failed.add((kind, parent, cursor))
            raise TimeoutError("try again")
        rows = SPACES if kind == "spaces" else [p for p in PAGES if p["space_id"] == parent]
        at = int(cursor or 0)
        return rows[at : at + limit], str(at + limit) if at + limit < len(rows) else None

    def parents(self, kind):
        return [s["id"] for s in SPACES] if kind == "pages" else None


def never(options):
    class Down(Flaky):
        def page(self, *_):
            raise OSError("down")

    return Down(options)


def test_pages_are_read_by_space_with_cursors_and_retries(spark):
    connectors.register(spark)
    name = "tests.test_tablefunctions_connectors:Flaky"
    got = spark.read.format("remote_listing").options(kind="pages", client=name, limit="3", wait="0").load()
    assert sorted(r.id for r in got.collect()) == sorted(p["id"] for p in PAGES) and got.rdd.getNumPartitions() == 5
    assert spark.read.format("remote_listing").options(kind="pages", client=name, wait="0", partitions="2").load().rdd.getNumPartitions() == 2
    assert [r.key for r in spark.read.format("remote_listing").options(kind="spaces", client=name, limit="2", wait="0").load().orderBy("id").collect()] == [s["key"] for s in SPACES]
    one = got.where("space_id = '3' and version > 4")
    assert sorted(r.id for r in one.collect()) == sorted(f"3-{p}" for p in range(5, 21))
    with pytest.raises(Exception, match="down"):
        spark.read.format("remote_listing").options(kind="pages", client="tests.test_tablefunctions_connectors:never", wait="0", tries="2").load().collect()


def test_filters_choose_partitions():
    reader = connectors._Reader({"kind": "pages", "client": "tests.test_tablefunctions_connectors:Flaky", "wait": "0"})
    kept = list(reader.pushFilters([connectors.EqualTo(("space_id",), "3"), connectors.EqualTo(("title",), "x")]))
    assert len(kept) == 2 and [p.parents for p in reader.partitions()] == [["3"]]
    reader = connectors._Reader({"kind": "pages", "client": "tests.test_tablefunctions_connectors:Flaky", "wait": "0"})
    list(reader.pushFilters([connectors.In(("space_id",), ("1", "4", "9"))]))
    assert [p.parents for p in reader.partitions()] == [["1"], ["4"]]


def test_folders_of_lines_by_parent(spark, tmp_path):
    spark.createDataFrame([(p["id"], p["title"], p["space_id"], p["space_id"]) for p in PAGES], "id string, title string, space_id string, parent string").repartition(3).write.partitionBy("parent").json(f"{tmp_path}/pages")
    (tmp_path / "spaces.json").write_text(json.dumps({"results": SPACES}))
    connectors.register(spark)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = spark.read.format("remote_listing").options(kind="pages", path=path, limit="2").load()
        assert sorted(r.id for r in got.collect()) == sorted(p["id"] for p in PAGES)
    assert spark.read.format("remote_listing").options(kind="spaces", path=str(tmp_path)).load().count() == 5
    assert list(connectors.FolderClient(str(tmp_path)).list("drives")) == []


def plain_stages(models, outcomes, subset, baseline, cap):
    spent, rows = 0.0, {}
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
    for m, _, valid, cost in models:
        if spent >= cap:
            break
        rows[m] = [1, None, None, cost]
        spent += cost
    for stage, wanted in ((2, subset), (3, None)):
        for m, _, valid, _ in models:
            if m not in rows or not valid or rows[m][0] != stage - 1 or (stage == 3 and rows[m][1] < baseline * 0.9):
                continue
            if spent >= cap:
                break
            asked = [o for o in outcomes if o[0] == m and (wanted is None or o[1] in wanted)]
            spent += sum(o[6] for o in asked)
            rows[m] = [stage, mean([o[3] for o in asked]), len(asked), rows[m][3] + sum(o[6] for o in asked)]
    return rows


@pytest.mark.parametrize("cap", [0.0, 0.35, 4.0, 9.0, 1000.0])
def test_staged_benchmark_equals_a_loop(spark, cap):
    r = random.Random(4)
    models = [(f"m{k}", k, r.choice([True, True, False, None]), 0.1) for k in range(12)]
    outcomes = [(m, q, "abc"[q % 3], r.random() * (1 + k % 3) / 2, r.random(), r.random() > 0.5, 0.05) for k, (m, *_) in enumerate(models) for q in range(30) if m != "m3"]
    o = spark.createDataFrame(outcomes, "model_id string, query_id int, stratum string, recall double, reciprocal_rank double, hit boolean, cost double")
    subset = {x.query_id for x in benchmark.subset(o, 4).collect()}
    assert len(subset) == 12 and {q % 3 for q in subset} == {0, 1, 2}
    got = {x.model_id: (x.stage_reached, x.recall, x.n_queries, x.cost) for x in benchmark.staged(spark.createDataFrame(models, "model_id string, ord int, valid boolean, filter_cost double"), o, 0.5, cap, 4).collect()}
    want = plain_stages(models, outcomes, subset, 0.5, cap)
    assert set(got) == set(want)
    for m, (stage, recall, n, cost) in want.items():
        assert got[m][0] == stage and got[m][2] == n and got[m][3] == pytest.approx(cost) and (recall is None) == (got[m][1] is None) and (recall is None or got[m][1] == pytest.approx(recall))
