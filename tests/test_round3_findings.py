"""Small cases of the third round's findings that gave wrong results before."""

import datetime
import os

import duckdb
import pandas as pd

from marlstone.operators import benchmark
from marlstone.plans.registry import ORACLES, QUERIES


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as pandas frames."""
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t, pdf in tables.items():
        path = os.path.join(str(folder), f"{t}.parquet")
        c.register("frame", pdf)
        c.execute(f"COPY frame TO '{path}' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    want = c.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, str(folder))
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted((tuple(r) for r in df[sorted(df.columns)].astype(object).to_numpy().tolist()), key=repr)
    return rows(got.toPandas()), rows(want)


def test_recall_at_the_bound_reaches_the_last_stage(spark):
    """The mean of these is 0.45, but less when they are summed as doubles, in whatever order."""
    recalls = [0.45] * 21
    outcomes = spark.createDataFrame([("m", i, 0, r, 0.5, True, 0.125) for i, r in enumerate(recalls)], "model_id string, query_id int, stratum int, recall double, reciprocal_rank double, hit boolean, cost double").coalesce(1)
    models = spark.createDataFrame([("m", 1, True, 0.5)], "model_id string, ord int, valid boolean, filter_cost double")
    r = benchmark.staged(models, outcomes, 0.5, 1e12, 2**31 - 1).first()
    assert (r.stage_reached, round(r.recall, 9), r.n_queries) == (3, 0.45, len(recalls))


def test_gaps_are_measured_below_a_second(spark, tmp_path):
    """A step of 23:59:59.2 is less than a day, though a day by whole seconds."""
    at = lambda *x: datetime.datetime(2024, 1, *x)
    rows = [(1, 1, at(1, 0, 0, 0, 900_000)), (2, 1, at(2, 0, 0, 0, 100_000)), (3, 1, at(3, 0, 0, 0, 100_000)), (4, 2, at(1, 0, 0, 0, 100_000)), (5, 2, at(1, 23, 59, 59, 900_000))]
    events = pd.DataFrame(rows, columns=["event_id", "user_id", "ts"])
    events["ts"] = events["ts"].astype("datetime64[us]")
    got, want = against_sql(spark, tmp_path, "gap_sessions", events=events)
    assert got == want and [r[0] for r in sorted(got, key=lambda r: r[1])] == [0, 0, 1, 0, 0]


def test_briefing_with_part_numbers_of_six_digits(spark, tmp_path):
    """The SQL's first block is that of the smallest page * 100000 + ord: here one of page 2, which has a revision, before one of page 1."""
    part = pd.DataFrame([(51, "hot ring", "LARGE", 4), (200_000, "blue bolt", "SMALL", 3)], columns=["p_partkey", "p_name", "p_type", "p_size"])
    lineitem = pd.DataFrame([(0, 51, "A"), (0, 200_000, "A")], columns=["l_suppkey", "l_partkey", "l_returnflag"])
    got, want = against_sql(spark, tmp_path, "briefing", part=part, lineitem=lineitem, supplier=pd.DataFrame({"s_suppkey": [0]}))
    assert got == want and len(got) == 1 and "E" in got[0]
