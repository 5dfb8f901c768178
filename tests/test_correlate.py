"""Similar items of different documents against all pairs."""

import numpy as np
import pytest

from marlstone.operators import items

SCHEMA = "item_id long, doc string, embedding array<double>, resolution string"


def plain(rows, least):
    out = {}
    for a, da, x, ra in rows:
        for b, db, y, rb in rows:
            if a < b and da != db and x is not None and y is not None and any(x) and any(y):
                s = float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
                if s > least:
                    out[a, b] = (round(s, 9), bool(ra) and bool(rb) and ra != rb)
    return out


@pytest.mark.parametrize("block,pivots", [(512, 256), (9, 5), (4, 1), (20, 40)])
def test_pairs_equal_all_pairs(spark, block, pivots):
    r = np.random.default_rng(block)
    centres = r.normal(size=(8, 6))
    rows = [(i, f"d{r.integers(0, 5)}", (centres[r.integers(0, 8)] + 0.2 * r.normal(size=6)).tolist(), [None, "", "5 V", "6 V"][r.integers(0, 4)]) for i in range(160)]
    rows += [(i, f"d{i % 3}", [1.0, 2.0, 0.0, 0.0, 0.0, 1.0], None) for i in range(160, 200)] + [(200, "x", [0.0] * 6, None), (201, "y", None, None)]
    got = {(x.item_a, x.item_b): (round(x.similarity, 9), x.conflict) for x in items.correlate(spark.createDataFrame(rows, SCHEMA), 0.8, 0.9, block, pivots).collect()}
    want = plain(rows, 0.8)
    assert set(got) == set(want) and len(want) > 300
    assert all(abs(got[k][0] - want[k][0]) < 1e-8 and got[k][1] == want[k][1] for k in want)


def test_far_cells_are_not_visited_and_empty_input(spark, tmp_path, monkeypatch):
    from marlstone.sources import store

    made = []
    monkeypatch.setattr(store, "scratch", lambda s, tag, f=store.scratch: made.append(f(s, tag)) or made[-1])
    r = np.random.default_rng(1)
    rows = [(i, f"d{i % 7}", (np.eye(10)[i % 10] + 0.01 * r.normal(size=10)).tolist(), None) for i in range(400)]
    assert items.correlate(spark.createDataFrame(rows, SCHEMA), 0.75, 0.85, 64, 32).count() == len(plain(rows, 0.75))
    asks = spark.read.parquet(made[1]).count()
    assert asks < 400 * 6  # of 32 cells
    assert items.correlate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_cells_share_blocks(spark, monkeypatch):
    """Small cells share blocks, so what asks does not grow with the number of cells; items without a document have no pairs."""
    r = np.random.default_rng(3)
    centres = np.vstack([np.eye(6), np.eye(6)])
    first, parts = items._blocks(centres, [3] * 6 + [50] + [3] * 5, 20)
    assert parts == [1] * 6 + [3] + [1] * 5 and len(set(first)) <= 6
    rows = [(i, f"d{i % 4}" if i % 9 else None, r.normal(size=6).tolist(), None) for i in range(300)]
    made = []
    from marlstone.sources import store

    monkeypatch.setattr(store, "scratch", lambda s, tag, f=store.scratch: made.append(f(s, tag)) or made[-1])
    got = items.correlate(spark.createDataFrame(rows, SCHEMA), 0.3, 0.9, 60, 64)
    assert {(x.item_a, x.item_b) for x in got.collect()} == set(plain([x for x in rows if x[1]], 0.3))
    assert spark.read.parquet(made[1]).count() <= 300 * 6


def test_only_resolved_items_are_looked_at_for_conflicts(spark, sf_dir, monkeypatch):
    from marlstone.plans import checks

    seen = []
    monkeypatch.setattr(items, "correlate", lambda v, *a, f=items.correlate: seen.append(v) or f(v, *a))
    checks.similarity_conflicts(spark, sf_dir)
    assert seen[0].count() > 0 and seen[0].where("coalesce(resolution, '') = ''").count() == 0
