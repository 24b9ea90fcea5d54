import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from galley.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank string, node string, c string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", "z", "w") for i, v, lab in rows], SCHEMA)


def brute(rows, every, positives=5, wanted=3):
    held = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        now = (label, [math.floor(256 * x) for x in v])
        held[i] = min(now, held.get(i, now))
    lengths = [len(c) for _, c in held.values()]
    if not lengths:
        return []
    d = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    held = {i: x for i, x in held.items() if len(x[1]) == d}
    out = []
    for a, (label, c) in held.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(c, o, strict=True)), i, lab) for i, (lab, o) in held.items() if i != a)
        near = [(-s, i) for s, i, lab in scores if lab == label][:positives]
        for p, i in near:
            fits = [(-s, j) for s, j, lab in scores if lab != label and 50 * p <= 100 * -s <= 95 * p][:wanted]
            out += [(a, i, r + 1, j, p, s) for r, (s, j) in enumerate(fits)]
    return sorted(out)


def rows_of(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def clouds(seed, n, d, spread, labels=4):
    """Vectors around some centers, with copies of a third of them."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, d))
    v = centers[rng.integers(0, 6, n)] + rng.normal(size=(n, d)) * spread
    v[rng.random(n) < 0.33] = v[0]
    return [(i, [float(x) for x in row], int(rng.integers(0, labels))) for i, row in enumerate(v)]


@pytest.mark.parametrize(("spread", "d"), [(0.05, 8), (0.5, 5), (3.0, 16)])
def test_equals_brute_force_over_many_chunks_and_waves(spark, monkeypatch, spread, d):
    for name, value in (("ROWS", 40), ("ANCHORS", 16), ("LEAF", 8), ("ANCHOR_LEAF", 4), ("TOGETHER", 2), ("WAVE", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = clouds(int(d), 700, d, spread)
    got = rows_of(negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 9 == 0))
    want = brute(rows, 9)
    assert got == want
    assert want


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (50, [1.0, 0.5], 1), (2, [0.7, 0.7], 2), (3, [0.9, 0.8], 2), (4, None, 2), (5, [1.0, None], 2), (6, [nan, 1.0], 2), (7, [inf, 1.0], 2), (8, [0.8, 0.8], None), (None, [0.8, 0.8], 2), (9, [], 2), (10, [0.8], 2), (2, [0.7, 0.7], 2), (100, [-1.0, -1.0], 1), (11, [0.0, 0.0], 2)]
    got = rows_of(negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0))
    assert got == brute(rows, 50)
    assert got


def test_empty_tables_and_single_rows(spark):
    none = table(spark, [])
    assert rows_of(negatives.hard_negatives(none, F.lit(True))) == []
    one = table(spark, [(0, [1.0], 1)])
    assert rows_of(negatives.hard_negatives(one, F.lit(True))) == []
    assert rows_of(negatives.hard_negatives(one, F.lit(False))) == []
    no_positive = [(0, [1.0], 1), (1, [1.0], 2)]
    assert rows_of(negatives.hard_negatives(table(spark, no_positive), F.lit(True))) == []


def test_ties_and_large_numbers(spark):
    rows = [(i, [1.0, 0.0], i % 2) for i in range(40)] + [(i, [0.8, 0.0], i % 2) for i in range(40, 80)]
    assert rows_of(negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0)) == brute(rows, 10)
    rows = [(i, [1e5 * (i + 1) + 0.3, 1e4 * (i % 7)], i % 3) for i in range(60)]
    assert rows_of(negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0)) == brute(rows, 10)


def test_intervals_hold_all_products():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, y = rng.integers(-300, 300, (20, 6)), rng.integers(-300, 300, (30, 6)) + rng.integers(-200, 200, 6)
        a, c = negatives.Tree(x, 100), negatives.Tree(y, 100)
        low, high = negatives.intervals(a.centers[0], a.radii[0], c.centers[0], c.radii[0])
        products = x @ y.T
        assert low[0] <= products.min() and products.max() <= high[0]


def test_groups_of_anchors_are_pruned(monkeypatch):
    for name, value in (("LEAF", 16), ("ANCHOR_LEAF", 8), ("TOGETHER", 4)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(16, 8)) * 200
    v = np.rint(centers[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 8)) * 4).astype(np.int64)
    order = negatives.tree_order(v, 16)
    rows = {"v": v[order], "ids": np.arange(4000), "labels": np.zeros(4000, int)}
    some = negatives.tree_order(v[:300], 8)
    anchors = {"v": v[:300][some], "ids": 10_000 + np.arange(300), "labels": np.zeros(300, int), "low": np.full((300, 1), -(2**62)), "high": np.full((300, 1), 2**62)}
    seen = []
    x, _, y, got = negatives.meet(anchors, rows, 5, True, seen)
    want = np.sort(anchors["v"] @ rows["v"].T, axis=1)[:, -5:]
    assert all(sorted(got[x == i].tolist()) == want[i].tolist() for i in range(300))
    assert seen[1] < seen[0] / 3


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    result = con.execute(negatives.SQL)
    names = [x[0] for x in result.description]
    df = negatives.query(spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    want = sorted(result.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == want
    assert want
