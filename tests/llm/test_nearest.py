import numpy as np

from galley.llm import nearest


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, label string, score double")


def vectors(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)).astype(np.float32)
    return [(i, [float(x) for x in row]) for i, row in enumerate(v * spread)]


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, v in queries:
        s = np.zeros(len(m))
        for j, x in enumerate(np.array(v, np.float32).astype(float)):
            s += m[:, j] * x
        order = [o for o in np.lexsort((ids, -s)) if ids[o] != i][:k]
        out[i] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS_IN_BLOCK", 500)
    monkeypatch.setattr(nearest, "QUERIES_IN_BLOCK", 40)
    rows = vectors(3000, 24, 1)
    queries = [r for r in rows if r[0] % 20 == 0]
    got, want = found(nearest.search(table(spark, rows), table(spark, queries), 20)), brute(rows, queries, 20)
    assert got.keys() == want.keys()
    scores = {q: dict(w) for q, w in brute(rows, queries, 3000).items()}
    hits = 0
    for q, near in got.items():
        assert len(near) == 20
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(scores[q][i] == s for i, s in near)
        hits += len({i for i, _ in near} & {i for i, _ in want[q]})
    assert hits / (20 * len(got)) >= 0.97


def test_copies_tie_by_id_and_lengths_matter(spark):
    rows = vectors(300, 10, 2, 0.1) + [(1000 + i, [1.0] * 10) for i in range(200)] + [(2000, [9.0] * 10)]
    queries = [(1000, [1.0] * 10), (5, rows[5][1])]
    got, want = found(nearest.search(table(spark, rows), table(spark, queries), 20)), brute(rows, queries, 20)
    assert got[1000] == want[1000]
    assert got[1000][0][0] == 2000
    assert [i for i, _ in got[1000][1:]] == list(range(1001, 1020))


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 1.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, []), (7, [1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (8, [3.0, 2.0, 1.0]), (8, [3.0, 2.0, 1.0])]
    got = found(nearest.search(table(spark, rows), table(spark, rows), 20))
    assert got == {0: [(8, 10.0)], 8: [(0, 10.0)]}
    assert nearest.search(table(spark, []), table(spark, [])).collect() == []
    assert nearest.search(table(spark, rows), table(spark, [])).collect() == []
    assert nearest.search(table(spark, rows[:1]), table(spark, rows[:1])).collect() == []


def test_anisotropic_loss_lowers_the_parallel_error():
    v = np.array([r[1] for r in vectors(2000, 16, 3)])
    unit = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    parallel = {}
    for threshold in (0.0, 0.5):
        book = nearest.fit(v, threshold)
        rest = unit - book.decode(book.encode(unit))
        parallel[threshold] = float(((rest * unit).sum(1) ** 2).mean())
    assert parallel[0.5] < parallel[0.0]


def test_later_blocks_return_only_what_reaches_the_bound(spark, monkeypatch):
    """Many small blocks, met in waves, find as much as one block does, with far fewer candidates than k a block."""
    rows = vectors(4000, 12, 5) + [(9000 + i, [2.0] * 12) for i in range(60)]
    queries = rows[:30] + rows[-3:]
    monkeypatch.setattr(nearest, "ROWS_IN_BLOCK", 50)
    monkeypatch.setattr(nearest, "QUERIES_IN_BLOCK", 7)
    got, want = found(nearest.search(table(spark, rows), table(spark, queries), 20)), brute(rows, queries, 20)
    assert all(len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0])) for near in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want)) >= 0.98
    assert all(got[i] == want[i] for i, _ in queries[-3:])  # ties of copies
    book = nearest.fit(np.array([v for _, v in rows], float))
    v, q = np.array([v for _, v in rows], float), np.array([v for _, v in queries], float)
    codes = nearest.packed(book.encode(nearest.padded(nearest._directions(v)).astype(np.float32)))
    ids, asked = np.arange(len(v)), -1 - np.arange(len(q))
    scores = np.sort(q @ v.T, axis=1)[:, -20]
    x, y, score = nearest.scan(book, ids[:500], v[:500], codes[:500], asked, q, 20, scores)
    assert len(x) < 20 * len(q) / 3
    assert (score >= scores[x]).all()
    full = nearest.scan(book, ids[:500], v[:500], codes[:500], asked, q, 20)
    keep = full[2] >= scores[full[0]]
    assert x.tolist() == full[0][keep].tolist() and y.tolist() == full[1][keep].tolist()
