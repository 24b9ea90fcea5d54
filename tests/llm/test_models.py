import zlib

import pytest

from galley.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def auc(pairs):
    pairs = sorted(pairs)
    up, total, n1 = 0.0, 0, 0
    rank = {}
    for i, (s, _) in enumerate(pairs):
        rank.setdefault(s, []).append(i + 1)
    for s, y in pairs:
        if y:
            up += sum(rank[s]) / len(rank[s])
            n1 += 1
        total += 1
    return (up - n1 * (n1 + 1) / 2) / (n1 * (total - n1))


@pytest.mark.parametrize(("module", "column", "mod", "held"), [(toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)])
def test_held_out_rows_are_told_apart(spark, module, column, mod, held):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = module.query(spark, SF).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    pairs = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert auc(pairs) >= 0.9


def test_restores_hidden_words(spark, docs):
    plain = [(i, "you are an idiot and a stupid moron they said to the silly idiot") for i in range(200)]
    model = toxicity.log_model(toxicity.trigram_counts(docs(plain)))
    restore = toxicity.Restorer(model)
    assert "idiot" in restore("an 1d10t said")
    assert "idiot" in restore("an i d i o t said")
    assert "idiot" in restore("an i.d.i.o.t said")
    assert "stupid" in restore("so stuuuupid said")
    assert restore("you are fine in 2024 and 3 of us") == "you are fine in 2024 and 3 of us"


def labelled(docs, spark, name):
    rows = [(i, f"you idiot {i} moron" if i % 2 else f"a fine day {i} friend") for i in range(80)]
    labels = [(i, i % 2) for i in range(60)] + [(500, 1), (None, 1), (3, None)]
    return docs([*rows, (900, None), (901, ""), (902, "you idiot " * 40_000), (0, "again")]), spark.createDataFrame(labels, f"doc_id long, {name} int")


@pytest.mark.parametrize(("module", "column"), [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows_and_tables(spark, docs, module, column):
    table, labels = labelled(docs, spark, column)
    model = module.fit(table, labels)
    got = module.scores(table, model).collect()
    assert len(got) == 84
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got if r.doc_id >= 900}
    assert by[900] == by[901]
    assert module.scores(table.limit(0), model).collect() == []
    one = module.fit(table, labels.filter(f"{column} = 1"))
    assert {round(r.score, 3) for r in module.scores(table, one).collect()} == {round(next(iter(module.scores(table, one).collect())).score, 3)}
    none = module.fit(table.limit(0), labels.limit(0))
    assert {r.score for r in module.scores(table, none).collect()} == {0.5}


def test_toxic_words_score_high(spark, docs):
    table, labels = labelled(docs, spark, "toxic")
    by = {r.doc_id: r.score for r in toxicity.scores(table, toxicity.fit(table, labels)).collect() if r.doc_id > 60}
    assert min(s for i, s in by.items() if i < 80 and i % 2) > 0.5 > max(s for i, s in by.items() if i < 80 and i % 2 == 0)
    assert by[902] > 0.5


def test_rules_as_columns_equal_rules_in_python(spark, docs):
    import math

    names = ["s_words", "s_digit"]
    model = quality.RuleModel(names, [((0, True, 3.0),), ((0, False, 3.0), (1, True, 0.1))], [1.5, -2.0], 0.25)
    table = docs([(1, "a b c d e"), (2, "1 2"), (3, "a"), (4, None)])
    stats = {r.doc_id: r for r in quality.with_statistics(table, "doc_id").collect()}
    for r in quality.scores(table, model).collect():
        s = stats[r.doc_id]
        z = 0.25 + 1.5 * (s.s_words > 3) - 2.0 * (s.s_words <= 3 and s.s_digit > 0.1)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-12
    assert quality.reject_low(table, model).columns == table.columns


def test_viterbi_takes_the_best_path_of_all():
    import itertools
    import random

    import numpy as np

    rng = random.Random(4)
    model = np.log(np.random.default_rng(4).dirichlet(np.ones(toxicity.SYMBOLS), toxicity.SYMBOLS**2)).ravel().tolist()
    restorer = toxicity.Restorer(model)

    def cost(path):
        a, b, total = 0, 0, 0.0
        for _, symbol, price in [*path, (" ", 0, 0.0)]:
            total += price
            if symbol >= 0:
                total -= model[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + symbol]
                a, b = b, symbol
        return total

    for spaced in (False, True):
        for _ in range(150):
            span = "".join(rng.choice("ab1!0$x4aaa .-" if spaced else "ab1!0$x4aaa") for _ in range(rng.randint(1, 8))) + rng.choice(["", "*"])
            paths = list(itertools.product(*restorer.lattice(span, spaced)))
            best = min(map(cost, paths))
            texts = {"".join(t for t, _, _ in p) for p in paths if cost(p) <= best + 1e-9}
            assert restorer.decode(span, spaced) in texts, span


def test_long_words_take_linear_time():
    import random
    import time

    import numpy as np

    rng = random.Random(1)
    restorer = toxicity.Restorer(np.log(np.random.default_rng(1).random(toxicity.SYMBOLS**3) + 0.01).tolist())
    pick = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    for text in ("iii " + pick("acgt", 300_000), "x y z " + pick("abcdefgh0123456789+/", 300_000), "a" + "*" * 300_000 + "b", "a " * 100_000, "1!" * 50_000 + "a", "é" * 300_000 + "aaa"):
        began = time.perf_counter()
        restorer(text)
        assert time.perf_counter() - began < 20


def test_stars_hide_few_letters_of_a_word():
    import numpy as np

    restorer = toxicity.Restorer(np.zeros(toxicity.SYMBOLS**3).tolist())
    ways = [len(w) for w in restorer.lattice("a**b", False)]
    assert ways == [1, 27, 27, 1]
    assert [len(w) for w in restorer.lattice("a*****b", False)] == [1] * 7


def test_lasso_meets_its_optimality_conditions():
    import numpy as np

    rng = np.random.default_rng(2)
    x = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 1] + 0.3)))).astype(float)
    w, b = quality.lasso(x, y, 0.1, steps=4000)
    centred = x - x.mean(0)
    limit = 0.1 * np.abs(centred.T @ (y - y.mean()) / len(y)).max()
    gradient = centred.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
    assert np.abs(gradient).max() <= limit * 1.01
    assert np.allclose(gradient[w != 0], -limit * np.sign(w[w != 0]), atol=limit * 0.01)
    assert (w == 0).any() and w[0] > 0 > w[1]


def test_splits_are_the_best_of_all():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(20):
        codes, residual = rng.integers(0, 6, (60, 4)), rng.normal(size=60)
        rows = np.sort(rng.choice(60, 50, replace=False))
        f, k = quality._best_split(codes, residual, rows, range(4))
        loss = lambda f, k: sum(len(s) * residual[s].var() for s in (rows[codes[rows, f] <= k], rows[codes[rows, f] > k]))
        ok = [(f2, k2) for f2 in range(4) for k2 in range(6) if 5 <= (codes[rows, f2] <= k2).sum() <= 45]
        assert loss(f, k) <= min(loss(*c) for c in ok) + 1e-9


def test_one_row_of_a_labelled_id_teaches(spark):
    rows = [(1, f"nice words {i}") for i in range(50)] + [(2, "vile words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    # one row of either label: the prior is one half
    assert abs(toxicity.fit(docs, labels, n_features=0).bias) < 1e-6
    assert abs(quality.fit(docs, labels).bias) < 1e-6
