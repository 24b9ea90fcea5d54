import random
import re
from collections import Counter, defaultdict

from galley.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Shares by weight, stopped at three times the size, shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def texts(n, seed=1):
    rng = random.Random(seed)
    sources = ["hot"] * 6 + ["b", "é", None, "tiny"]
    return [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 60))) + rng.choice(["", "\n", "\x1c"]), rng.choice(sources)) for i in range(n)]


def test_targets_sizes_and_takings(docs):
    rows = [*texts(600), (900, None, "b"), (901, "", "b"), (902, " \t", None), (0, "again once more", "hot")]
    got = mixing.copies(docs(rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken = targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r["size"] * r.copies
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(60, 0.05 * target), source


def test_reruns_agree_whatever_the_partitions(docs):
    table = docs(texts(200))
    one = {(r.doc_id, r.copies) for r in mixing.copies(table.repartition(7)).collect()}
    assert one == {(r.doc_id, r.copies) for r in mixing.copies(table.repartition(2)).collect()}


def test_mix_repeats_whole_rows(docs):
    table = docs(texts(120))
    drawn = {r.doc_id: r.copies for r in mixing.copies(table).collect()}
    out = mixing.mix(table)
    assert out.columns == table.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in drawn.items() if v})


def test_mix_draws_null_and_repeated_ids_row_by_row(docs):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{i} {text}", source) for i, text, source in texts(300)]
    rows += [(None, "twin twin", "b")] * 2
    out = mixing.mix(docs(rows)).collect()
    there, got = Counter(rows), Counter((r.doc_id, r.text, r.source) for r in out)
    assert set(got) <= set(there)
    assert all(n <= 3 * there[k] for k, n in got.items())
    drawn = Counter()
    for r in mixing.copies(docs(rows)).collect():
        drawn[r.doc_id, r.source, r["size"]] += r.copies
    assert +drawn == Counter((r.doc_id, r.source, len(WORD.findall(r.text))) for r in out)
    sizes, taken = Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text))
    for r in out:
        taken[r.source] += len(WORD.findall(r.text))
    for source, target in targets(sizes).items():
        assert abs(taken[source] - target) <= max(63, 0.05 * target), source
    again = mixing.mix(docs(rows).repartition(7)).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in again) == got


def test_empty_and_one_row(docs):
    assert mixing.copies(docs([])).collect() == []
    assert mixing.mix(docs([])).collect() == []
    (row,) = mixing.copies(docs([(1, None, None)])).collect()
    assert (row["size"], row.source_size, row.target) == (0, 0, 0.0)


def test_mix_keeps_rows_of_one_id_and_any_columns(spark):
    schema = "doc_id long, text string, source string, m map<string,int>, _row int, _copy int, key int, size int"
    rows = [(1, "alpha one", "s", {"x": 1}, 5, 6, 7, 8), (1, "beta two", "s", None, 5, 6, 7, 8), (2, "gamma three", "s", {"y": 2}, 5, 6, 7, 8)]
    table = spark.createDataFrame(rows, schema)
    out = mixing.mix(table, weights=(1,))
    assert out.columns == table.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted(rows)
