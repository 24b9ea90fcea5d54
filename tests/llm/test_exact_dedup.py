import hashlib
import random
import re
from collections import defaultdict

from galley.llm import exact_dedup as ed


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[norm(text)].append(i)
    out = []
    for i, text, *_ in rows:
        g = groups[norm(text)]
        out.append((i, min(g), len(g), i == min(g), hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(docs):
    rng = random.Random(2)
    base = ["a b", "a  b", "a\tb", " a b", "A b", "", None, " ", "\n\n", "x" * 5000, "x" * 5000 + " ", "é", "a\x1cb", "a b"]
    rows = [(i, rng.choice(base)) for i in range(300)] + [(1000 + i, f"only {i}") for i in range(50)] + [(7, "a b")]
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ed.exact_groups(docs(rows)).collect())
    assert got == brute(rows)


def test_filters_merge_without_loss(spark):
    import random as r

    rng = r.Random(1)
    for bits, regions in ((64, 6), (40, 8), (12, 6), (6, 6)):
        _merge_without_loss(spark, rng, bits, regions)


def _merge_without_loss(spark, rng, bits, regions):
    top = 2**bits
    values = [rng.randrange(top) for _ in range(500)]
    values = [v - 2**64 if v >= 2**63 else v for v in values]
    rows = [(v,) for v in values for _ in range(rng.randint(1, 4))] + [(5,)] * 3000
    table = spark.createDataFrame(rows, "fp long").repartition(6)
    want = defaultdict(int)
    for (v,) in rows:
        want[v] += 1
    filters = ed.partition_filters(table, bits, regions)
    assert {x.fp: x.n for x in ed.merged_counts(filters, bits, regions, least=1).collect()} == want
    assert {x.fp: x.n for x in ed.merged_counts(filters, bits, regions).collect()} == {k: n for k, n in want.items() if n > 1}


def test_filter_sizes_follow_the_rows():
    assert ed.filter_sizes(0) == ed.filter_sizes(1) == (25, 6)
    assert ed.filter_sizes(10**10) == (58, 16)
    assert ed.filter_sizes(2**50)[0] == 64


def test_equal_fingerprints_are_compared_as_texts(docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ed.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c")]
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in ed.exact_groups(docs(rows)).collect())
    assert got == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]


def test_empty_table_and_deduplicate(docs):
    assert ed.exact_groups(docs([])).collect() == []
    table = docs([(2, "a b"), (1, "a  b"), (3, "c"), (None, "c")])
    out = ed.deduplicate(table)
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_deduplicate_tells_rows_apart(docs, spark):
    rows = [(1, "same"), (1, "same"), (1, "other"), (None, "other"), (None, "alone"), (None, "alone")]
    got = sorted((r.doc_id or 0, r.text) for r in ed.deduplicate(docs(rows)).collect())
    assert got == [(0, "alone"), (1, "other"), (1, "same")]
    odd = spark.createDataFrame([(1, "a", {"x": 1}, 5, 6, 7), (2, "a ", {"x": 2}, 5, 6, 7), (3, "a", None, 5, 6, 7)], "doc_id long, text string, m map<string,int>, key int, row int, _keep int")
    got = sorted(tuple(r) for r in ed.deduplicate(odd).collect())
    assert got == [(1, "a", {"x": 1}, 5, 6, 7), (2, "a ", {"x": 2}, 5, 6, 7)]
    assert ed.deduplicate(odd).columns == odd.columns
