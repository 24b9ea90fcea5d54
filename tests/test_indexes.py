"""Indexes that stand in for products: near lines, titles far from their page, keywords inside words."""

import random

import pytest
from pyspark.sql import functions as F

from galley.operators import listings, toc, velocity
from galley.session import settled


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text) + 1)
        kind = rng.randrange(3)
        text = text[:at] + ("" if kind == 0 else rng.choice("abcxyz(_")) + text[at + (kind != 1) :]
    return text


def line(rng, n):
    return "".join(rng.choice("abcdefgh_=().") for _ in range(n))


@pytest.mark.parametrize("least", [0.9, 0.8, 0.6])
def test_no_near_line_is_missed(spark, least):
    rng = random.Random(int(least * 10))
    source = [("p", i, line(rng, rng.randint(1, 60))) for i in range(150)] + [("q", i, line(rng, rng.randint(5, 40))) for i in range(30)]
    asked = []
    for k in range(150):
        path, _, text = rng.choice(source)
        asked.append(("b", k, path, mutated(rng, text, rng.randrange(1, 2 + int((1 - least) * len(text))))))
    asked += [("c", 0, "p", ""), ("c", 1, "none", "abcdefghijkl"), ("c", 2, "q", "zzzz" * 40)]
    want = {}
    for b, k, path, text in asked:
        found = []
        for p, i, there in source:
            longest = max(len(text), len(there))
            d = edits(text, there) if p == path else None
            if d is not None and 0 < d <= int(longest * (1 - least) + 1e-9):
                found.append((-(1 - d / longest), i))
        if found:
            want[b, k] = min(found)[1]
    a = spark.createDataFrame(asked, "block_id string, number int, path string, spaced string")
    s = spark.createDataFrame(source, "path string, source_number int, spaced string")
    equal = {(b, k) for b, k, path, text in asked if any(p == path and there == text for p, _, there in source)}
    got = {(r.block_id, r.number): r.near for r in listings.near_lines(a, s, least).collect() if (r.block_id, r.number) not in equal}
    assert got == {k: v for k, v in want.items() if k not in equal}
    assert len(got) > 50


def test_pairs_grow_with_the_lines_of_a_file(spark):
    """A file of 100,000 lines: no more pairs are scored than some for each line that is looked for."""
    s = spark.range(100_000).select(F.lit("p").alias("path"), F.col("id").cast("int").alias("source_number"), F.concat(F.lit("v = "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 44)).alias("spaced"))
    a = s.filter("source_number % 500 = 0").select(F.lit("b").alias("block_id"), F.col("source_number").alias("number"), "path", F.concat("spaced", F.lit(";")).alias("spaced"))
    a, s = settled(a), settled(s)
    pairs = listings.near_candidates(a, s)
    assert pairs.count() <= 4 * a.count()
    near = listings.near_lines(a, s)
    assert near.filter("near = number").count() == near.count() == 200
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_titles_are_found_on_any_page(spark):
    rng = random.Random(8)
    words = ["ab", "cab", "rod", "gear", "be", "bear", "a", "가나", "나다라", "x1", "zz", "rare", "long", "longer"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pages = [(d, i, text(rng.randrange(0, 12))) for d in range(6) for i in range(25)]
    titles = [(d, e, text(rng.randint(1, 6))) for d in range(7) for e in range(30)] + [(0, 99, ""), (0, 98, "ab ab ab zz"), (1, 97, "a b"), (1, 96, "q"), (2, 95, "nothing of this")]
    p = spark.createDataFrame(pages, "doc_id int, at int, norm string")
    e = spark.createDataFrame(titles, "doc_id int, entry int, want string")
    want = {tuple(r) for r in e.join(p, "doc_id").filter(toc.found_in(F.col("want"), F.col("norm"))).select("doc_id", "entry", "at").collect()}
    got = [tuple(r) for r in toc.found_anywhere(e, p).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    assert want
    assert toc.found_anywhere(e.limit(0), p).collect() == toc.found_anywhere(e, p.limit(0)).collect() == []


def test_contents_meet_no_product(spark):
    pages = spark.createDataFrame([("d", i, i, f"page {i} of many words number{i}") for i in range(1, 40)], "doc_id string, page int, printed int, text string")
    entries = spark.createDataFrame([("d", 1, "number39", 1, 2), ("d", 2, "of many words", 1, 30), ("d", 3, "not there at all", 1, 5)], "doc_id string, entry int, title string, level int, page int")
    out = toc.compare(entries, pages)
    got = {r.entry: (r.body_page, r.status) for r in out.collect()}
    assert got == {1: (39, "page-mismatch"), 2: (30, "match"), 3: (None, "missing")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keywords_inside_long_words(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdef") for _ in range(100_000))
    books = [(long, 1), ("blueprint rods", 2), ("Rod", 3), ("한글입문 책", 4), ("arod", 5), ("none", 6)]
    cards = [("a", "rod blue"), ("b", "글입"), ("c", long[50_000:50_009]), ("d", "q"), ("e", None)]
    c = spark.createDataFrame(cards, "path string, keyword string")
    b = spark.createDataFrame(books, "title string, rank int")
    got = {}
    for r in velocity.competing_books(c, b).collect():
        got.setdefault(r.path, []).append((r.place, r.title))
    brute = {}
    for path, keyword in cards:
        parts = [w for w in (keyword or "").lower().split() if len(w) >= 2]
        hits = [t for t, rank in sorted(books, key=lambda x: (x[1], x[0])) if any(w in token for w in parts for token in t.lower().split() if len(token) >= 2)][:3]
        if hits:
            brute[path] = list(enumerate(hits, 1))
    assert {k: sorted(v) for k, v in got.items()} == brute
    assert velocity.competing_books(c.limit(0), b).collect() == []


def test_places_over_a_whole_table(spark):
    from galley.operators import ordinals

    rng = random.Random(2)
    rows = [(i, rng.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, x int").repartition(7)
    out = ordinals.ranked(df, F.desc("x"), F.col("id"))
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r.id: r["rank"] for r in out.collect()} == want
    assert ordinals.ranked(df.limit(0), F.col("id")).collect() == []
    assert ordinals.numbered(df.filter("id = 5").orderBy("id")).collect()[0].n == 1
    few = ordinals.numbered(spark.range(10_000).orderBy(F.col("id") % 97, "id"))
    assert few.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, 10_000, 10_000)
