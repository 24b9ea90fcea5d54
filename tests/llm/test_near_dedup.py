import random

import pytest

from galley.llm import near_dedup as nd


def words(text):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3, groups=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 80))]
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\n"]).join(text)))
            n += 1
    chain = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(12):  # neighbours are alike, the ends are not
        chain = list(chain)
        chain[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((n, " ".join(chain)))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "Two words"), (n + 4, "two  WORDS"), (n + 5, "one"), (n + 6, rows[0][1].upper()), (n + 7, "É x y z"), (n + 8, "é x y z")]


def check(docs, rows, k, percent):
    want = brute(rows, k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_groups(docs(rows), k, percent).collect()}
    assert got == want
    for r in nd.near_groups(docs(rows), k, percent).collect():
        assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(docs, k, percent):
    check(docs, corpus(), k, percent)


@pytest.mark.parametrize("leaders", [(), (1,)])
def test_blocks_alone_find_all_links(docs, monkeypatch, leaders):
    monkeypatch.setattr(nd, "LEADERS", leaders)
    monkeypatch.setattr(nd, "BLOCK", 4)
    check(docs, corpus(5, 12), 3, 85)


def test_one_large_group_and_long_texts(docs):
    long = " ".join(f"x{i}" for i in range(6000))
    rows = [(i, long + f" y{i}") for i in range(40)] + [(100, "z" * 200_000 + " a b c")]
    got = {r.doc_id: r.component_id for r in nd.near_groups(docs(rows), 3, 85).collect()}
    assert got == dict.fromkeys(range(40), 0) | {100: 100}


def test_empty_null_ids_and_repeated_rows(docs, spark):
    assert nd.near_groups(docs([])).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")]
    got = [(r.doc_id, r.component_id, r.kept) for r in nd.near_groups(docs(rows)).collect()]
    assert sorted(got, key=str) == [(1, 1, True), (1, 1, True), (None, None, True)]


def test_deduplicate_keeps_one_and_all_columns(docs):
    table = docs([(5, "a b c d e f g h i j"), (3, "A b c d e f g h i j"), (7, "other text of its own here")])
    out = nd.deduplicate(table)
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 7]


def test_word_hashes_split_as_the_contract_says():
    for text in ("Abc abc  x\x0by\x1cz q", "a" * 10_000 + " b", " lead", "trail ", "é É"):
        h = nd.word_hashes(text)
        w = words(text)
        assert len(h) == len(w)
        assert len(set(h.tolist())) == len(set(w))


def test_deduplicate_tells_rows_apart(spark):
    text = "a b c d e f g h i j"
    schema = "doc_id long, text string, m map<string,int>, key int, row int, _keep int, component_id int"
    rows = [(1, text, {"x": 1}, 1, 2, 3, 4), (1, text, {"x": 1}, 1, 2, 3, 4), (None, text.upper(), None, 1, 2, 3, 4), (1, "quite other words stand here", None, 1, 2, 3, 4), (None, "", None, 1, 2, 3, 4), (None, None, None, 1, 2, 3, 4)]
    table = spark.createDataFrame(rows, schema)
    out = nd.deduplicate(table)
    assert out.columns == table.columns
    assert sorted((r.doc_id or 0, r.text or "", r.component_id) for r in out.collect()) == [(0, "", 4), (0, "", 4), (1, text, 4), (1, "quite other words stand here", 4)]


def test_patterned_long_words_are_told_apart(spark, docs):
    word = lambda n: "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    for n in (64, 512, 1024, 2048, 4096):
        a = word(n)
        b = a.translate({97: "b", 98: "a"})
        text = f"{a} {b} {a} {a} {b}"
        assert len(set(nd.word_hashes(text).tolist())) == 2
        row = nd.near_groups(docs([(1, text), (2, f"{a} {a} {a}"), (3, f"{b} {b} {b}")]), k=3, percent=85).filter("doc_id = 1").first()
        assert row.n_shingles == 3


def test_buckets_that_share_members_are_one_where_that_is_less(spark):
    """Overlapping buckets of a cloud of texts become one; a chain of buckets with one member in common stays as it is."""
    from pyspark.sql import functions as F

    from galley.llm.common import Scratch

    cloud = [(k, r, 10, r) for k in range(20) for r in range(100) if (r * 7 + k) % 10]
    chain = [(100 + k, 1000 + 600 * k + r, 10, 1000 + 600 * k + r) for k in range(4) for r in range(601)]
    here = spark.createDataFrame(cloud + chain, "key long, rep long, n long, label long")
    mixed = nd._mixed(here, "key")
    rows, left = nd._merged(here, mixed, Scratch(spark, "test"))
    got = {}
    for r in rows.collect():
        got.setdefault(r.key, set()).add(r.rep)
    assert set(range(100)) in got.values()
    assert all(got[100 + k] == {1000 + 600 * k + r for r in range(601)} for k in range(4))
    assert len(got) == 5
    assert {r.key for r in left.collect()} == set(got)
    assert left.filter("n_main + n_rest = 100").count() == 1
    assert rows.groupBy("key").agg(F.count_distinct("rep").alias("n")).join(left, "key").filter("n <> n_main + n_rest").count() == 0


def join_rows(spark, since):
    """Rows that each join has made in the executions of SQL from number ``since`` on, and the number of the next."""
    store = spark._jsparkSession.sharedState().statusStore()
    executions, made = store.executionsList(), []
    numbers = [executions.apply(i).executionId() for i in range(executions.size())]
    for number in (x for x in numbers if x >= since):
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return made, max(numbers, default=-1) + 1


def test_leaders_make_no_more_rows_than_buckets_have_members(docs, spark, monkeypatch):
    """A cloud of texts just under the threshold shares many buckets, and each of them has several leaders."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        text = list(base)
        for at in rng.sample(range(100), 3):
            text[at] = f"v{i} {at}"
        rows.append((i, " ".join(text)))
    members, buckets = [], nd._distinct_buckets
    monkeypatch.setattr(nd, "_distinct_buckets", lambda met, scratch: members.append(met.count()) or buckets(met, scratch))
    _, since = join_rows(spark, 0)
    check(docs, rows, 5, 80)
    made, _ = join_rows(spark, since)
    assert len(made) > 10
    assert max(made) <= max(members)


def test_a_member_takes_the_same_few_of_all_its_leaders(spark):
    """Against every leader of every bucket as a row of its own."""
    rng = random.Random(9)
    members = [(k, r, 10 + r % 5, r % 7) for k in range(12) for r in rng.sample(range(40), 15)]
    table = spark.createDataFrame(members, "key long, rep long, n long, label long")
    leaders = {k: [m for m in members if m[0] == k][:4] for k in range(12)}
    lead = spark.createDataFrame([(k, [m[1:] for m in of]) for k, of in leaders.items()], "key long, leaders array<struct<rep: long, n: long, label: long>>")
    hashes = {r.u: r.h for r in spark.sql("SELECT id AS u, xxhash64(id, 1) AS h FROM range(40)").collect()}
    met = {}
    for k, r, n, label in members:
        met.setdefault(r, set()).update(u for _, u, m, other in leaders[k] if other != label and 100 * min(n, m) >= 80 * max(n, m))
    for few, step in ((1, 0), (4, 1), (None, 2)):
        order = (lambda u: (hashes[u], u)) if step else (lambda u: u)
        want = {(min(u, v), max(u, v)) for v, us in met.items() for u in sorted(us, key=order)[:few]}
        got = [(r.u, r.v) for r in nd._led(table, lead, few, step, 80).collect()]
        assert sorted(got) == sorted(want)
