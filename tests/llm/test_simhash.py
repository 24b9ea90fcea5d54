import random
import re

import numpy as np
import pytest
import xxhash

from galley.llm import simhash
from galley.llm.common import Scratch
from galley.session import table


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints, radius=3):
    """Root of each distinct fingerprint over all pairs."""
    prints = sorted(prints)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fp = np.array(prints, np.uint64)
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius):
            a, b = find(prints[i]), find(prints[i + 1 + int(j)])
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def brute(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    root = components_of({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in prints), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(900)
    texts = ["", None, " \n ", "one", "One", "one two", "a b c", "A\tb\nc", "é ü", "x" * 5000]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 400))]
        for _ in range(rng.randint(2, 12)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(rng.randint(3, 50))) for _ in range(150)]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(5, texts[9]), (5, texts[9]), (None, texts[20]), (None, "only here, without an id at all")]


def test_groups_equal_brute_force(spark, docs):
    rows = corpus()
    got = rows_of(simhash.near_groups(docs(rows)))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len({p for _, p, _ in got})


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert rows_of(simhash.query(spark, sf_dir)) == brute(rows)


def test_no_rows_and_no_links(docs):
    assert simhash.near_groups(docs([])).collect() == []
    assert rows_of(simhash.near_groups(docs([(7, "a b c d")]))) == brute([(7, "a b c d")])
    assert rows_of(simhash.near_groups(docs([(7, "a b c d"), (8, "e f g")]))) == brute([(7, "a b c d"), (8, "e f g")])


@pytest.mark.parametrize("part", [1, 50, 1 << 20])
def test_long_texts_in_parts(part, monkeypatch):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(part)
    for n in (0, 1, 2, 3, 4, 500):
        text = rng.choice(" \n").join("W%d" % rng.randrange(50) for _ in range(n))
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def cloud(seed, n, bits):
    """Fingerprints that differ from one in some of few bits, others spread evenly, and chains."""
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    places = rng.sample(range(64), bits)
    made = {centre}
    while len(made) < n:
        x = centre
        for b in rng.sample(places, rng.randrange(bits)):
            x ^= 1 << b
        made.add(x)
    made |= {rng.getrandbits(64) for _ in range(n // 2)}
    x = rng.getrandbits(64)
    for _ in range(20):
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
        made.add(x)
    return made | {0, 1, 2**64 - 1, 2**63, 7, 0b111000}


@pytest.mark.parametrize(("bits", "size"), [(10, 8), (24, 8), (40, 40), (16, 4096)])
def test_large_buckets_equal_brute_force(spark, bits, size):
    made = cloud(bits + size, 300, bits)
    signed = [x - 2**64 if x >= 2**63 else x for x in made]
    classes = spark.createDataFrame([(x,) for x in signed], "fp long")
    labels = simhash.linked(classes, Scratch(spark, "test"), size=size)
    got = {x: x for x in made}
    for r in labels.collect():
        got[r.node % 2**64] = r.label % 2**64
    groups = lambda root: sorted(sorted(x for x in root if root[x] == r) for r in set(root.values()))
    assert groups(got) == groups(components_of(made))


def test_no_pair_within_the_radius_is_discarded_and_far_ones_are():
    rng = np.random.default_rng(2)
    fp = np.array(sorted(cloud(3, 400, 20)), np.uint64)
    group = rng.integers(0, 3, len(fp))
    i, j, left = simhash.close_pairs(fp, group, simhash.pivots())
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= 3}
    assert got == want
    even = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    _, _, left = simhash.close_pairs(even, np.zeros(2000, int), simhash.pivots())
    assert left[1] < left[0] / 1000  # the table discards nearly all that a window meets


def test_every_pair_within_the_radius_meets_under_a_mask():
    rng = random.Random(1)
    masks = [m % 2**64 for m in simhash.band_masks(3)]
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(4)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)
    for m in simhash.window_masks(3):
        assert (~m % 2**64).bit_count() <= 3
