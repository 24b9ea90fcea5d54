import random
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from galley.llm import packing, tokens

LIBRARY = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))


def check(rows, pieces, most=2048, segments=256):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, text in rows:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted(by_doc.pop(doc), key=lambda p: p.start)
        assert {p.doc_tokens for p in mine} == {len(ids)}
        at, packed = 0, b""
        for p in mine:
            assert p.start == at
            assert p.length > 0 and len(p.ids) == 4 * p.length
            at, packed = at + p.length, packed + bytes(p.ids)
        assert packed == b"".join(i.to_bytes(4, "little") for i in ids)
    assert not by_doc
    padding = total = 0
    for inside in by_sequence.values():
        at = 0
        for p in sorted(inside, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= most and len(inside) <= segments
        total += at
        padding += 0 if at & (at - 1) == 0 else most - at
    assert padding <= 0.01 * total + 1


def test_invariants(docs):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["word", "é", "x1", "한글"]) for _ in range(rng.choice([0, 1, 5, 80, 500, 3000])))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "<|endoftext|>")]
    check(rows, packing.pack(docs(rows).repartition(3)).collect())
    check(rows[:5], packing.pack(docs(rows[:5])).collect())


def test_limits_on_segments_and_loss(docs, spark):
    from pyspark.sql import functions as F

    rows = [(i, "a b c " * (i % 40)) for i in range(120)]
    table = docs(rows).withColumn("loss_mask", F.array_repeat(F.lit(True), 7))
    for p in (packing.pack(docs(rows), max_segments=4).collect(),):
        counts = defaultdict(int)
        for x in p:
            counts[x.sequence_id] += 1
        assert max(counts.values()) <= 4
    sums = defaultdict(int)
    for x in packing.pack(table, max_tokens=512, max_loss=100).collect():
        sums[x.sequence_id] += x.length  # masks of another length mean that all tokens bear loss
    assert max(sums.values()) <= 100


def test_repeated_rows_and_empty_table(docs):
    assert packing.pack(docs([])).collect() == []
    got = packing.pack(docs([(1, "same text"), (1, "same text")]).coalesce(1)).collect()
    assert sum(p.length for p in got) == 2 * (len(LIBRARY.encode("same text", add_special_tokens=False).ids) + 1)


def test_line_breaks_beside_odd_spaces(docs):
    texts = ["a\n\xa0", "Prix :\n\xa0 12", "x\n\xa0\ny", "a\r\n\xa0\xa0b", "\xa0\nz", "a\r\n b", "w " * 600 + "\n\xa0 end\n", "n" * 999 + "\n\xa0x", "n" * 1001 + "\n\xa0x"]
    rows = list(enumerate(texts))
    check(rows, packing.pack(docs(rows).repartition(1)).collect())


def test_plain_pools_are_packed_as_by_the_dot_product():
    rng = random.Random(8)
    pieces = [(i, 0, rng.randint(1, 700), None) for i in range(400)]
    general = [(k, at, n, [True] * n) for k, at, n, _ in pieces]  # the same loss by a mask, so the general way is taken
    placed = [list(packing.Packer(2048, 9, 1800, True).pack(p, last=True)) for p in (pieces, general)]
    assert placed[0] == placed[1]


def test_a_pool_of_long_documents_holds_their_ends_only(docs, monkeypatch):
    rows = [(i, "word " * (3000 + i)) for i in range(40)]
    check(rows, packing.pack(docs(rows).repartition(1)).collect())
