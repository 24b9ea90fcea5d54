import random

import numpy as np
from pyspark.sql import functions as F

from galley.llm import chat, instructions, packing, tokens
from galley.session import table


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def conversations(seed, n):
    rng = random.Random(seed)
    word = lambda k: " ".join(rng.choice(("plain", "naïve", "한국어", "x", "</s>", "tokens,")) for _ in range(k))
    out = []
    for c in range(n):
        long_question = rng.random() < 0.5
        for t in range(rng.randint(1, 4)):
            out += [(c, 2 * t, "user", word(rng.randint(20, 90) if long_question else 3)), (c, 2 * t + 1, "assistant", word(3 if long_question else rng.randint(20, 90)))]
    return out + [(None, 0, "user", None), (7, None, "assistant", "late"), (7, None, "assistant", "late")]


def test_flags_cover_the_assistants_texts(spark):
    encode = tokens.encoder(tokens.TOKENIZER, tokens.RANKS)
    lengths = instructions.byte_lengths(encode)
    rows = turns(spark, conversations(1, 25))
    windows = {f"{'null' if r.conv_id is None else r.conv_id}:{r.part}:{r.window}": r for r in chat.windows(rows).collect()}
    got = instructions.instruction_rows(rows).collect()
    assert {r.doc_id for r in got} == set(windows) and len(got) == len(windows)
    for r in got:
        text, ids = r.text, np.frombuffer(encode(r.text), "<u4")
        assert len(r.loss_mask) == len(ids) + 1 and not r.loss_mask[-1]
        at, data = 0, text.encode()
        spans = [(len(text[: s.start].encode()), len(text[: s.end].encode())) for s in windows[r.doc_id].loss]
        for i, flag in zip(ids.tolist(), r.loss_mask, strict=False):
            assert flag == any(a <= at < b for a, b in spans)
            at += int(lengths[i])
        assert at == len(data)


def test_the_chosen_example_has_the_largest_dot_product():
    """Small pools: at each step no fitting example would have a larger product, and no limit is passed."""
    rng = random.Random(4)
    bound = 0
    for _ in range(60):
        limits = (rng.randint(20, 60), rng.randint(2, 6), rng.randint(6, 25))
        pieces = []
        for key in range(rng.randint(1, 40)):
            n = rng.randint(1, limits[0])
            mask = [False] * n
            for i in rng.sample(range(n), rng.randint(0, min(n, limits[2]))):
                mask[i] = True
            pieces.append((key, 0, n, mask))
        packer = packing.Packer(*limits, cut=False)
        placed = list(packer.pack(list(pieces), last=True))
        assert sorted(p[0] for p in placed) == list(range(len(pieces)))
        demand = {p[0]: np.array([p[2], 1, sum(p[3])], float) for p in pieces}
        limit = np.array(limits, float)
        open_, left, now = set(demand), limit.copy(), None
        for key, start, size, sequence, offset in placed:
            if sequence != now:
                if now is not None:
                    assert not any((demand[k] <= left).all() for k in open_)  # closed only when nothing fits
                    bound += any(demand[k][0] <= left[0] and demand[k][2] > left[2] for k in open_)
                left, now, at = limit.copy(), sequence, 0
            score = {k: float(demand[k] / limit**2 @ left) for k in open_ if (demand[k] <= left).all()}
            assert score[key] >= max(score.values()) - 1e-9
            assert (start, size, offset) == (0, demand[key][0], at)
            open_.remove(key)
            left -= demand[key]
            at += size
            assert (left >= 0).all()
    assert bound > 20  # the limit on loss was what closed a sequence


def test_query_keeps_all_limits_and_the_loss_limit_binds(spark, sf_dir):
    pieces = instructions.query(spark, sf_dir)
    sums = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum("loss_tokens").alias("loss"), F.max(F.col("offset") + F.col("length")).alias("end"))
    rows = sums.collect()
    assert all(r.n <= 2048 and r.k <= 8 and r.loss <= 768 and r.end == r.n for r in rows)
    whole = instructions.instruction_rows(table(spark, sf_dir, "conversations")).select("doc_id", F.size("loss_mask").alias("n"), F.size(F.filter("loss_mask", lambda x: x)).alias("loss"))
    got = pieces.groupBy("doc_id").agg(F.sum("length").alias("n2"), F.sum("loss_tokens").alias("loss2"))
    assert whole.join(got, "doc_id", "full").filter("not (n <=> n2 and loss <=> loss2)").count() == 0
    assert instructions.pack_conversations(table(spark, sf_dir, "conversations").limit(0)).collect() == []


def test_a_column_of_that_name_and_another_type_is_no_mask(spark):
    for kind, value in (("string", "x" * 3), ("array<int>", [1, 0, 1]), ("boolean", True)):
        df = spark.createDataFrame([(1, "a b", value)], f"doc_id long, text string, loss_mask {kind}")
        assert [r.length for r in packing.pack(df, 8, 4, 4).collect()] == [r.length for r in packing.pack(df.drop("loss_mask"), 8, 4, 4).collect()]
