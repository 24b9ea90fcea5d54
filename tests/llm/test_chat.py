import hashlib
import random

from galley.llm import chat

HARD = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE=", "\\", "\\\\", "<", "[", "</s", "<\\s>", "ok", "é🙂", "\n", "]", "s>", "", " ", "/INST]"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, n int")


def conversations(seed, n=30, most=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        start = rng.choice([0, 250])
        for t in range(rng.randint(1, most)):
            role = "system" if t == 0 and rng.random() < 0.4 else rng.choice(["user", "assistant", "tool", "system", "a]b\n[ROLE=", "", None])
            text = None if rng.random() < 0.05 else "".join(rng.choice(HARD) for _ in range(rng.randint(0, 12))) + "word " * rng.choice([0, 3, 60])
            rows.append((c, start + t, role, text))
    return rows


def want(rows):
    out, by = {}, {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort(key=lambda x: x[0])
        loss = "".join(x[2] for x in turns if x[1] == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        out[c] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_windows_read_back(spark):
    rows = conversations(1)
    formatted = chat.windows(table(spark, rows), budget=300, history=80)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(formatted).collect()}
    assert got == want(rows)


def test_windows_keep_budget_system_turn_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "w " * 20) for t in range(1, 700)]
    out = sorted(chat.windows(table(spark, rows), budget=256, history=64).collect(), key=lambda r: (r.part, r.window))
    assert len(out) > 50
    seen = 0
    for k, r in enumerate(out):
        turns = chat.read_back(r.formatted)
        assert turns[0] == ("system", "be kind")
        assert r.n_tokens <= 256
        assert (r.n_repeated == 0) == (k == 0)
        new = turns[r.n_repeated :]
        assert [x for _, x in new] == [x for _, _, _, x in rows[seen : seen + len(new)]]
        if k:
            assert turns[1 : r.n_repeated] == [(a, b) for _, _, a, b in rows[seen - r.n_repeated + 1 : seen]]
            assert r.n_repeated > 1
        assert [chat.unescape(r.formatted[s.start : s.end]) for s in r.loss] == [b for a, b in new if a == "assistant"]
        seen += len(new)
    assert seen == len(rows)


def test_parts_go_by_position_whatever_the_turn_numbers(spark):
    texts = [f"turn {t:04} " + "w " * 20 for t in range(700)]
    plain = [(1, t, "user", x) for t, x in enumerate(texts)]
    shape = lambda rows, **k: [(r.part, r.window, r.formatted, r.n_repeated) for r in sorted(chat.windows(table(spark, rows), **k).collect(), key=lambda r: (r.part, r.window))]
    want_windows = shape(plain, budget=256, history=64)
    assert {p for p, *_ in want_windows} == {0, 1, 2}
    for change in (lambda t: t * 100_000, lambda t: None, lambda t: 5):
        assert shape([(None, change(t), r, x) for _, t, r, x in plain], budget=256, history=64) == want_windows


def test_history_reaches_over_parts(spark):
    rows = [(1, 1000 * t, "user", "a") for t in range(600)]
    out = sorted(chat.windows(table(spark, rows), budget=16_000, history=8000).collect(), key=lambda r: (r.part, r.window))
    last = [r for r in out if r.part == 2][0]
    assert last.n_repeated > chat.PART


def test_a_turn_larger_than_the_budget_stays_whole(spark):
    rows = [(1, 0, "user", "w " * 3000), (1, 1, "assistant", "x " * 3000), (1, 2, "user", "y")]
    out = chat.windows(table(spark, rows), budget=200, history=50)
    assert chat.digests(out).first().turns_sha256 == want(rows)[1][1]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    texts = ["".join(rng.choice(HARD) for _ in range(rng.randint(0, 15))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).collect()
    for r in got:
        assert chat.unescape(r.e) == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE="))


def test_odd_tables(spark):
    assert chat.windows(table(spark, [])).collect() == []
    rows = [(None, 0, "user", "a"), (None, None, "assistant", "b"), (2, 5, None, None), (2, 5, None, None), (3, -7, "assistant", "neg"), (3, 300, "user", "x")]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.windows(table(spark, rows))).collect()}
    assert got == {None: (2, 1), 2: (2, 0), 3: (2, 3)}


def test_roles_with_end_marks_read_back(spark):
    rows = [(1, 0, "a\n]b", "hello"), (1, 1, "[ROLE=x\n]", "</s>\\"), (1, 2, "\\\n]", ""), (1, 3, "user", "\n]"), (1, 4, "\n\\]", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [t for r in chat.windows(turns).orderBy("part", "window").collect() for t in chat.read_back(r.formatted)[r.n_repeated :]]
    assert found == [(r[2], r[3]) for r in rows]
