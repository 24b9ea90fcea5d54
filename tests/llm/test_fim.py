import hashlib
import random
import re

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galley.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def expected(doc_id, text):
    """n, form, lengths and output by a plain regular expression."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    head, middle, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(head), len(middle), f"<S>{tail}<P>{head}<M>{middle}"
    return len(units), "psm", len(head), len(middle), f"<P>{head}<S>{tail}<M>{middle}"


def texts():
    rng = random.Random(5)
    signs = "abcXYZ  \n\t.,<>PSM|éß한字😀́\u0000  0189-'"
    rows = ["", None, " ", "a", "<", "<P", "<P>", "x<S>y", "<M>", "<P<S", "S><M", "<<P", ">S>", "one two", "é", "한글 text", "\r\n\r\n", "a" * 3000, "." * 500, "😀" * 50]
    return rows + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 200))) for _ in range(400)]


def test_rows_equal_a_plain_expression(spark, docs):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "again a row"), (3, "again a row"), (None, "without an id")]
    got = sorted((tuple(r) for r in fim.fill_in_middle(docs(rows)).collect()), key=repr)
    assert got == sorted(((i, *expected(i, t)) for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_texts_come_back_exactly(spark, docs):
    rows = [(i, t) for i, t in enumerate(texts())]
    made = fim.fill_in_middle(docs(rows, extra=False), plain=3)
    back = {r.doc_id: r.back for r in made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_chunks_and_very_long_texts_give_the_same_tokens():
    rng = random.Random(9)
    long = "".join(rng.choice(["word", "a", " ", "\n", "é", "Z" * 40, "<", "7"]) for _ in range(60_000))
    want = [m.end() for m in UNIT.finditer(long)]
    for chunk in (1, 7, 1000, fim.CHUNK):
        assert fim.Cutter(chunk).ends(long[:5000] if chunk < 1000 else long).tolist() == ([e for e in want if e < 5000] + [5000] if chunk < 1000 else want)
    assert fim.Cutter().ends("x" * 2_000_000).tolist() == [2_000_000]


@given(st.text(max_size=60), st.integers(-(2**40), 2**40))
def test_any_text(text, doc_id):
    text = text.encode("utf-8", "ignore").decode()
    assert fim.example(fim.Cutter(5), doc_id, text) == expected(doc_id, text)


def test_empty_table(docs):
    assert fim.fill_in_middle(docs([])).collect() == []


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_query_equals_its_sql(spark, sf_dir, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    result = con.execute(fim.SQL)
    names = [d[0] for d in result.description]
    df = fim.query(spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(result.fetchall())
