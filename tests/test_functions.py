"""Dictionaries as one pattern, and readers as table functions."""

import random

import pytest
from pyspark.sql import functions as F

from galley.functions.dictionary import first_mentioned
from galley.plans import office
from galley.sources import functions


def test_first_rule_by_one_pattern(spark):
    rng = random.Random(6)
    letters = "ab. (+한글c\\"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rules = [([word(rng.randint(1, 4)) for _ in range(rng.randint(0, 6))] + [""], f"r{i}") for i in range(67)]
    texts = [word(rng.randrange(12)) for _ in range(600)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", first_mentioned(F.col("t"), rules).alias("rule"))
    plain = lambda t: next((name for words, name in rules if t is not None and any(w and w in t for w in words)), None)
    got = df.collect()
    assert all(r.rule == plain(r.t) for r in got)
    assert len({r.rule for r in got}) > 10
    assert df.limit(1).select(first_mentioned(F.col("t"), [([], "x"), ([""], "y")]).alias("z")).first().z is None
    # the plan holds one search, and doesn't grow with the rules' number
    size = lambda n: len(spark.range(1).select(first_mentioned(F.col("id").cast("string"), [([f"w{i}"], "x") for i in range(n)]))._jdf.queryExecution().optimizedPlan().expressions().apply(0).toString().split("regexp_extract_all"))
    assert size(500) == size(5)


def test_office_rows_follow_the_constant(spark):
    functions.register(spark)
    files = [("a.docx", office.word([("body", "one"), ("heading1", "two")])), ("b.xlsx", office.workbook([["x", "y"], ["1", "2"]])), ("c.docx", b"broken"), ("d.hwp", b"x"), (None, b"x"), ("e.docx", None)]
    spark.createDataFrame([(n, bytearray(c) if c is not None else None, "more") for n, c in files], "name string, content binary, text string").createOrReplaceTempView("some_files")
    texts = {r.name: (r.text, r.error) for r in spark.sql("SELECT * FROM office_rows(TABLE(some_files), 'text')").collect()}
    assert texts["a.docx"] == ("one\ntwo", None)
    assert texts["d.hwp"] == (None, "unsupported format")
    assert texts["c.docx"][0] is None and texts["c.docx"][1].startswith("BadZipFile")
    assert set(texts) == {"a.docx", "b.xlsx", "c.docx", "d.hwp"}
    cells = spark.sql("SELECT name, line, cells FROM office_rows(TABLE(SELECT * FROM some_files WHERE name LIKE '%x') PARTITION BY (name), 'cells') WHERE name = 'b.xlsx' ORDER BY line").collect()
    assert [tuple(r) for r in cells] == [("b.xlsx", 0, ["x", "y"]), ("b.xlsx", 1, ["1", "2"])]
    from galley.sources.archives import ELEMENTS

    assert functions.MODES["elements"][0].simpleString() == spark.createDataFrame([], ELEMENTS).schema.simpleString()
    elements = spark.sql("SELECT name, pos, text FROM office_rows(TABLE(some_files), 'elements') ORDER BY pos").collect()
    assert [tuple(r) for r in elements] == [("a.docx", 0, "one"), ("a.docx", 1, "two")]
    for bad in ("office_rows(TABLE(some_files), 'no')", "office_rows(TABLE(SELECT name FROM some_files), 'text')", "office_rows('x', 'text')"):
        with pytest.raises(Exception, match="argument|lacks"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_the_gate_of_proofreading(spark):
    """All thirty slips are found and no clean sentence is accused; so says each sentence by itself."""
    from galley.functions import rules
    from galley.operators import proofread
    from galley.plans import gate

    assert (len(rules.CLICHES), len(gate.SENTENCES)) == (26, 40)
    pages = spark.createDataFrame([(i, 1, t) for i, (t, _, _) in enumerate(gate.SENTENCES)], "doc_id int, page int, text string")
    expected = spark.createDataFrame([(i, kind, found) for i, (_, kind, found) in enumerate(gate.SENTENCES)], "doc_id int, type string, found string")
    issues = proofread.scan(pages, rules.EVERY).select("doc_id", "type", "found").unionByName(proofread.repeated_words(pages).select("doc_id", "type", "found"))
    assert tuple(proofread.confusion(expected, issues).first()) == (30, 0, 0, 10)
    # every pattern is one that the engine reads, and none matches an empty text
    assert proofread.scan(spark.createDataFrame([(1, 1, " " * 30)], "doc_id int, page int, text string"), rules.EVERY).filter("found = ''").count() == 0
