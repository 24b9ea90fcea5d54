"""Findings of round 3: queries on inputs that the smallest tables don't hold."""

import datetime
import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from galley.operators import listings, news, proofread, toc
from galley.plans import s15_more, s16_services
from galley.sources import archives, feeds, paged


def _same(df, sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = sorted(repr(r) for r in result.fetchall())
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == want
    return want


def test_numbers_beyond_a_long(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"Customer#{k}") for k in (0, 9, 14_999, 55_105)], "c_custkey long, c_name string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    _same(s15_more.QUERIES["s15_numbers"](spark, str(tmp_path)), s15_more.ORACLES["s15_numbers"], customer=f"{tmp_path}/customer.parquet/*.parquet")
    # the fourth power of 900,000 is beyond 64 bits
    rows = spark.createDataFrame([(899_998, "Customer#1")], "c_custkey long, c_name string")
    rows.write.mode("overwrite").parquet(f"{tmp_path}/customer.parquet")
    n = int(900_000.0**4 % 30_000_000)
    assert s15_more.QUERIES["s15_numbers"](spark, str(tmp_path)).first()["shown"] == (f"{n / 1e7:.1f}천만" if n >= 10_000_000 else f"{int(n / 10_000 + 0.5)}만" if n >= 10_000 else str(n))


def test_texts_without_words_get_no_chunks(spark, tmp_path, sf_dir):
    d = spark.createDataFrame([(1, "a b ! c"), (2, ""), (3, "the end"), (4, "und"), (5, None)], "doc_id long, text string")
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    got = _same(s15_more._relevant(spark, str(tmp_path)), s15_more.ORACLES["s15_relevant_chunks"], documents=f"{tmp_path}/documents.parquet/*.parquet", nation=f"{tmp_path}/nation.parquet/*.parquet")
    assert {x[1] for x in got} == {"3", "4"}


def test_newest_breaks_ties(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(i, "same", day, ["k"]) for i in range(200, 0, -1)]
    a = spark.createDataFrame(rows, "event_id long, link string, date date, keywords array<string>").repartition(7)
    assert [r["event_id"] for r in news.newest(a, "k", top=5, ties=("event_id",)).collect()] == [1, 2, 3, 4, 5]


def test_readers_give_bounded_batches():
    made = []

    def rows(name, n):
        for k in range(n):
            made.append((name, k))
            yield name, k

    sizes = [(0, 3), (archives.BYTES, 1), (5, 0), (5, 2 * archives.ROWS + 7), (archives.BYTES, 2), (1, 1)]
    got, ahead = [], 0
    for some in archives.in_batches((size, rows(i, n)) for i, (size, n) in enumerate(sizes)):
        got.append(some)
        ahead = max(ahead, len(made) - sum(map(len, got)))
    assert [x for some in got for x in some] == [(i, k) for i, (_, n) in enumerate(sizes) for k in range(n)]
    assert [len(x) for x in got] == [4, archives.ROWS, archives.ROWS, 9, 1]
    assert ahead == 0  # no file is read before the rows of those in front are given


def test_lines_of_no_block_are_not_kept(spark, monkeypatch):
    sizes = []

    def settled(df, real=listings.settled):
        kept = real(df)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(listings, "settled", settled)
    more = "\n".join(f"other line {k}" for k in range(300))
    files = spark.createDataFrame([("d/a", "a", "one\ntwo\n" + more), ("d/b", "b", "one\nthree\nfour\n" + more)], "path string, filename string, content string")
    blocks = spark.createDataFrame([("1", "x", 1, ["one", "three", "fourr"])], "block_id string, filename string, page int, lines array<string>")
    for limit in (listings.BROADCAST_BYTES, -1):
        monkeypatch.setattr(listings, "BROADCAST_BYTES", limit)
        chosen = listings.best_files(blocks, files)
        assert [tuple(r) for r in chosen.collect()] == [("1", "d/b", 2)]
        got = {r["number"]: r["stage"] for r in listings.compare_lines(blocks, files, chosen).collect()}
        assert got == {0: "exact", 1: "exact", 2: "diff"}
        assert listings.coverage(blocks, files, chosen).first()["covered"] == 2
    assert max(sizes) < 10


def test_term_variants_deal_each_spelling_once(spark):
    pages = spark.createDataFrame([(1, 1, "Spark Spark Spark spark SPARK And and"), (1, 2, "Spark data data"), (2, 1, "Data Data data data data data")], "doc_id long, page int, text string")
    out = proofread.term_variants(pages, ("and",))
    assert sorted(map(tuple, out.collect())) == [(1, "SPARK", 1, "Spark"), (1, "spark", 1, "Spark"), (2, "Data", 2, "data")]
    # the list of spellings is all that is gathered of a term, which its spellings give anyway
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "bool_or" not in plan and "sum(" not in plan


def test_titles_meet_pages_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(toc, "BLOCK", 3)
    monkeypatch.setattr(toc, "WORDS", 4)
    rng = random.Random(5)
    words = ["ab", "abc", "c", "bca", "the", "them", "x", "글입", "한글입문", *(f"word{i}" for i in range(9))]
    said = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
    pages = spark.createDataFrame([(d, i, None if i % 4 == 0 else i + rng.randint(-2, 2), said()) for d in (1, 2) for i in range(1, 40)], "doc_id long, page int, printed int, text string")
    entries = spark.createDataFrame([(d, i, said(), 1, None if i % 7 == 0 else rng.randint(1, 44)) for d in (1, 2, 3) for i in range(40)], "doc_id long, entry int, title string, level int, page int")
    out = toc.compare(entries, pages)
    # a page was dealt to all numbers that it can serve, and a title to all its grams
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.doc_id, r.entry): r.body_page for r in out.collect()}
    offset = {r.doc_id: r.offset for r in toc.page_offset(pages).collect()}
    on = pages.withColumnRenamed("page", "at").withColumn("norm", toc.normal_title(F.col("text")))
    pairs = entries.filter("page is not null").withColumn("want", toc.normal_title(F.col("title"))).join(on, "doc_id").filter(toc.found_in(F.col("want"), F.col("norm")))
    best = {}
    for r in pairs.collect():
        number = r["at"] - offset[r.doc_id]
        found = [(3, r["at"], False, number if number >= 1 else r["at"])]
        found += [(stage, abs(n - r.page), n < r.page, n) for stage, n in ((1, r.printed), (2, number)) if n is not None and n >= 1 and abs(n - r.page) <= toc.BAND]
        best[r.doc_id, r.entry] = min([*found, *([best[r.doc_id, r.entry]] if (r.doc_id, r.entry) in best else [])])
    kept = {(r.doc_id, r.entry) for r in entries.filter("length(title) >= 2").collect()}
    assert got == {k: best[k][3] if k in best else None for k in kept}
    assert {b[0] for b in best.values()} == {1, 2, 3}


def test_normal_titles(spark):
    text = "".join(map(chr, [*range(0x250), 0xABFF, 0xAC00, 0xD7A3, 0xD7A4, 0xFFFD, 0x1F600, 0x10FFFF])) + "  A,  b\n"
    want = re.sub("[^a-z0-9가-힣]+", " ", text.lower()).strip()
    assert spark.createDataFrame([(text,)], "t string").select(toc.normal_title(F.col("t"))).first()[0] == want


def test_many_pages_in_few_files_and_tasks(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    items = spark.range(9_000).selectExpr("concat('q', id % 3) AS query", "lpad(cast(id div 6 AS string), 8, '0') AS token", "concat('é ', id, '\\t', id) AS item")
    options = {"path": str(tmp_path / "p"), "keys": '{"small": 9, "large": 1000000000000}', "transport": "galley.sources.paged:PageShelves"}
    read = lambda: spark.read.format("paged").options(**options).load()
    assert paged.PageShelves(options).plan() == []
    paged.write_shelves(items.filter("token < '00000700'"), options["path"])
    first = paged.PageShelves(options).plan()
    paged.write_shelves(items.filter("token >= '00000700'"), options["path"])
    plan = paged.PageShelves(options).plan()
    # a page had a folder and a file of its own, and each sixteen a task
    assert len(plan) == 4_500 and plan[: len(first)] == first and len(list((tmp_path / "p" / "shelves").glob("*/part-*"))) <= 6
    rows = read()
    assert rows.rdd.getNumPartitions() <= paged.TASKS + 2
    got = rows.collect()
    assert sorted((r.query, r.token, r.item) for r in got) == sorted(map(tuple, items.collect()))
    assert {(r.query, r.token) for r in got if r.key == "small"} == set(plan[:9]) and {r.state for r in got} == {"read"}
    assert {(r.token, r.query): r.place for r in got} == {(t, q): 1 for q, t in plan}
    assert read().filter("place = 0").count() == 4_500


def test_keys_pay_for_all_pages_of_any_table():
    # a million units were fewer than the pages of customers at six GB
    pages = range(1_100_000)
    assert [p.key for p in paged.allotted(pages, json.loads(s16_services.KEYS), 1, 1_000_000)] == ["small", "large", "large"]


def test_gate_is_dealt_over_tasks(spark, sf_dir):
    plan = s16_services.QUERIES["s16_gate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    n = s16_services.SPREAD * spark.sparkContext.defaultParallelism
    # all rules ran where the file was read, in one task
    scan = plan[plan.index("regexp_extract_all") :]
    assert f", {n}), REPARTITION_BY_NUM" in scan


def test_segments_gather_orders_once(spark, sf_dir):
    made = s15_more.QUERIES["s15_segments"](spark, sf_dir)._jdf.queryExecution()
    plan = made.optimizedPlan().toString()
    # lines were read, dealt and numbered again for the labels, which were then made distinct
    assert plan.count("Relation") == 1 and plan.count("Aggregate") == 1
    # one exchange by document serves all windows, in as many tasks as the rows need
    physical = made.executedPlan().toString()
    assert physical.count("Exchange") == 1 and "REPARTITION_BY_NUM" in physical


def test_masks_of_a_pool_take_a_byte_a_flag(monkeypatch):
    import tracemalloc

    import pyarrow as pa
    import pyspark
    from pyspark.sql import types as T

    packing = pytest.importorskip("galley.llm.packing")

    class Docs:
        columns = ["doc_id", "text", "loss_mask"]
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("loss_mask", T.ArrayType(T.BooleanType()))])

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    class Task:
        def partitionId(self):  # noqa: N802
            return 0

    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: Task())
    text = "the cat sat on the mat and " * 100
    n = len(packing.tokens.encoder(packing.tokens.TOKENIZER, packing.tokens.RANKS)(text)) // 4 + 1
    flags = [i % 3 == 0 for i in range(n)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(3_000)), pa.array([text] * 3_000), pa.array([flags, None, flags[1:]] * 1_000, pa.list_(pa.bool_()))], names=Docs.columns)
    run = packing.pack(Docs(), 2048, 8, 768, cut=False)
    tracemalloc.start()
    out = [b for b in run(iter([rows]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = [r for b in out for r in b.drop_columns("ids").to_pylist()]
    assert {r["doc_id"]: sum(x["loss_tokens"] for x in got if x["doc_id"] == r["doc_id"]) for r in got[:30]} == {r["doc_id"]: sum(flags) if r["doc_id"] % 3 == 0 else n for r in got[:30]}
    assert peak < 3_000 * n * 12


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"r{i}.md").write_text(f"# t{i}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        rows = feeds.markdown(spark, str(tmp_path))
        # a file was a split, and each split a task
        assert rows.rdd.getNumPartitions() <= feeds.SPLITS * spark.sparkContext.defaultParallelism < 300
        assert sorted(map(tuple, rows.collect())) == sorted((f"r{i}.md", f"# t{i}\n") for i in range(300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
