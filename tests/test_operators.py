"""Small tables with values worked out by hand: ties, nulls, sentinels, empty input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from galley.functions import fixed
from galley.functions.dictionary import all_labels, first_label, half_up, has_signal, keyword_labels
from galley.operators import authors, board, channels, dashboard, index_terms, listings, news, proofread, reports, snapshots, structure, toc, velocity


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first().v


SNAP = "date date, rank int, title string, publisher string, price long, author string"


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def test_title_stats_skip_missing_ranks(spark):
    rows = [(day(0), 0, "a", "p", 10, ""), (day(1), 4, "a", "q", 20, ""), (day(1), 2, "a", "q", 20, ""), (day(1), None, "b", "", None, "")]
    got = {r.title: r for r in snapshots.title_stats(spark.createDataFrame(rows, SNAP)).collect()}
    assert (got["a"].days, got["a"].n_ranks, got["a"].rank_sum, got["a"].best_rank, got["a"].publisher, got["a"].price) == (2, 2, 6, 2, "p", 10)
    assert (got["b"].n_ranks, got["b"].best_rank) == (0, None)
    assert snapshots.title_stats(spark.createDataFrame([], SNAP)).collect() == []


def test_topic_trend_needs_sixty_snapshots(spark):
    rows = [(day(n), 1, "python", "p", 10, "") for n in range(60)] + [(day(50), 2, "python 2", "p", 10, "")]
    table = lambda r: snapshots.topic_table(snapshots.title_stats(spark.createDataFrame(r, SNAP))).first()
    got = table(rows)
    assert (got.topic, got.titles, got.recent_titles, got.previous_titles, got.trend) == ("파이썬", 2, 2, 1, "up")
    assert table(rows[1:]).trend == "flat"


def test_price_bins_are_closed_on_the_left(spark):
    v = lambda p: one(spark, snapshots.price_label(F.col("p")), p=p)
    assert [v(14999), v(15000), v(50000)] == ["0~15천원", "15~20천원", "50천원 이상"]


def test_dictionaries(spark):
    assert one(spark, all_labels(F.col("t"), fixed.TOPICS, fixed.NO_TOPIC), t="Python과 GPT") == ["AI/LLM 일반", "파이썬"]
    assert one(spark, first_label(F.col("t"), fixed.TOPICS, fixed.NO_TOPIC), t="요리") == "기타"
    assert one(spark, keyword_labels(F.col("t"), fixed.KEYWORDS), t="Cloud storage") == ["Cloud/DevOps", "RAG"]
    assert one(spark, keyword_labels(F.col("t"), fixed.KEYWORDS, boundary=True), t="Cloud storage") == ["Cloud/DevOps"]
    signal = lambda t: one(spark, has_signal(F.col("t"), fixed.STRONG_SIGNALS, fixed.WEAK_SIGNALS, fixed.SIGNAL_CONTEXTS), t=t)
    assert [signal("RAG in use"), signal("storage"), signal("launch of rockets"), signal("launch of an api")] == [True, False, False, True]
    assert [one(spark, half_up(F.col("x")), x=x) for x in (0.5, 1.5, -0.5)] == [1, 2, 0]


def test_iso_week_has_the_iso_year(spark):
    v = lambda d: one(spark, news.iso_week(F.to_date("d")), d=d)
    assert [v("2027-01-01"), v("2024-01-01"), v("2024-12-30")] == ["2026-W53", "2024-W01", "2025-W01"]


def test_weekly_trends_cap_and_round(spark):
    feeds = spark.createDataFrame([("v", 0.5), ("c", 2.0)], "id string, weight double")
    rows = [("v", ["k"])] * 3 + [("c", ["k", "alone"])] + [("x", ["even"])] * 5 + [("v", ["small"])]
    table = spark.createDataFrame([(s, day(3), k) for s, k in rows] + [("c", None, ["k"])], "source string, date date, keywords array<string>")
    got = {r.keyword: r.points for r in news.weekly_trends(table, feeds).collect()}
    assert got == {"k": 3, "alone": 1, "even": 2}  # 1.5 + capped 1.75; 2.0 halved; 5.0 halved to even


def test_surges_compare_whole_weeks_for_falls(spark):
    rows = [("w1", "a", 8), ("w2", "a", 3), ("w2", "b", 2), ("w3", "b", 4), ("w3", "c", 2), ("w3", "d", 1)]
    t = spark.createDataFrame(rows, "week string, keyword string, points long")
    kinds = lambda p: {(r.keyword, r.kind, r.percent) for r in news.surges(t, p).collect()}
    assert kinds(False) == {("b", "surging", 100), ("c", "new", None), ("a", "falling", -100)}
    assert kinds(True) == {("b", "surging", 100), ("c", "new", None), ("a", "falling", -62)}


def test_merge_keeps_the_first_of_a_batch(spark):
    schema = "n int, link string"
    old = news.merge_new(spark.createDataFrame([], "id string, n int, link string"), spark.createDataFrame([(2, "a"), (1, "a"), (3, ""), (4, None)], schema), ["n"])
    assert [(r.n, r.link) for r in old.collect()] == [(1, "a")]
    assert sorted(r.n for r in news.merge_new(old, spark.createDataFrame([(0, "a"), (5, "b")], schema), ["n"]).collect()) == [1, 5]


def test_author_fields(spark):
    v = lambda t, bare=False: [(p["name"], p["role"]) for p in one(spark, authors.people(F.col("t"), bare), t=t)]
    assert v("아르빈드 나라야난,사야시 카푸르 저/강미경 역") == [("아르빈드 나라야난", "저"), ("사야시 카푸르", "저"), ("강미경", "역")]
    assert v("홍길동 공저/ 김 감수/A 편") == [("홍길동", "저")]
    assert v("김편") == [("김편", "저")]
    assert v("이순신역", bare=True) == [("이순신", "역")]
    assert v("") == []


def test_author_mart(spark):
    rows = [(day(0), 3, "python", "p", 1, "kim 저/lee 역"), (day(1), 0, "python", "p", 1, "kim 저"), (day(1), 0, "etc", "q", 1, "kim, park 저")]
    mart = {r.name: r for r in authors.author_mart(authors.books(spark.createDataFrame(rows, SNAP))).collect()}
    assert sorted(mart) == ["kim", "park"]
    k = mart["kim"]
    assert (k.n_books, k.best_rank, k.total_days, k.publishers, k.topics) == (2, 3, 3, ["p", "q"], ["파이썬"])
    assert [(b.title, b.best_rank, b.days) for b in k.books] == [("python", 3, 2), ("etc", 999, 1)]


def test_statuses(spark):
    t = spark.createDataFrame([("g", 1, "r"), ("b", 5, "r"), ("b", 7, "m"), ("t", 10, "r"), ("t", 13, "m"), ("m", 3, "m"), ("기타", 1, "r"), ("x", 1, "other")], "category string, rank int, publisher string").withColumn("year", F.lit(2020))
    p = spark.createDataFrame([("기타", "기획예정"), ("p", None)], "category string, status string")
    l = spark.createDataFrame([("l", 5), ("기타", 6)], "category string, popularity int")  # noqa: E741
    got = {r.category: r.status for r in dashboard.categories(t, p, l, ["m"], ["r"]).collect()}
    assert got == {"g": "gap", "b": "behind", "t": "leading", "m": "leading", "기타": "plan-only", "p": "plan-only", "l": "lecture-only"}
    assert one(spark, dashboard.month_label(F.col("m")), m="2026년03월") == "2026년 03월"


def test_channel_scores(spark):
    v = spark.createDataFrame([], "channel_id long, title string, description string, views long, likes long, comments long")
    c = spark.createDataFrame([(1, 20000, 10, 100000, day(0))], "channel_id long, subs long, video_count long, views long, published date")
    r = channels.publish_score(c, channels.video_sums(v), F.lit(day(60))).first()
    assert (r.mean_views, r.audience, r.engagement, r.cadence, r.reaction, r.score) == (10000, 15, 30, 16, 10, 71)
    tier = lambda s, m, n, c: one(spark, channels.publish_tier(F.col("s"), F.col("m"), F.col("n"), F.col("c")), s=s, m=m, n=n, c=c)
    assert [tier(50000, 0, 5, True), tier(50000, 0, 4, True), tier(0, 20000, 3, False), tier(0, 0, 9, True)] == [1, 2, 2, 3]
    kinds = [one(spark, channels.resolve_input(F.col("t")), t=t).kind for t in ("@name", "https://youtube.com/channel/UC" + "a" * 22, "youtube.com/c/x", "파이썬")]
    assert kinds == ["handle", "id", "name", "search"]


def test_velocity_sentinels(spark):
    rows = [("a|b|c", 1, "t", day(95), 100), ("d|e|f", 2, "t", day(0), 100)]
    best = velocity.best_videos(spark.createDataFrame(rows, "path string, video_id int, title string, published date, views int"), F.lit(day(100)))
    got = {r.path: (r.ratio, r.label, r.rising) for r in velocity.leaf_stats(best, F.lit(day(100))).collect()}
    assert got == {"a|b|c": (99.0, "surging", True), "d|e|f": (0.0, None, False)}
    tree = lambda r: spark.createDataFrame(r, "l1 string, l2 string, l3 string, queries array<string>")
    assert sorted((r.l3, r.queries) for r in velocity.merged(tree([("a", "b", "c", ["x"])]), tree([("a", "b", "c", ["y", "x"]), ("a", "b", "d", ["z"])])).collect()) == [("c", ["x", "y"]), ("d", ["z"])]


def test_scan_finds_all_matches_and_cuts(spark):
    rules = [(r"a+", "x", "high", "s"), (r"(?<![0-9])7(?![0-9])", "y", "low", "")]
    p = spark.createDataFrame([(1, 1, "short a"), (1, 2, "aa bb a 7 77 " + "a" * 80), (1, 3, None)], "doc_id int, page int, text string")
    got = [(r.rule, r.place, len(r.found)) for r in proofread.scan(p, rules).orderBy("rule", "place").collect()]
    assert got == [(0, 0, 2), (0, 1, 1), (0, 2, 60), (1, 0, 1)]
    assert proofread.scan(p.limit(0), rules).collect() == []


def test_korean_rules(spark):
    p = spark.createDataFrame([(1, 1, "정말정말 좋은 문장이 있습니다. 아빠가 엄마가 오빠가 누나가 왔다.")], "doc_id int, page int, text string")
    assert [(r.particle, r.n) for r in proofread.particle_repeats(p).collect()] == [("가", 4)]
    hits = proofread.dictionary_hits(spark.createDataFrame([(1, 1, "컨텐츠를 쓰고 명컨텐츠 컨텐츠는요 컨텐츠")], "doc_id int, page int, text string"), {"컨텐츠": "콘텐츠"}).collect()
    assert [(r.found, r.suggestion) for r in hits] == [("컨텐츠", "콘텐츠")]
    none = proofread.dictionary_hits(spark.createDataFrame([(1, 1, "명컨텐츠 컨텐츠는요"), (2, 1, None)], "doc_id int, page int, text string"), {"컨텐츠": "콘텐츠"}).collect()
    assert none == []
    assert one(spark, index_terms.with_particle(F.col("w"), "을", "를"), w="책") == "책을"
    assert one(spark, index_terms.with_particle(F.col("w"), "을", "를"), w="코드") == "코드를"
    assert [one(spark, index_terms.initial_group(F.col("w")), w=w) for w in ("가방", "힣", "api", "9")] == ["ㄱ", "ㅎ", "A", "#"]


def test_cross_deduplication_and_order(spark):
    schema = "doc_id int, page int, type string, severity string, found string, suggestion string"
    s = spark.createDataFrame([(1, 2, "t", "low", "x ", ""), (1, 1, "u", "high", "x", ""), (1, 1, "u", "low", "a", "")], schema)
    m = spark.createDataFrame([(1, 2, "t", "medium", "x", "y"), (1, 1, "u", "low", "x", "")], schema)
    both = proofread.cross_deduplicated(s, m, ["t"])
    got = [(r.page, r.severity, r.found) for r in proofread.in_order(both).collect()]
    assert got == [(1, "high", "x"), (1, "low", "a"), (1, "low", "x"), (2, "medium", "x")]
    fixes = spark.createDataFrame([(1, "ab", "X"), (1, "abc", "Y")], "doc_id int, found string, suggestion string")
    assert proofread.corrected(spark.createDataFrame([(1, "abc ab")], "doc_id int, text string"), fixes).first().text == "Y X"
    assert one(spark, proofread.same_suggestion(F.col("a"), F.col("b")), a="그 책", b="그책") is True
    assert one(spark, proofread.context(F.col("a"), F.col("b")), a="0123456789x987", b="x").before == "0123456789"


def test_rule_chunks(spark):
    chunks = proofread.rule_chunks(spark.createDataFrame([(1, "intro\n## Commas and dots\nbody\n### Spaces\n| wide | x |\n## Always\nz")], "doc_id int, text string"))
    assert [r.heading for r in chunks.orderBy("chunk").collect()] == ["Commas and dots", "Spaces", "Always"]
    got = proofread.relevant_chunks(chunks, spark.createDataFrame([(0, "two commas, wide")], "batch int, text string"), ["Always"]).collect()
    assert {(r.heading, r.score) for r in got} == {("Commas and dots", 2), ("Spaces", 1), ("Always", 0)}


def test_titles_on_pages(spark):
    pages = spark.createDataFrame([(1, p, p - 2 if p > 2 else None, f"page {p} " + t) for p, t in ((1, ""), (2, ""), (3, ""), (5, "1.2 데이터분석 기초"), (6, ""), (20, "far title here"))], "doc_id int, page int, printed int, text string")
    e = spark.createDataFrame([(1, 1, "데이터 분석 기초", 1, 4), (1, 2, "far title here", 1, 2), (1, 3, "absent words", 1, 3), (1, 4, "none", 1, None), (1, 5, "x", 1, 1)], "doc_id int, entry int, title string, level int, page int")
    got = {r.entry: (r.body_page, r.status) for r in toc.compare(e, pages).collect()}
    assert got == {1: (3, "page-mismatch"), 2: (18, "page-mismatch"), 3: (None, "missing"), 4: (None, "no-page")}
    assert one(spark, toc.parsed_line(F.col("t")), t="1.2 변수와 상수 ..... 34").asDict() == {"title": "1.2 변수와 상수", "level": 2, "page": 34}


def test_listings(spark):
    b = spark.createDataFrame([("b", "m.py", 1, ["import  os", "x=1 # one", None, "print('#', x)", "value = compute(alpha, betta)"])], "block_id string, filename string, page int, lines array<string>")
    f = spark.createDataFrame([("d/m.py", "m.py", "import os\nx = 1\nprint('#', x)\nvalue = compute(alpha, beta)\ny = 2\n"), ("d/n.py", "n.py", "import os\n")], "path string, filename string, content string")
    assert [(r.path, r.how) for r in listings.match_blocks(b, f).collect()] == [("d/m.py", "name")]
    chosen = listings.best_files(b, f)
    assert [(r.path, r.hits) for r in chosen.collect()] == [("d/m.py", 2)]
    got = [r.stage for r in listings.compare_lines(b, f, chosen).orderBy("number").collect()]
    assert got == ["exact", "plain_bare", "exact", "near"]
    c = listings.coverage(b, f, chosen).first()
    assert (c.total, c.covered, c.omitted, c.missing) == (5, 3, 1, 0)
    assert one(spark, listings.without_comment(F.col("t")), t="a = '#x' // b # c") == "a = '#x'"
    rows = [(1, 1, 1, None, "main.py"), (1, 1, 2, 1, "a"), (1, 1, 3, 2, "b"), (1, 1, 4, 5, "c"), (1, 2, 1, 1, "d")]
    s = listings.segmented(spark.createDataFrame(rows, "doc_id int, page int, pos int, number int, text string")).orderBy("block_id").collect()
    assert [(r.filename, r.lines) for r in s] == [("main.py", ["a", "b", None, "c"]), ("main.py", ["d"])]


def test_structure(spark):
    e = spark.createDataFrame([(1, i, t, t) for i, t in enumerate(["list", "list", "body", "body", "list"])], "doc_id int, pos int, type string, text string")
    assert [(r.pos, r.n) for r in structure.merged_runs(e, ("list",)).orderBy("pos").collect()] == [(0, 2), (2, 1), (3, 1), (4, 1)]
    levels = [1, 2, 2, 3, 1, 3, 2]
    o = spark.createDataFrame([(1, i, v) for i, v in enumerate(levels)], "doc_id int, pos int, level int")
    number = lambda fill: [r.number for r in structure.outline_numbers(o, fill).orderBy("pos").collect()]
    assert number(False) == ["1", "1.1", "1.2", "1.2.1", "2", "2.0.1", "2.1"]
    assert number(True)[5] == "2.1.1"
    items = spark.createDataFrame([(1, 1, 0.0, 100.0, 10.0, 10.0, "a"), (1, 1, 30.0, 98.0, 10.0, 10.0, "b"), (1, 1, 40.0, 96.0, 5.0, 10.0, "c"), (1, 1, 0.0, 94.0, 5.0, 10.0, "d")], "doc_id int, page int, x double, y double, width double, font_size double, str string")
    assert [r.text for r in structure.page_lines(items).orderBy("line").collect()] == ["a b", "d c"] or [r.text for r in structure.page_lines(items).orderBy("line").collect()][0] == "a b"
    pages = structure.virtual_pages(spark.createDataFrame([(1, "a" * 10 + "\n\n" + "b" * 10 + "\n\n\n" + "c"), (2, ""), (3, None)], "doc_id int, text string"), 15)
    assert [(r.doc_id, r.page, len(r.text)) for r in pages.collect()] == [(1, 1, 22), (1, 2, 1)]
    m = structure.upper_medians(spark.createDataFrame([("k", float(x)) for x in (4, 1, 3, 2)], "k string, x double"), ("k",), "x").select(F.col("median").alias("m"))
    assert m.first().m == 3.0


def test_board(spark):
    flags = {"money": ("Invest", "coin"), "claims": ("cure",)}
    assert one(spark, board.risk_flags(F.col("t"), flags), t="We INVEST and cure") == ["money", "claims"]
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate((5, 5, 5))], "k int, i int, n int")
    assert [r.i for r in board.within_budget(rows, ["k"], [F.col("i")], F.col("n"), 10).collect()] == [0, 1]
    up = board.upserted(*[spark.createDataFrame([r], "id int, v int, s string") for r in ((1, 2, "old"), (1, 2, "new"))], "id", "v")
    assert up.first().s == "new"


def test_reports(spark):
    md = "# Title\n\n> Sum up\n\n## 핵심 인사이트\n1. **One.** x\n2. **Two** y\n## Next\nz"
    r = reports.metadata(spark.createDataFrame([("20260102_a.md", md), ("b.md", "text only 2025-03-04")], "filename string, content string")).collect()
    assert [(x.title, x.date, x.summary) for x in r] == [("b", dt.date(2025, 3, 4), "text only 2025-03-04"), ("Title", day(1), "Sum up")]
    assert one(spark, reports.headlines(reports.section(F.col("t"), "인사이트")), t=md) == ["One.", "Two"]
    assert one(spark, reports.section(F.col("t"), "absent"), t=md) is None


@pytest.mark.parametrize("terms", [True, False])
def test_index_terms(spark, terms):
    t = spark.createDataFrame([(1, "Agent", 3, [1], 1, 0, True, False, False, False), (1, "GitHub", 1, [1], 0, 1, False, False, False, False)], "doc_id int, term string, freq int, pages array<int>, body_pages int, code_pages int, defined boolean, with_english boolean, acted boolean, header_only boolean")
    if terms:
        assert [(r.term, r.score) for r in index_terms.valued(t, 0).collect()] == [("Agent", 10), ("GitHub", 0)]
        return
    pairs = index_terms.bilingual_pairs(spark.createDataFrame([(1, 1, "에이전트(Agent)는 좋다. 깃허브(GitHub)")], "doc_id int, page int, text string"))
    assert {(r.korean, r.english) for r in pairs.collect()} == {("에이전트", "Agent"), ("깃허브", "GitHub")}
    listed = t.select("doc_id", "term").unionByName(spark.createDataFrame([(1, "에이전트"), (1, "깃허브")], "doc_id int, term string"))
    assert sorted(r.term for r in index_terms.one_language(listed, pairs).collect()) == ["GitHub", "깃허브", "에이전트"]


def test_term_signals_against_brute_force(spark):
    import random
    import re
    from collections import defaultdict

    from galley.operators import index_terms

    rng = random.Random(4)
    words = ["Spark", "Sparks", "Foo", "FooBar", "the", "of", "(x)", "(", "a", "\n", "\n", "Foo the", "xFoo of"]
    pages = [(d, p, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), rng.random() < 0.4) for d in range(3) for p in range(1, 9)]
    pages += [pages[0], (9, 1, None, False), (9, 2, "Foo the", True)]
    want = defaultdict(lambda: [0, set(), 0, 0, False, False, False, 0, 0])
    for d, p, text, code in pages:
        for t in set(re.findall("[A-Z][a-z]{2,}", text or "")):
            w = want[d, t]
            ends = [m.end() for m in re.finditer("[A-Z][a-z]{2,}", text) if m[0] == t]
            w[0] += len(re.findall(rf"(?<![A-Za-z0-9]){t}(?![A-Za-z0-9])", text))
            w[1].add(p)
            w[2 + code] += 1
            for k, after in ((4, " the"), (5, r"\s?\("), (6, " of")):
                w[k] |= any(re.match(after, text[e:]) for e in ends)
            first, _, rest = text.partition("\n")
            w[7] += t in re.findall("[A-Z][a-z]{2,}", first) and t not in re.findall("[A-Z][a-z]{2,}", rest)
            w[8] += 1
    table = spark.createDataFrame(pages, "doc_id long, page int, text string, code boolean")
    got = {(r.doc_id, r.term): (r.freq, r.pages, r.body_pages, r.code_pages, r.defined, r.with_english, r.acted, r.header_only) for r in index_terms.signals(table, "[A-Z][a-z]{2,}", " the", " of").collect()}
    assert got == {k: (w[0], sorted(w[1]), *w[2:7], w[7] * 5 >= w[8] * 4) for k, w in want.items()}


def test_term_signals_query_reads_the_documents(spark, sf_dir):
    from galley.plans import s7_texts

    docs = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    rows = s7_texts.QUERIES["s9_signals"](spark, sf_dir).collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    assert {r.doc_id for r in rows} <= docs and len({r.doc_id for r in rows}) > items
