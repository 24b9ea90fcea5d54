"""Edge cases of the loaders, structural readers, classifiers and matchers that queries over tables don't meet."""

import pytest
from pyspark.sql import functions as F

from galley.functions import fixed, rules
from galley.operators import board, channels, classify, listings, proofread as pr, toc, velocity
from galley.plans import office
from galley.sources import archives, feeds, sinks


#: 250 different syllables.
LONG = "".join(chr(0xAC00 + 7 * k) for k in range(250))


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_category_precedence(spark):
    subjects = {"gpt": ("챗gpt", "chatgpt"), "rag": (" rag ",), "코딩": ("바이브 코딩",)}
    titles = ["RAG", "바이브 코딩과 MCP", "바이브 코딩", "혼자 공부하는 SQL with 챗GPT", "챗GPT", "", None, "요리"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    got = [r.c for r in rows.select("i", classify.category(F.col("t"), subjects).alias("c")).orderBy("i").collect()]
    assert got == ["rag", "MCP/AI에이전트", "코딩", "데이터베이스/SQL", "gpt", fixed.NO_TOPIC, fixed.NO_TOPIC, fixed.NO_TOPIC]


def test_lecture_shelves(spark):
    rows = spark.createDataFrame([("챗gpt", "LLM", None), ("요리", "LLM", "보안"), ("요리", "x", "보안"), ("요리", None, None)], "t string, a string, b string")
    got = [r.c for r in rows.select(classify.lecture_category(F.col("t"), F.col("a"), F.col("b"), {"gpt": ("챗gpt",)}).alias("c")).collect()]
    assert got == ["gpt", "LLM/프롬프트엔지니어링", "보안/정보보호", fixed.NO_TOPIC]


def test_columns_by_content():
    rows = [[str(i), f"책 제목이 여기 길게 있습니다 {i}", "홍길동", "한빛미디어" if i % 2 else "길벗", "12,000원"] for i in range(1, 8)]
    assert archives.columns_by_content(rows) == {"publisher": 3, "rank": 0, "sales": 4, "title": 1, "author": 2}
    assert archives.columns_by_content([]) == {}
    assert list(archives.bestseller_rows([])) == list(archives.bestseller_rows([["a", "b"], ["1", "2"]])) == []
    assert list(archives.bestseller_rows(rows))[0] == (1, "책 제목이 여기 길게 있습니다 1", "한빛미디어", "홍길동", 12000, 0)


def test_lists_without_a_title_column():
    assert list(archives.lecture_rows([["x", "y"], ["1", "2"]])) == []
    assert list(archives.planned_rows([["x"], ["1"]])) == []
    assert list(archives.lecture_rows([["카테고리", "수강생"], ["SQL", "12명"], ["", "3"]])) == [("강의플랫폼", "", "SQL", "SQL", 12)]
    assert list(archives.isbn_items([["isbn", "title"], ["'1'", "t"], ["None", "u"]])) == [("1", 999, "t", "", "", 0)]


def test_docx_elements_in_order(spark):
    content = office.word([("heading1", "Top"), ("table", "a|b<c"), ("picture", ""), ("numbered", "n"), ("bullet", "u"), ("code", "x = 1"), ("bold", "strong"), ("body", "  "), ("body", "end")])
    e = archives.docx_elements(content)
    assert [(r[0], r[1], r[2], r[3], r[4], r[6], r[7], r[9]) for r in e] == [
        (0, "heading1", "Top", False, False, False, None, None), (1, "table", "", False, False, False, None, [["a", "b<c"]]), (2, "", "", False, False, False, "media/one.png", None),
        (3, "", "n", True, False, False, None, None), (4, "", "u", False, True, False, None, None), (5, "", "x = 1", False, False, False, None, None), (6, "", "strong", False, False, True, None, None), (7, "", "end", False, False, False, None, None),
    ]
    assert e[5][5] == "Consolas" and e[5][10] == [{"text": "x = 1", "bold": False, "italic": False, "font": "Consolas"}]
    listing = spark.createDataFrame([("a.docx", bytearray(content)), ("b.txt", bytearray(b"x"))], "name string, content binary")
    assert archives.elements(listing).count() == 8


def test_hwpx_elements_leave_out_notes():
    content = office.hwpx([("heading2", "Part"), ("header", "no"), ("footNote", "no"), ("table", "a|b"), ("numbered", "n"), ("code", "x"), ("body", "last")])
    assert [(r[1], r[2], r[3], r[5], r[8], r[9]) for r in archives.hwpx_elements(content)] == [
        ("table", "", False, "", None, [["a", "b"]]), ("Heading2", "Part", False, "", 2, None), ("", "n", True, "", None, None), ("", "x", False, "D2Coding", None, None), ("", "last", False, "", None, None),
    ]
    assert archives.hwpx_text(content).split("\n")[-1] == "last"


@pytest.mark.parametrize(
    ("found", "suggestion", "same"),
    [("데이터를 본다.", "데이터를  본다", True), ("되어지는", "되는", False), ("가나다라마바사아자차", "가나다라마바사아자타", True), ("", "", False), ("a", None, False), (LONG, LONG[:-1] + "y", True), (LONG, LONG[::-1], False), ("가나다", "가나다라마", False)],
)
def test_same_suggestion(spark, found, suggestion, same):
    row = spark.createDataFrame([(found, suggestion)], "f string, s string")
    assert row.select(pr.same_suggestion(F.col("f"), F.col("s")).alias("x")).first().x is same


def test_suggestion_cleaner_cuts_long_ones(spark):
    long = "이 문장은 스무 글자가 넘는 첫 문장이다. " + "그리고 설명이 뒤에 길게 이어집니다 " * 8
    row = spark.createDataFrame([("사실오류", "짧다", long), ("기타", "짧다", long)], "t string, f string, s string")
    got = [r.x for r in row.select(pr.clean_suggestion(F.col("t"), F.col("f"), F.col("s")).alias("x")).collect()]
    assert got == ["이 문장은 스무 글자가 넘는 첫 문장이다.", long.strip()]


def test_surface_rules_find_slips_and_leave_clean_sentences_alone(spark):
    slips = ["이 데이터을를 다시 한 번 확인합니다.", "프로그램이 실행되어지고 있습니다 여기.", "그러나 하지만 결과는 같습니다 여기서.", "이 컨텐츠는 무료로 제공됩니다 모두에게.", "이것은 서버에서의 처리 방법을 말한다."]
    clean = ["이 데이터를 다시 한 번 확인합니다 모두.", "프로그램이 실행되고 있습니다 바로 여기.", "이 콘텐츠는 무료로 제공됩니다 모두에게."]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(slips + clean)], "doc_id int, page int, text string")
    expected = spark.createDataFrame([(i, t, "") for i, t in enumerate(["오탈자", "이중수동", "접속사중복", "외래어표기오류", "번역체"])] + [(5 + i, None, None) for i in range(3)], "doc_id int, type string, found string")
    r = pr.confusion(expected, pr.scan(pages, rules.SURFACE)).first()
    assert (r.detected, r.missed, r.false_positives, r.clean) == (5, 0, 0, 3)


def test_comments_of_long_lines(spark):
    for size in (10, 3_990, 4_010, 200_000):
        line = f"f('#{'x' * size}', \"//\") # why"
        assert one(spark, listings.without_comment(F.col("t")), t=line) == line[:-6]
    assert one(spark, listings.without_comment(F.col("t")), t="# all comment ") == "# all comment"
    assert one(spark, listings.without_comment(F.col("t")), t='s = "a\\"#b" / 2 // c') == 's = "a\\"#b" / 2'


def test_matching_again_and_common_lines(spark):
    common = ["}", "return", "else:"]
    files = spark.createDataFrame([(f"p/f{k}", f"f{k}", "\n".join([f"line {k} {i}" for i in range(6)] + common)) for k in range(30)], "path string, filename string, content string")
    blocks = spark.createDataFrame([("a", "f1", 1, [f"line 2 {i}" for i in range(6)] + common), ("b", "f3", 1, [f"line 3 {i}" for i in range(6)]), ("c", "none", 9, common + ["line 7 1", "line 7 2", None])], "block_id string, filename string, page int, lines array<string>")
    assert sorted((r.block_id, r.path, r.how) for r in listings.match_blocks(blocks, files).collect()) == [("a", "p/f2", "again"), ("b", "p/f3", "name"), ("c", "p/f7", "content")]
    best = {r.block_id: (r.path, r.hits) for r in listings.best_files(blocks, files).collect()}
    assert best == {"a": ("p/f2", 9), "b": ("p/f3", 6), "c": ("p/f7", 5)}


def test_competing_books_fill_up_to_three(spark):
    books = spark.createDataFrame([(f"Deep learning {i}", i) for i in range(1, 9)] + [("Unlearned", 9)], "title string, rank int")
    cards = spark.createDataFrame([("a", "learn!", []), ("b", "learning", ["DEEP LEARNING 1", "x"]), ("c", "learned", None), ("d", "learning", ["p", "q", "r"]), ("e", "zz", [])], "path string, keyword string, known array<string>")
    got = {}
    for r in velocity.competing_books(cards, books).orderBy("path", "place").collect():
        got.setdefault(r.path, []).append(r.title)
    assert got == {"a": ["Deep learning 1", "Deep learning 2", "Deep learning 3"], "b": ["Deep learning 2"], "c": ["Unlearned"]}


def test_tolerant_json_of_cards():
    assert feeds.tolerant_json('[{"views": "1,234회"}, {"views": 1,234,567}, {"views": 12}]') == '[{"views": 1234}, {"views": 1234567}, {"views": 12}]'
    assert feeds.tolerant_json('[{"a": 1} {"b": 2}}]') == '[{"a": 1}, {"b": 2}]'
    assert feeds.tolerant_json("") is None and feeds.tolerant_json("no") is None


def test_hash_id_is_the_32_bit_hash(spark):
    def reference(text):
        h = 0
        for c in text:
            h = (h * 31 + ord(c)) % 2**32
        digits = ""
        while h:
            h, d = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return "it" + (digits or "0")

    for text in ("", "a", "기획 항목", "x" * 300):
        assert one(spark, board.hash_id(F.col("t")), t=text) == reference(text)


def test_highlight_and_numbers(spark):
    assert one(spark, channels.highlighted(F.col("t"), F.col("q")), t="An ABC and abc", q="abc") == "An <mark>ABC</mark> and abc"
    assert one(spark, channels.highlighted(F.col("t"), F.col("q")), t="none", q="abc") == "none"
    assert [one(spark, channels.short_number(F.col("n")), n=n) for n in (999, 1500, 15_000, 25_000_000)] == ["999", "1.5천", "2만", "2.5천만"]


def test_report_says_when_rows_are_left_out(spark):
    rows = spark.range(5)
    assert sinks.markdown_table(rows, ["id"], 3).endswith("(the first 3 rows)")
    assert "first" not in sinks.markdown_table(rows, ["id"], 5)


def test_outline_odds(spark):
    text = "// note\n=====\n#### Deep [12p]\nbody" + "x" * 120 + "\n\t" + "y" * 120 + "\n부록 A\n   \n1.2.3.4. four\n12\n- item"
    got = [(r.line, r.level, r.title[:6], r.pages) for r in toc.outline_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).orderBy("line").collect()]
    assert got == [(2, 4, "Deep", 12), (3, 1, "bodyxx", 0), (5, 1, "부록 A", 0), (7, 4, "four", 0), (8, 1, "12", 0), (9, 2, "item", 0)]


def test_regions_need_pages(spark):
    rows = [(1, p, 800.0, "Head") for p in range(3)] + [(1, p, 20.0, f"{p}") for p in range(3)]
    lines = spark.createDataFrame(rows, "doc_id int, page int, y double, text string")
    assert pr.repeating_regions(lines).count() == 0
    assert [(r.side, r.region, r.n) for r in pr.repeating_regions(lines, least_pages=3).collect()] == [("top", "Head", 3)]
