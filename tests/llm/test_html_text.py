import pytest

from galley.llm import html_text
from galley.llm.html_text import page_text

CASES = [
    (None, None),
    ("", ""),
    ("plain &amp; simple &lt;b&gt; &am", "plain & simple <b> &am"),
    ("<p>one<p>two</p>three", "one\n\ntwo\n\nthree"),
    ("<div>a<div>b</div>c</div>d", "a\nb\nc\nd"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<b>bold<i>both</b>still</i> x", "boldbothstill x"),
    ("  a \n\t b<span> c </span>d ", "a b c d"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x</li><li>y</ol>", "3. x\n4. y"),
    ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a   bbb\ncc  d"),
    ("<table><td>lone</table>", "lone"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><tr><td>a<br>b<td>c</table>after", "a  c\nb\n\nafter"),
    ("<table><tr><td>x<table><tr><td>in</table><td>y</table>", "x   y\n\nin"),
    ("<pre>  a\n   b</pre>", "  a\n   b"),
    ("<script>if (a<b) {'</p>'}</script>t<style>p{}</style>", "t"),
    ("<style>.h,#g{display:none}</style><p class='x h'>no<p id=g>no<p>yes", "yes"),
    ("<style>@media print{p{display:none}}</style><p>yes", "yes"),
    ("<p hidden>no</p><p style='display: none'>no</p><p style='visibility:hidden'>no<i style='visibility:visible'>yes</i>", "yes"),
    ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
    ("<select><option>a<option selected>b</select>", "b"),
    ("<input value=v><input type=hidden value=no>", "v"),
    ("<title>no</title><head><meta></head><body>yes", "yes"),
    ("<!-- no --><!DOCTYPE html>yes<!-- open", "yes"),
    ("a < b <3 <", "a < b <3 <"),
    ("<a href='x>y'>t</a>", "t"),
    ("x</p>y", "x\n\ny"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<p>a</br>b", "a\nb"),
]


OPEN_HEAD = [
    ("<head><title>T</title><body>Hello <b>x</b>", "Hello x"),
    ("<html><head><title>T</title>\n<body>all the text", "all the text"),
    ("<head><title>T</title><meta charset=u>\n Hello", "Hello"),
    ("<head><title>T</title>&lt;a&gt; <i>b</i>", "<a> b"),
    ("<head><head>Hello", "Hello"),
    ("<p>a<head>b", "ab"),
    ("<head><title>T</title><style>.h{display:none}</style> <body><p class=h>no<p>yes", "yes"),
    ("<head><noscript>no</noscript><script>no</script> <link><body hidden>no", ""),
    ("<head><title>T</title></head>a<p>b", "a\n\nb"),
]


@pytest.mark.parametrize(("source", "text"), OPEN_HEAD)
def test_head_without_an_end(source, text):
    assert page_text(source) == text


@pytest.mark.parametrize(("source", "text"), CASES)
def test_cases(source, text):
    assert page_text(source) == text


def test_deep_and_long_pages():
    assert page_text("<div>" * 20_000 + "deep") == "deep"
    assert page_text("<b>x" * 5000) == "x" * 5000
    assert page_text("<table><tr><td>" * 300 + "x").strip().endswith("x")
    assert len(page_text("<p>word " * 50_000).split()) == 50_000


def test_no_visible_word_is_lost(spark, sf_dir):
    import html
    import re

    rows = html_text.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    for r in rows:
        body = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", r.html)
        words = html.unescape(re.sub(r"<[^>]*>", " \x00 ", body)).replace("\x00", " ").split()
        said, shown = ("".join(w for w in x if w.strip("-")) for x in (words, r.text.split()))  # list marks aside
        assert said == shown, r.page_id


def test_table_of_pages(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, "u", None), (None, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_lines")
    got = sorted(((r.page_id, r.text, r.n_lines) for r in html_text.extract(pages).collect()), key=str)
    assert got == [(1, "a", 1), (1, "a", 1), (2, None, 0), (None, "", 0)]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_generated_pages_show_their_words_in_order():
    import random

    rng = random.Random(5)

    def part(depth, words):
        kind = rng.choice(["text", "p", "div", "ul", "table", "b", "hidden", "script"] if depth < 5 else ["text"])
        word = lambda: words.append(f"w{len(words)}") or words[-1]
        inside = lambda: "".join(part(depth + 1, words) for _ in range(rng.randint(1, 3)))
        if kind == "text":
            return f" {word()} "
        if kind in ("p", "div", "b"):
            return f"<{kind}>{inside()}</{kind}>" if kind != "p" else f"<p>{word()}" + rng.choice(["</p>", ""])
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{inside()}" + rng.choice(["</li>", ""]) for _ in range(2)) + "</ul>"
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{word()}" + rng.choice(["</td>", ""]) for _ in range(3)) for _ in range(2)) + "</table>"
        return "<div hidden>no" + part(depth + 1, []) + "</div>" if kind == "hidden" else "<script>no</script>"

    for _ in range(200):
        words: list[str] = []
        source = "".join(part(0, words) for _ in range(4))
        assert [w for w in html_text.page_text(source).split() if w != "-"] == words, source


def test_long_pages_take_linear_time():
    import time

    styles = "<style>" + "".join(f"p.c{i}{{display:none}}" for i in range(3000)) + "</style>"
    pages = [
        "<b>" * 8000 + "</i>" * 8000 + "x",
        "<table><td>" + "<b>" * 8000 + "</i></b>" * 8000 + "x",
        styles + "".join(f"<p class='d{i} c{9000 * (i % 2)}'>t{i}</p>" for i in range(3000)),
        "<table><tr><td>" + "w" * 20000 + "<td>b" + "<tr><td>a<td>c" * 2000 + "</table>",
        "<table>" + "<tr><td rowspan=10000 colspan=1000>a" * 1000 + "</table>",
        "<table><tr>" + "<td>a" * 5000 + "<tr><td>b" * 5000 + "</table>",
    ]
    for page in pages:
        began = time.perf_counter()
        text = html_text.page_text(page)
        assert time.perf_counter() - began < 5
        assert len(text) <= 10 * len(page)


def test_style_rules_by_element_class_and_id():
    style = "<style>p{visibility:hidden} .a{visibility:visible} p.b{display:none} #i.c{display:none} p{visibility:visible} div{visibility:hidden}</style>"
    page = style + "<p>one<p class=b>two<p id=i class='c d'>three<p id=i>four<div>five<span class=a>six</span></div>"
    assert html_text.page_text(page).split() == ["one", "four", "six"]


def test_tables_deeper_than_the_bound_keep_their_text():
    assert html_text.page_text("<table><tr><td>" * 60 + "deep" + "</table>" * 60).strip() == "deep"
