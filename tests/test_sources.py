"""Readers and sinks on files written by the tests."""

import datetime as dt
import io
import json
import zipfile

import pytest

from galley.sources import archives, feeds, sinks

# Broken answers of models and what must come out of them: fences, chatter, commas, line breaks, truncation.
ANSWERS = [
    ('{"a": 1}', {"a": 1}),
    ('```json\n{"a": 1}\n```', {"a": 1}),
    ('Here you are: {"a": [1, 2]} - done', {"a": [1, 2]}),
    ('{"a": 1,}', {"a": 1}),
    ('{"a": "x\ny"}', {"a": "x\ny"}),
    ('{"a": "x\x01y"}', {"a": "xy"}),
    ('{"issues": [{"f": "a"}, {"f": "b"}, {"f": "c', {"issues": [{"f": "a"}, {"f": "b"}]}),
    ('[{"a": 1}]', [{"a": 1}]),
    ('```\n[1, 2]\n```', [1, 2]),
    ("no json at all", None),
    ("", None),
]


@pytest.mark.parametrize(("raw", "value"), ANSWERS)
def test_tolerant_json(raw, value):
    out = feeds.tolerant_json(raw)
    assert (out if out is None else json.loads(out)) == value


def test_parsed_answers(spark):
    rows = spark.createDataFrame([(r,) for r, _ in ANSWERS] + [(None,)], "raw string")
    got = feeds.parsed_answers(rows, "struct<a:string>").collect()
    assert [r.json is None for r in got] == [v is None for _, v in ANSWERS] + [True]
    assert got[0].value.a == "1"


def workbook(rows):
    names, cells = [], []
    for i, row in enumerate(rows, 1):
        line = ""
        for j, v in enumerate(row):
            ref = f"{'ABCDEFG'[j]}{i}"
            if isinstance(v, str):
                names.append(v)
                line += f'<c r="{ref}" t="s"><v>{len(names) - 1}</v></c>'
            elif v is not None:
                line += f'<c r="{ref}"><v>{v}</v></c>'
        cells.append(f"<row>{line}</row>")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{n}</t></si>' for n in names)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    return out.getvalue()


def test_spreadsheets(spark, tmp_path):
    (tmp_path / "20260102_best.xlsx").write_bytes(workbook([["순위", "상품명", "저자", "출판사", "정가"], [1, "파이썬", "kim 저", "p", "20,000원"], ["x", "두번째", "", "q", 1000], [3, "a", "", "", 1]]))
    (tmp_path / "20260103.xlsx").write_bytes(workbook([[1.0, "다른 책", "lee", "p", 5]]))
    (tmp_path / "notes.xlsx").write_bytes(b"")
    got = archives.spreadsheets(archives.dated(archives.files(spark, str(tmp_path), "*.xlsx"))).orderBy("date", "rank").collect()
    assert [(r.date.day, r["rank"], r.title, r.price) for r in got] == [(2, 0, "두번째", "1000"), (2, 1, "파이썬", "20,000원"), (3, 1, "다른 책", "5")]


def test_documents(spark, tmp_path):
    def zipped(name, **parts):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for path, text in parts.items():
                z.writestr(path.replace("__", "/").replace("_xml", ".xml"), text)

    w = 'xmlns:w="w"'
    zipped("a.docx", word__document_xml=f"<w:d {w}><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:d>")
    zipped("b.hwpx", Contents__section10_xml='<s xmlns:h="h"><h:p><h:t>last</h:t></h:p></s>', Contents__section2_xml='<s xmlns:h="h"><h:p><h:t>fi</h:t><h:t>rst</h:t></h:p><h:footNote><h:p><h:t>no</h:t></h:p></h:footNote></s>')
    (tmp_path / "c.hwp").write_bytes(b"x")
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {r.name: (r.text, r.error) for r in archives.documents(archives.files(spark, str(tmp_path), "*")).collect()}
    assert got["a.docx"] == ("one\ttwo\nthree", None)
    assert got["b.hwpx"] == ("first\nlast", None)
    assert got["c.hwp"] == (None, "unsupported format")
    assert got["d.docx"][0] is None


def test_feeds(spark):
    rss = "<rss><channel><title>C</title><item><title><![CDATA[A &amp; B]]></title><link>http://x/1</link><pubDate>Thu, 01 Jan 2026 10:00:00 GMT</pubDate><description>&lt;p&gt;text &lt;b&gt;x&lt;/b&gt;</description></item><item><title>t2</title><link>l2</link><dc:date>2026-01-02T03:04:05+09:00</dc:date></item></channel></rss>"
    atom = '<feed xmlns="a"><entry><title>E</title><link rel="alternate" href="http://y/1"/><updated>2026-01-03T00:00:00Z</updated><summary>s</summary></entry></feed>'
    got = feeds.feed_items(spark.createDataFrame([("r", rss), ("a", atom), ("n", None)], "feed_id string, xml string")).orderBy("feed_id", "place").collect()
    assert [(r.feed_id, r.title, r.link, r.date, r.summary) for r in got] == [
        ("a", "E", "http://y/1", dt.date(2026, 1, 3), "s"),
        ("r", "A & B", "http://x/1", dt.date(2026, 1, 1), "text x"),
        ("r", "t2", "l2", dt.date(2026, 1, 1), ""),
    ]


def test_scraped_pages(spark):
    page = '<div>Jan 5, 2026<a href="/news/x">Featured <h3>A long title</h3><p>More text</p></a><a href="/news/x">again here</a><a href="/other">no no no</a></div>'
    trend = '<article><h2><a href="/o/r"> r </a></h2><p> does <b>x</b></p><span itemprop="programmingLanguage">Rust</span></article><article>none</article>'
    (a,) = feeds.scraped_links(spark.createDataFrame([("u", page)], "url string, html string"), "/news/").collect()
    assert (a.link, a.title, a.date) == ("/news/x", "Featured", dt.date(2026, 1, 5))
    (r,) = feeds.repositories(spark.createDataFrame([("u", trend)], "url string, html string")).collect()
    assert (r.repo, r.description, r.language) == ("o/r", "does x", "Rust")


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_bytes('﻿a,b\r\n"x ""q""\ny",1\r\n,\r\n'.encode())
    rows = feeds.csv(spark, str(tmp_path / "in" / "t.csv"))
    assert [tuple(r) for r in rows.collect()] == [('x "q"\ny', "1")]
    sinks.write_csv(rows, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes().decode() == '﻿"a","b"\r\n"x ""q""\ny","1"\r\n' or part.read_bytes().startswith('"﻿a"'.encode())
    assert feeds.archive(spark, str(tmp_path / "none"), "a int").collect() == []
    src = tmp_path / "src" / "node_modules"
    src.mkdir(parents=True)
    (src / "x.py").write_text("no")
    (tmp_path / "src" / "m.py").write_text("import os\n")
    assert [(r.filename, r.content.strip()) for r in feeds.source_files(spark, str(tmp_path / "src")).collect()] == [("m.py", "import os")]
    terms = spark.createDataFrame([("api", [1, 2]), ("가방", [3])], "term string, pages array<int>")
    assert {r.grp: r.lines for r in sinks.index_groups(terms).collect()} == {"A": "api\t1, 2", "ㄱ": "가방\t3"}
    assert sinks.markdown_table(terms.select("term"), ["t"]).splitlines()[:2] == ["| t |", "| --- |"]


def test_answers_of_a_spreadsheet_service(spark):
    answers = {
        "arrays": ('[["a", "b"], [1, null], ["x"], [true, 2.5]]', [["a", "b"], ["1", ""], ["x"], ["true", "2.5"]]),
        "objects": ('[{"z": 1}, {"b": 2, "z": null}]', [["z", "b"], ["1", ""], ["", "2"]]),
        "headers": ('{"headers": ["h"], "data": [[1]]}', [["h"], ["1"]]),
        "values": ('{"values": [["h"], ["1"]]}', [["h"], ["1"]]),
        "table": ('call({"table": {"cols": [{"label": "d"}, {}], "rows": [{"c": [{"v": "Date(2026,0,1)", "f": "1.1"}, {"v": 3}]}, {"c": [null, {"v": null}]}]}});', [["d", ""], ["1.1", "3"], ["", ""]]),
        "html": ("<html>", []),
        "none": (None, []),
        "empty": ("[]", []),
        "broken": ("[[1, 2", []),
    }
    rows = spark.createDataFrame([(k, raw, "kept") for k, (raw, _) in answers.items()], "id string, raw string, line string").withColumnRenamed("line", "more")
    got = {}
    for r in feeds.answer_cells(rows).orderBy("id", "line").collect():
        assert r.more == "kept"
        got.setdefault(r.id, []).append(r.cells)
    assert got == {k: want for k, (_, want) in answers.items() if want}
