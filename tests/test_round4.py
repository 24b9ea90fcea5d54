"""Files of reports by the thousand, without names, rows or texts that get lost; ties of the newest articles."""

import datetime as dt
import os

import duckdb
import pytest

from galley.plans import s2_news, s16_services
from galley.sources import feeds, sinks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _documents(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _same_reports(spark, sf_dir):
    got = s16_services.QUERIES["s16_report_files"](spark, sf_dir).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet/*.parquet'")
    want = con.execute(s16_services.ORACLES["s16_report_files"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert [r["filename"] for r in got] == sorted((r[1] for r in want), reverse=True)
    return len(got)


def test_reports_without_text_are_in_the_index(spark, tmp_path):
    # Spark's listing passes over empty files
    assert _same_reports(spark, _documents(spark, tmp_path, [(1, ""), (2, "plain"), (3, ""), (5, ""), (7, None), (8, "\n"), (9, " "), (10, "﻿# a\x00b\r\n> c")])) == 7


def test_reports_of_one_name_are_all_in_the_index(spark, tmp_path):
    # of equal names one file stayed
    assert _same_reports(spark, _documents(spark, tmp_path, [(i % 7, f"text {i}") for i in range(40)])) == 40


def test_files_lie_in_small_folders_and_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "IN_FOLDER", 10)
    rows = [(f"_{i}.md" if i % 2 else f".{i}.md", None if i % 5 == 0 else f"t{i}\r\n") for i in range(95)]
    path = f"{tmp_path}/files"
    sinks.write_files(spark.createDataFrame(rows, "filename string, content string").repartition(2), f"file://{path}")
    sizes = [len(names) for folder, _, names in os.walk(path) if names]
    assert sum(sizes) == 95 and max(sizes) <= 10
    assert sorted(os.listdir(path)) == ["part-000000", "part-000001"]
    assert sorted(map(tuple, feeds.markdown(spark, path).collect())) == sorted((n, t or "") for n, t in rows)
    with pytest.raises(FileExistsError):
        sinks.write_files(spark.createDataFrame(rows[:1], "filename string, content string"), path)


def test_a_failed_write_leaves_no_files(spark, tmp_path):
    path = f"{tmp_path}/files"
    with pytest.raises(Exception, match="not a file name"):
        sinks.write_files(spark.createDataFrame([("a.md", "x"), ("b/c.md", "x")], "filename string, content string").coalesce(1), path)
    assert os.listdir(path) == []


def test_the_driver_lists_no_files(spark, tmp_path):
    path = f"{tmp_path}/files"
    sinks.write_files(spark.range(600).selectExpr("concat('r', id, '.md') AS filename", "'x' AS content"), path)
    rows = feeds.markdown(spark, path)
    # a scan of text files has all their names on the driver
    assert rows.inputFiles() == [] and rows.count() == 600


def test_newest_articles_that_tie(spark, tmp_path):
    day = dt.datetime(2024, 1, 30, 12)
    rows = [(i * 3001, day, i, "purchase", 1.0, '{"k": 1}') for i in range(60)] + [(i * 3001 + 1, day, i, "view", 1.0, None) for i in range(5)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in s2_news.QUERIES["s2_newest"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    sql = s2_news.ORACLES["s2_newest"]
    # which of the sixty the SQL takes is open; the query takes those with the smallest event_id
    assert [r[1:] for r in got] == [r[1:] for r in con.execute(sql).fetchall()]
    assert got == con.execute(sql.replace("date DESC, link LIMIT", "date DESC, link, event_id LIMIT")).fetchall()
    assert [r[0] for r in got] == [i * 3001 for i in range(20)]
