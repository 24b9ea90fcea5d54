"""The streaming ingest driven to its end over files."""

import datetime as dt
import json

from galley.streaming import ingest


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def rows(*links):
    return [{"link": x, "source": "s", "title": "t", "ts": f"2024-01-0{i + 1}T00:00:00", "keywords": ["k"]} for i, x in enumerate(links)]


def test_archive_takes_each_link_once(spark, tmp_path):
    source = tmp_path / "in"
    write(source, "a.json", rows("a", "b", ""))
    for name, links in (("b.json", ()), ("b.json", ("a", "c"))):
        if links:
            write(source, name, rows("a", "x")[:1] + [{"link": "c", "source": "s", "title": "t", "ts": "2024-01-02T00:00:00", "keywords": []}])
        ingest.into_archive(ingest.first_sightings(ingest.arriving(spark, str(source))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.link for r in got) == ["a", "b", "c"]


def test_weeks_begin_on_mondays(spark, tmp_path):
    write(tmp_path / "in", "a.json", rows("a", "b", "c", "d", "e", "f", "g", "h"))
    feeds = spark.createDataFrame([("s", 0.5)], "id string, weight double")
    q = ingest.weekly_keywords(ingest.arriving(spark, str(tmp_path / "in")), feeds).writeStream.format("memory").queryName("weeks").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.week_start.date(), r.points) for r in spark.table("weeks").collect()}
    assert got == {(dt.date(2024, 1, 1), 3.5), (dt.date(2024, 1, 8), 0.5)}
