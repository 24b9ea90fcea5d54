"""News articles: ingest into an archive, weekly keyword trends and the signals read from them.

Articles are rows (link, source, source_type, title, summary, date, first_seen, keywords). Weeks carry their
ISO year and number (2026-W53), so that they sort and never repeat at a year's end. Trends are rows
(week, keyword, points). Trends are always computed from the whole archive: an article that arrives late
changes the week of its date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.functions import fixed
from galley.functions.dictionary import half_up
from galley.operators.snapshots import best_of


def article_id(link: Column) -> Column:
    """The first twelve hex digits of the link's MD5."""
    return F.substring(F.md5(link.cast("binary")), 1, 12)


def iso_week(date: Column) -> Column:
    """'2026-W05' with the ISO year."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def merge_new(archive: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """``archive`` and the rows of ``incoming`` with a new id, the first in ``order`` of each.

    Both have link; rows without one are skipped; archive has id. Columns that one side lacks are null.
    """
    rows = incoming.filter(F.length("link") > 0).withColumn("id", article_id(F.col("link")))
    first = best_of(rows, ["id"], [F.col(c) for c in order], 1, "_n").drop("_n")
    return archive.unionByName(first.join(archive.select("id"), "id", "left_anti"), allowMissingColumns=True)


def with_type(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Articles with source_type filled from the feeds' configuration (id, source_type) where it is null."""
    known = feeds.groupBy(F.col("id").alias("source")).agg(F.min("source_type").alias("_type"))
    filled = F.coalesce("source_type", "_type", F.lit(fixed.DEFAULT_TYPE))
    return articles.join(known, "source", "left").withColumn("source_type", filled).drop("_type")


def merged_feeds(snapshot: DataFrame, archive: DataFrame) -> DataFrame:
    """One row of each (source, link): the snapshot's if it has one. source_type is the source's first by link."""
    both = snapshot.withColumn("_from", F.lit(0)).unionByName(archive.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    return best_of(both, ["source", "link"], [F.col("_from"), F.col("title")], 1, "_n").drop("_n", "_from")


def weekly_trends(articles: DataFrame, feeds: DataFrame, weeks: int = 8, top: int = 15, cap: float = 0.5) -> DataFrame:
    """week, keyword, points: weighted and capped counts, the best ``top`` of each of the last ``weeks`` weeks.

    An article adds its source's weight now in ``feeds`` (id, weight; 1 for unknown sources, the largest of several) to each of its
    keywords. One source gives at most ``cap`` of a keyword's uncapped sum of the week. Sums are rounded
    half to even, and only positive ones stay. Undated articles take no part; ties go by keyword.
    """
    weight = feeds.groupBy(F.col("id").alias("source")).agg(F.max("weight").alias("weight"))
    rows = articles.filter("date is not null").join(weight, "source", "left")
    rows = rows.select(iso_week(F.col("date")).alias("week"), F.explode("keywords").alias("keyword"), "source", F.coalesce("weight", F.lit(fixed.DEFAULT_WEIGHT)).alias("w"))
    given = rows.groupBy("week", "keyword", "source").agg(F.sum("w").alias("w"))
    whole = F.sum("w").over(W.partitionBy("week", "keyword"))
    sums = given.withColumn("part", F.least("w", whole * cap)).groupBy("week", "keyword").agg(F.bround(F.sum("part")).cast("long").alias("points"))
    sums = last_weeks(sums, weeks).filter("points > 0")
    return best_of(sums, ["week"], [F.desc("points"), F.col("keyword")], top, "_n").drop("_n")


def last_weeks(rows: DataFrame, weeks: int) -> DataFrame:
    """Rows of the last ``weeks`` distinct weeks that occur."""
    last = rows.select("week").distinct().orderBy(F.desc("week")).limit(weeks)
    return rows.join(last, "week", "left_semi")


def source_stats(articles: DataFrame, today: Column) -> DataFrame:
    """source, total, month_to_date, last_7_days by first_seen."""
    seen = F.col("first_seen")
    return articles.groupBy("source").agg(F.count("*").alias("total"), F.count_if(seen >= F.trunc(today, "MM")).alias("month_to_date"), F.count_if(seen >= F.date_sub(today, 7)).alias("last_7_days"))


def daily_stats(articles: DataFrame, keep: int = 90) -> DataFrame:
    """date, articles: counts of the last ``keep`` dates on which something was first seen."""
    return articles.groupBy(F.col("first_seen").alias("date")).agg(F.count("*").alias("articles")).filter("date is not null").orderBy(F.desc("date")).limit(keep)


def weekly_counts(articles: DataFrame) -> DataFrame:
    """week, articles, before: articles of the week and of the last week that has any."""
    counts = articles.filter("date is not null").groupBy(iso_week(F.col("date")).alias("week")).agg(F.count("*").alias("articles"))
    return counts.withColumn("before", F.lag("articles").over(W.orderBy("week")))


def keyword_counts(articles: DataFrame) -> DataFrame:
    """keyword, articles: how many articles have it; an article that names it twice counts twice."""
    return articles.select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count("*").alias("articles"))


def heat_level(n: Column) -> Column:
    """The level from 0 to 4 of a number of articles; 4 for null."""
    return F.when(n == 0, 0).when(n <= 2, 1).when(n <= 5, 2).when(n <= 10, 3).otherwise(4)


def heatmap(articles: DataFrame, weeks: int = 4) -> DataFrame:
    """source, n1.. (articles of the last ``weeks`` weeks, oldest first), level1.., total."""
    rows = articles.filter("date is not null and source is not null").select("source", iso_week(F.col("date")).alias("week"))
    place = rows.select("week").distinct().orderBy(F.desc("week")).limit(weeks)
    place = place.select("week", (weeks + 1 - F.row_number().over(W.orderBy(F.desc("week")))).alias("place"))
    counts = rows.join(place, "week", "left").groupBy("source").agg(*[F.count_if(F.col("place") == k).alias(f"n{k}") for k in range(1, weeks + 1)])
    total = sum((F.col(f"n{k}") for k in range(2, weeks + 1)), F.col("n1"))
    return counts.select("source", *[f"n{k}" for k in range(1, weeks + 1)], *[heat_level(F.col(f"n{k}")).alias(f"level{k}") for k in range(1, weeks + 1)], total.alias("total"))


def dense(trends: DataFrame) -> DataFrame:
    """week, keyword, points, back for every week and keyword that occur, absent ones as 0; back is 1 for the last.

    Trends have a few weeks of a few keywords each by construction, so the grid is small.
    """
    week = trends.select("week").distinct()
    week = week.select("week", F.row_number().over(W.orderBy(F.desc("week"))).alias("back"))
    grid = week.crossJoin(trends.select("keyword").distinct())
    return grid.join(trends, ["week", "keyword"], "left").select("week", "keyword", F.coalesce("points", F.lit(0)).alias("points"), "back")


def history(trends: DataFrame, back: int = 4) -> DataFrame:
    """keyword, p1 (last week) to p``back``, older (in any week before the last two), weeks."""
    d = dense(trends)
    return d.groupBy("keyword").agg(
        *[F.coalesce(F.max(F.when(F.col("back") == k, F.col("points"))), F.lit(0)).alias(f"p{k}") for k in range(1, back + 1)],
        F.coalesce(F.max((F.col("back") > 2) & (F.col("points") > 0)), F.lit(False)).alias("older"),
        F.max("back").alias("weeks"),
        F.sum("points").alias("total"),
    )


def surges(trends: DataFrame, in_progress: bool = False) -> DataFrame:
    """keyword, kind, now, before, percent: new and surging keywords of the last week, falling ones.

    new: 0 before and at least 2 now. surging: at least twice as many. falling: at least 2 before and less than
    half now; while the last week is ``in_progress``, the two weeks before it are compared for falls.
    """
    h = history(trends).filter("weeks >= 2")
    now, before = F.col("p1"), F.col("p2")
    shift = in_progress & (F.col("weeks") >= 3) if isinstance(in_progress, Column) else F.lit(in_progress) & (F.col("weeks") >= 3)
    fall_now, fall_before = F.when(shift, F.col("p2")).otherwise(now), F.when(shift, F.col("p3")).otherwise(before)
    percent = lambda a, b: F.when(b > 0, half_up((a / b - 1) * 100))
    up = h.filter(((before == 0) & (now >= 2)) | ((before > 0) & (now >= 2 * before)))
    up = up.select("keyword", F.when(before == 0, "new").otherwise("surging").alias("kind"), now.alias("now"), before.alias("before"), percent(now, before).alias("percent"))
    down = h.select("keyword", F.lit("falling").alias("kind"), fall_now.alias("now"), fall_before.alias("before")).filter("before >= 2 and now * 2 < before")
    return up.unionByName(down.withColumn("percent", percent(F.col("now"), F.col("before"))))


def signals(trends: DataFrame, articles: DataFrame, today: Column, days: int = 8, sources: int = 3) -> DataFrame:
    """keyword, kind, value.

    growth: more points in each of the last three weeks, from above zero (value: the last). new: absent from all weeks
    but the last two, with at least 3 now. cross: in no other signal, and named by at least ``sources`` sources
    within ``days`` days (value: sources).
    """
    h = history(trends)
    growth = h.filter("weeks >= 3 and p3 > 0 and p2 > p3 and p1 > p2").select("keyword", F.lit("growth").alias("kind"), F.col("p1").alias("value"))
    new = h.filter("weeks >= 2 and not older and p1 >= 3").select("keyword", F.lit("new").alias("kind"), F.col("p1").alias("value"))
    found = growth.unionByName(new)
    recent = articles.filter(F.col("date") >= F.date_sub(today, days)).select("source", F.explode("keywords").alias("keyword"))
    cross = recent.groupBy("keyword").agg(F.countDistinct("source").alias("value")).filter(F.col("value") >= sources)
    cross = cross.join(found.select("keyword"), "keyword", "left_anti").select("keyword", F.lit("cross").alias("kind"), "value")
    return found.unionByName(cross)


def trend_labels(trends: DataFrame) -> DataFrame:
    """keyword, label, total: the mean of the last two weeks against the two before (0 where there are none)."""
    h = history(trends)
    now = (F.col("p1") + F.col("p2")) / 2
    before = F.when(F.col("weeks") >= 4, (F.col("p3") + F.col("p4")) / 2).when(F.col("weeks") == 3, F.col("p3").cast("double")).otherwise(0.0)
    label = F.when(now > before * 1.3, "up").when(now > before, "slightly up").when(now < before * 0.7, "down").when(now < before, "slightly down").otherwise("flat")
    return h.filter("weeks >= 2").select("keyword", label.alias("label"), "total")


def cutoff(today: Column, span: str) -> Column:
    """The first date of '1w', '1m' or '3m' back; null for 'all'."""
    if span == "1w":
        return F.date_sub(today, 7)
    return F.lit(None).cast("date") if span == "all" else F.add_months(today, -int(span[0])).cast("date")


def filtered(articles: DataFrame, source: str | None = None, kind: str | None = None, since: Column | None = None, text: str | None = None) -> DataFrame:
    """Articles of a source and type, dated at ``since`` or later, with ``text`` in title or summary."""
    out = articles
    if source is not None:
        out = out.filter(F.col("source") == source)
    if kind is not None:
        out = out.filter(F.col("source_type") == kind)
    if since is not None:
        out = out.filter(since.isNull() | (F.col("date") >= since))
    if text:
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", "title", "summary")), F.lit(text.lower())))
    return out


def newest(articles: DataFrame, keyword: str, top: int = 20, ties: Sequence[str] = ()) -> DataFrame:
    """The newest articles with a keyword, undated ones last, then by link and by the columns of ``ties``."""
    return articles.filter(F.array_contains("keywords", keyword)).orderBy(F.desc_nulls_last("date"), "link", *ties).limit(top)


def in_order(articles: DataFrame) -> DataFrame:
    """The archive newest first, undated articles last."""
    return articles.orderBy(F.desc_nulls_last("date"), "link")


def strongest_surges(surging: DataFrame, top: int = 6) -> DataFrame:
    """place, keyword, kind, percent: the new and surging keywords that grew most, new ones by their count now."""
    rows = surging.filter(F.col("kind") != "falling")
    best = [F.desc_nulls_first("percent"), F.desc("now"), F.col("keyword")]
    return rows.orderBy(*best).limit(top).select("keyword", "kind", "now", "percent")
