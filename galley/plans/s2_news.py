"""Queries of the news archive and its weekly trends; articles are derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.functions import fixed
from galley.functions.dictionary import has_signal, keyword_labels
from galley.operators import news as ops
from galley.session import table

KINDS = ("vendor", "media", "corp", "community")
TODAY = "2024-01-30"
_today = lambda: F.lit(TODAY).cast("date")
#: Parts of the stand-in titles.
PARTS = {"click": "Click", "view": "View", "err": "Error", "pur": "Purchase", "sign": "Account"}


def feeds(spark):
    """id, source_type, weight of twenty sources; one more is unknown to it."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("n") % 4 + 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(fixed.TYPE_WEIGHTS[k]) for k in KINDS]), (F.col("n") % 4 + 1).cast("int"))
    return spark.range(20).withColumnRenamed("id", "n").select(F.concat(F.lit("s"), F.col("n").cast("string")).alias("id"), kind.alias("source_type"), weight.alias("weight"))


def articles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    return e.select(
        "event_id",
        F.concat(F.lit("https://n.example/"), (F.col("event_id") * 7 % 3001).cast("string")).alias("link"),
        F.concat(F.lit("s"), (F.col("user_id") % 21).cast("string")).alias("source"),
        F.when(F.col("event_id") % 3 == 0, F.element_at(F.array(*map(F.lit, KINDS)), (F.col("user_id") % 4 + 1).cast("int"))).alias("source_type"),
        F.concat(F.lit("New "), F.col("event_type"), F.lit(" release")).alias("title"),
        F.concat(F.lit("data k"), k.cast("string")).alias("summary"),
        F.to_date("ts").alias("date"),
        F.to_date("ts").alias("first_seen"),
        F.array(F.col("event_type"), F.concat(F.lit("k"), (k % 9 + F.dayofmonth("ts") % 3).cast("string"))).alias("keywords"),
    )


def _trends(f):
    return lambda spark, sf_dir: f(ops.weekly_trends(articles(spark, sf_dir), feeds(spark)))


def _both(f):
    def query(spark, sf_dir):
        a = articles(spark, sf_dir)
        return f(ops.weekly_trends(a, feeds(spark)), a)

    return query


def _articles(f):
    return lambda spark, sf_dir: f(articles(spark, sf_dir))


def _merge(spark, sf_dir):
    a = articles(spark, sf_dir).select("event_id", "link", "source", "date")
    old = ops.merge_new(spark.createDataFrame([], "id string, event_id long, link string, source string, date date"), a.filter(F.col("date") < "2024-01-10"), ["event_id"])
    return ops.merge_new(old, a.filter(F.col("date") >= "2024-01-10"), ["event_id"])


def _merged_feeds(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("title", F.concat_ws(" ", "title", "event_id")).select("source", "link", "title")
    split = F.xxhash64("title") * 0 + F.length("title") % 2
    return ops.merged_feeds(a.filter(split == 0), a.filter(split == 1))


QUERIES = {
    "s2_merge_new": _merge,
    "s2_merged_feeds": _merged_feeds,
    "s2_with_type": lambda spark, sf_dir: ops.with_type(articles(spark, sf_dir), feeds(spark)).select("event_id", "source", "source_type"),
    "s2_weekly_trends": _trends(lambda t: t),
    "s2_source_stats": _articles(lambda a: ops.source_stats(a, _today())),
    "s2_daily_stats": _articles(lambda a: ops.daily_stats(a, 20)),
    "s2_weekly_counts": _articles(ops.weekly_counts),
    "s2_keyword_counts": _articles(ops.keyword_counts),
    "s2_heatmap": _articles(ops.heatmap),
    "s2_surges": _trends(ops.surges),
    "s2_surges_in_progress": _trends(lambda t: ops.surges(t, True)),
    "s2_signals": _both(lambda t, a: ops.signals(t, a, _today())),
    "s2_trend_labels": _trends(ops.trend_labels),
    "s2_filtered": _articles(lambda a: ops.filtered(a, kind="corp", since=ops.cutoff(_today(), "1w"), text="VIEW rel").select("event_id", "source", "date")),
    "s2_newest": _articles(lambda a: ops.newest(a, "purchase", ties=("event_id",)).select("event_id", "link", "date")),
    "s2_keyword_labels": _articles(lambda a: a.select("event_id", F.array_join(keyword_labels(F.concat_ws(" ", "title", "summary"), PARTS), "|").alias("labels"))),
    "s2_signal_titles": _articles(lambda a: a.filter(has_signal(F.col("title"), ("signup release",), fixed.WEAK_SIGNALS, ("view", "error"))).groupBy("title").agg(F.count("*").alias("n"))),
}

_KIND = "['vendor', 'media', 'corp', 'community']"
_A = f"""a0 AS (SELECT *, coalesce(json_extract_string(props, '$.k')::INTEGER, 0) AS k FROM events),
a AS (SELECT event_id, 'https://n.example/' || (event_id * 7 % 3001) AS link, 's' || (user_id % 21) AS source,
        CASE WHEN event_id % 3 = 0 THEN {_KIND}[user_id % 4 + 1] END AS source_type, 'New ' || event_type || ' release' AS title, 'data k' || k AS summary,
        ts::DATE AS date, ts::DATE AS first_seen, [event_type, 'k' || (k % 9 + day(ts) % 3)] AS keywords, isoyear(ts) || '-W' || lpad(weekofyear(ts)::VARCHAR, 2, '0') AS week FROM a0),
f AS (SELECT 's' || n AS source, {_KIND}[n % 4 + 1] AS ftype, [0.5::DOUBLE, 1.0, 1.5, 2.0][n % 4 + 1] AS weight FROM range(20) r(n))"""
_T = f"""{_A},
g AS (SELECT week, unnest(keywords) AS keyword, a.source, coalesce(weight, 1.0::DOUBLE) AS w FROM a LEFT JOIN f USING (source)),
g2 AS (SELECT week, keyword, source, sum(w) AS w FROM g GROUP BY ALL),
g3 AS (SELECT week, keyword, least(w, 0.5 * sum(w) OVER (PARTITION BY week, keyword)) AS part FROM g2),
g4 AS (SELECT week, keyword, round_even(sum(part), 0)::BIGINT AS points FROM g3 GROUP BY ALL),
tr AS (SELECT * FROM g4 WHERE points > 0 AND week IN (SELECT DISTINCT week FROM g4 ORDER BY week DESC LIMIT 8)
       QUALIFY row_number() OVER (PARTITION BY week ORDER BY points DESC, keyword) <= 15)"""
_H = f"""{_T},
wk AS (SELECT week, row_number() OVER (ORDER BY week DESC) AS back FROM (SELECT DISTINCT week FROM tr)),
h AS (SELECT keyword, coalesce(max(points) FILTER (back = 1), 0) AS p1, coalesce(max(points) FILTER (back = 2), 0) AS p2, coalesce(max(points) FILTER (back = 3), 0) AS p3,
        coalesce(max(points) FILTER (back = 4), 0) AS p4, count(*) FILTER (back > 2) > 0 AS older, (SELECT count(*) FROM wk) AS weeks, sum(points)::BIGINT AS total FROM tr JOIN wk USING (week) GROUP BY keyword)"""


def _surges(now: str, before: str) -> str:
    return f"""SELECT keyword, CASE WHEN p2 = 0 THEN 'new' ELSE 'surging' END AS kind, p1 AS now, p2 AS before, CASE WHEN p2 > 0 THEN floor((p1 / p2 - 1) * 100 + 0.5)::BIGINT END AS percent
    FROM h WHERE (p2 = 0 AND p1 >= 2) OR (p2 > 0 AND p1 >= 2 * p2)
    UNION ALL SELECT keyword, 'falling', {now}, {before}, floor(({now} / {before} - 1) * 100 + 0.5)::BIGINT FROM h WHERE {before} >= 2 AND {now} * 2 < {before}"""


_HEAT = ", ".join(f"count(*) FILTER (back = {5 - k}) AS n{k}" for k in range(1, 5))
_LEVEL = ", ".join(f"CASE WHEN n{k} = 0 THEN 0 WHEN n{k} <= 2 THEN 1 WHEN n{k} <= 5 THEN 2 WHEN n{k} <= 10 THEN 3 ELSE 4 END AS level{k}" for k in range(1, 5))
_LABELS = ", ".join(f"CASE WHEN contains(x, '{p}') THEN '{v}' END" for p, v in PARTS.items())

ORACLES = {
    "s2_merge_new": f"""WITH {_A}, x AS (SELECT substr(md5(link), 1, 12) AS id, event_id, link, source, date, date >= DATE '2024-01-10' AS late FROM a)
        SELECT id, event_id, link, source, date FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY late, event_id) = 1""",
    "s2_merged_feeds": f"""WITH {_A}, x AS (SELECT source, link, title || ' ' || event_id AS title FROM a)
        SELECT source, link, title FROM x QUALIFY row_number() OVER (PARTITION BY source, link ORDER BY len(title) % 2, title) = 1""",
    "s2_with_type": f"WITH {_A} SELECT event_id, a.source, coalesce(source_type, ftype, 'media') AS source_type FROM a LEFT JOIN f USING (source)",
    "s2_weekly_trends": f"WITH {_T} SELECT * FROM tr",
    "s2_source_stats": f"WITH {_A} SELECT source, count(*) AS total, count(*) FILTER (first_seen >= DATE '2024-01-01') AS month_to_date, count(*) FILTER (first_seen >= DATE '{TODAY}' - 7) AS last_7_days FROM a GROUP BY source",
    "s2_daily_stats": f"WITH {_A} SELECT first_seen AS date, count(*) AS articles FROM a GROUP BY 1 ORDER BY 1 DESC LIMIT 20",
    "s2_weekly_counts": f"WITH {_A} SELECT week, count(*) AS articles, lag(count(*)) OVER (ORDER BY week) AS before FROM a GROUP BY week",
    "s2_keyword_counts": f"WITH {_A} SELECT keyword, count(*) AS articles FROM (SELECT unnest(keywords) AS keyword FROM a) GROUP BY 1",
    "s2_heatmap": f"""WITH {_A}, wk AS (SELECT week, row_number() OVER (ORDER BY week DESC) AS back FROM (SELECT DISTINCT week FROM a)),
        n AS (SELECT source, {_HEAT} FROM a JOIN wk USING (week) GROUP BY source) SELECT source, n1, n2, n3, n4, {_LEVEL}, n1 + n2 + n3 + n4 AS total FROM n""",
    "s2_surges": f"WITH {_H} {_surges('p1', 'p2')}",
    "s2_surges_in_progress": f"WITH {_H} {_surges('p2', 'p3')}",
    "s2_signals": f"""WITH {_H}, s AS (SELECT keyword, 'growth' AS kind, p1 AS value FROM h WHERE weeks >= 3 AND p3 > 0 AND p2 > p3 AND p1 > p2
          UNION ALL SELECT keyword, 'new', p1 FROM h WHERE weeks >= 2 AND NOT older AND p1 >= 3),
        c AS (SELECT keyword, count(DISTINCT source) AS value FROM (SELECT source, unnest(keywords) AS keyword FROM a WHERE date >= DATE '{TODAY}' - 8) GROUP BY 1 HAVING value >= 3)
        SELECT * FROM s UNION ALL SELECT keyword, 'cross', value FROM c WHERE keyword NOT IN (SELECT keyword FROM s)""",
    "s2_trend_labels": f"""WITH {_H}, x AS (SELECT keyword, total, (p1 + p2) / 2 AS n, (p3 + p4) / 2 AS b FROM h)
        SELECT keyword, CASE WHEN n > b * 1.3::DOUBLE THEN 'up' WHEN n > b THEN 'slightly up' WHEN n < b * 0.7::DOUBLE THEN 'down' WHEN n < b THEN 'slightly down' ELSE 'flat' END AS label, total FROM x""",
    "s2_filtered": f"WITH {_A} SELECT event_id, source, date FROM a WHERE source_type = 'corp' AND date >= DATE '{TODAY}' - 7 AND contains(lower(title || ' ' || summary), 'view rel')",
    "s2_newest": f"WITH {_A} SELECT event_id, link, date FROM a WHERE list_contains(keywords, 'purchase') ORDER BY date DESC, link LIMIT 20",
    "s2_keyword_labels": f"WITH {_A}, b AS (SELECT event_id, lower(title || ' ' || summary) AS x FROM a) SELECT event_id, coalesce(array_to_string(list_sort(list_distinct(list_filter([{_LABELS}], lambda y: y IS NOT NULL))), '|'), '') AS labels FROM b",
    "s2_signal_titles": f"WITH {_A} SELECT title, count(*) AS n FROM a WHERE contains(lower(title), 'signup release') OR contains(lower(title), 'view') OR contains(lower(title), 'error') GROUP BY title",
}
