"""Queries of the ranked-snapshot report."""

from __future__ import annotations

from galley.operators import snapshots as ops
from galley.plans import standin
from galley.plans.standin import NO_TOPIC, OWN, SNAPSHOTS, TOPICS

#: Bounds for the invented prices (27,000 to 30,000).
BINS = ((27500.0, "to 27.5"), (28000.0, "27.5 to 28"), (29000.0, "28 to 29"))


def _on_stats(f):
    return lambda spark, sf_dir: f(ops.title_stats(standin.snapshots(spark, sf_dir)))


def _on_snaps(f):
    return lambda spark, sf_dir: f(standin.snapshots(spark, sf_dir))


QUERIES = {
    "s1_topic_table": _on_stats(lambda s: ops.topic_table(s, TOPICS, NO_TOPIC)),
    "s1_title_stats": _on_stats(lambda s: s),
    "s1_totals": _on_snaps(ops.totals),
    "s1_publisher_titles": _on_stats(ops.publisher_titles),
    "s1_publisher_share": _on_stats(ops.publisher_share),
    "s1_price_histogram": _on_stats(lambda s: ops.price_histogram(s, BINS, "from 29")),
    "s1_price_histogram_bounded": _on_stats(lambda s: ops.price_histogram(s, BINS, "from 29", least=0, below=29500)),
    "s1_new_by_month": _on_stats(ops.new_by_month),
    "s1_topic_rank_trend": _on_snaps(lambda s: ops.topic_rank_trend(s, TOPICS, NO_TOPIC)),
    "s1_topic_publishers": _on_stats(lambda s: ops.topic_publishers(s, TOPICS, NO_TOPIC)),
    "s1_rising_titles": _on_stats(lambda s: ops.rising_titles(s, least=2)),
    "s1_long_sellers": _on_stats(lambda s: ops.long_sellers(s.withColumn("n_dates", s["n_dates"] / 50))),
    "s1_new_entrants": _on_stats(lambda s: ops.new_entrants(s, back=2400)),
    "s1_own_topics": _on_stats(lambda s: ops.own_topics(s, OWN, TOPICS, NO_TOPIC)),
    "s1_own_books": _on_stats(lambda s: ops.own_books(s, OWN)),
    "s1_topic_competition": _on_stats(lambda s: ops.topic_competition(s, TOPICS, NO_TOPIC)),
    "s1_insights": _on_stats(lambda s: ops.insights(s, TOPICS, NO_TOPIC)),
    "s1_new_dates": lambda spark, sf_dir: ops.new_dates(standin.snapshots(spark, sf_dir), standin.snapshots(spark, sf_dir).filter("month(date) <> 3")),
}

_TABLE = """
tt AS (SELECT topic, count(*) AS titles, coalesce(sum(rank_sum) / sum(n_ranks), 0.0) AS mean_rank, sum(days) / count(*) AS mean_days,
         sum(in_recent)::BIGINT AS recent_titles, sum(in_previous)::BIGINT AS previous_titles,
         CASE WHEN max(n_dates) >= 60 AND sum(in_recent) * 10 > sum(in_previous) * 11 THEN 'up'
              WHEN max(n_dates) >= 60 AND sum(in_recent) * 10 < sum(in_previous) * 9 THEN 'down' ELSE 'flat' END AS trend
       FROM tp GROUP BY topic)"""
_BIN = "CASE WHEN price < 27500 THEN 'to 27.5' WHEN price < 28000 THEN '27.5 to 28' WHEN price < 29000 THEN '28 to 29' ELSE 'from 29' END"
_SHARE = "SELECT publisher, sum(days)::BIGINT AS days, sum(days) * 100.0::DOUBLE / sum(sum(days)) OVER () AS share FROM st WHERE publisher <> '' GROUP BY publisher"

_BODIES = {
    "s1_topic_table": (_TABLE, "SELECT * FROM tt"),
    "s1_title_stats": ("", "SELECT * FROM st"),
    "s1_totals": ("", "SELECT count(*) AS records, count(DISTINCT title) AS titles, count(DISTINCT date) AS days FROM snaps"),
    "s1_publisher_titles": ("", "SELECT publisher, count(*) AS titles FROM st GROUP BY publisher ORDER BY titles DESC, publisher LIMIT 20"),
    "s1_publisher_share": ("", _SHARE),
    "s1_price_histogram": ("", f"SELECT {_BIN} AS bin, count(*) AS titles, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM st GROUP BY 1"),
    "s1_price_histogram_bounded": ("", f"SELECT {_BIN} AS bin, count(*) AS titles, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM st WHERE price > 0 AND price < 29500 GROUP BY 1"),
    "s1_new_by_month": ("", "SELECT date_trunc('month', first_date)::DATE AS month, count(*) AS titles FROM st GROUP BY 1"),
    "s1_topic_rank_trend": (
        f"""l AS (SELECT max(date) AS last FROM snaps),
        x AS (SELECT *, unnest(CASE WHEN len(l) > 0 THEN l ELSE ['{NO_TOPIC}'] END) AS topic FROM (SELECT *, {standin._topics_sql()} AS l FROM snaps)),
        m AS (SELECT topic, avg(rank) FILTER (date >= last - 30) AS recent_mean, avg(rank) FILTER (date < last - 30) AS previous_mean FROM x, l WHERE date >= last - 60 GROUP BY topic)""",
        "SELECT *, CASE WHEN previous_mean - recent_mean > 3 THEN 'up' WHEN recent_mean - previous_mean > 3 THEN 'down' WHEN recent_mean - previous_mean IS NOT NULL THEN 'flat' END AS trend FROM m",
    ),
    "s1_topic_publishers": ("", "SELECT topic, publisher, count(*) AS titles, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, publisher)::INTEGER AS place FROM tp WHERE publisher <> '' GROUP BY topic, publisher QUALIFY place <= 5"),
    "s1_rising_titles": ("", "SELECT title, publisher, recent_mean, previous_mean, previous_mean - recent_mean AS gain FROM st WHERE previous_mean - recent_mean >= 2 AND recent_mean <= 30 ORDER BY gain DESC, title LIMIT 15"),
    "s1_long_sellers": ("", "SELECT title, publisher, days, coalesce(rank_sum / n_ranks, 0.0) AS mean_rank FROM st WHERE days >= CASE WHEN n_dates / 50 >= 100 THEN 100 ELSE greatest(floor(n_dates / 50 * 7 / 10), 10) END ORDER BY days DESC, title LIMIT 20"),
    "s1_new_entrants": ("", "SELECT title, publisher, first_date, best_rank, days FROM st WHERE first_back <= 2400 AND days >= 2 AND best_rank <= 30 ORDER BY best_rank, days DESC, title LIMIT 20"),
    "s1_own_topics": ("", f"SELECT topic, sum(contains(publisher, '{OWN}')::INTEGER)::BIGINT AS own, count(*) AS market, sum(contains(publisher, '{OWN}')::INTEGER) <= 1 AND count(*) >= 5 AS weak FROM tp GROUP BY topic"),
    "s1_own_books": ("", f"SELECT title, coalesce(rank_sum / n_ranks, 999.0) AS mean_rank, days FROM st WHERE contains(publisher, '{OWN}')"),
    "s1_topic_competition": ("", f"SELECT topic, title, publisher, coalesce(rank_sum / n_ranks, 999.0) AS mean_rank, days, row_number() OVER (PARTITION BY topic ORDER BY coalesce(rank_sum / n_ranks, 999.0), title)::INTEGER AS place FROM tp WHERE topic <> '{NO_TOPIC}' QUALIFY place <= 10"),
    "s1_insights": (
        _TABLE + f", sh AS ({_SHARE})",
        """SELECT * FROM (SELECT 'largest topic' AS kind, topic AS name, titles::DOUBLE AS value FROM tt ORDER BY titles DESC, topic LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 'rising topic', topic, titles::DOUBLE FROM tt WHERE trend = 'up' ORDER BY titles DESC, topic LIMIT 3)
        UNION ALL SELECT * FROM (SELECT 'publisher share', publisher, share FROM sh ORDER BY days DESC, publisher LIMIT 2)
        UNION ALL SELECT * FROM (SELECT 'longest seller', title, days::DOUBLE FROM st WHERE days >= greatest(n_dates // 2, 10) ORDER BY days DESC, title LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 'best new title', title, best_rank::DOUBLE FROM st WHERE first_back <= 60 AND days >= 3 AND best_rank <= 30 ORDER BY best_rank, title LIMIT 1)""",
    ),
    "s1_new_dates": ("", "SELECT * FROM snaps WHERE month(date) = 3"),
}

ORACLES = {name: f"WITH {SNAPSHOTS}{',' if more.strip() else ''}{more} {body}" for name, (more, body) in _BODIES.items()}
