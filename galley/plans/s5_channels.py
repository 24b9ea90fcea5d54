"""Queries of channel scorecards, keyword velocity and the planning board: customers are channels, orders videos."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.operators import authors, board, channels as ops, snapshots, velocity
from galley.plans import s2_news, s3_authors, standin
from galley.plans.standin import SNAPSHOTS, TOPICS
from galley.session import table

NOW = "2001-09-01"
_now = lambda: F.lit(NOW).cast("date")
RISKS = {"urgent": ("urgent", "asap"), "low": ("low",)}


def videos(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    views = F.floor("o_totalprice").cast("long")
    title = F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.concat(F.lower("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, " part 2 강의").otherwise(" talk")))
    return o.select(
        F.col("o_orderkey").alias("video_id"),
        F.col("o_custkey").alias("channel_id"),
        title.alias("title"),
        F.repeat(F.lit("urgent text "), (F.col("o_orderkey") % 40).cast("int")).alias("description"),
        F.to_date("o_orderdate").alias("published"),
        views.alias("views"),
        F.floor(views / (10 + F.col("o_orderkey") % 500)).cast("long").alias("likes"),
        F.floor(views / (100 + F.col("o_orderkey") % 5000)).cast("long").alias("comments"),
        F.concat_ws("|", F.lit("it"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)), "o_orderstatus").alias("path"),
    )


def channels(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    subs = F.floor(F.greatest("c_acctbal", F.lit(0.0)) * 40).cast("long")
    return c.select(
        F.col("c_custkey").alias("channel_id"),
        F.concat(F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 4 == 0, " 채널").otherwise(" channel")).alias("title"),
        F.concat(F.lower("c_mktsegment"), F.lit(" tools and "), F.lower("c_mktsegment")).alias("description"),
        F.when(F.col("c_nationkey") == 7, "KR").otherwise("US").alias("country"),
        F.date_sub(_now(), (F.col("c_custkey") % 2000).cast("int")).alias("published"),
        subs.alias("subs"),
        (subs * (F.col("c_custkey") % 50)).alias("views"),
        (F.col("c_custkey") % 60).cast("long").alias("video_count"),
    )


def _relevance(spark, sf_dir):
    hits = ops.hit_counts(videos(spark, sf_dir), "talk", F.date_sub(_now(), 90))
    c = ops.with_statistics(channels(spark, sf_dir), hits, "channel_id", ["appearances", "title_matches", "recent_matches"])
    return c.withColumn("direct", F.col("channel_id") % 10 == 0).select("channel_id", ops.relevance("building tools").alias("relevance"))


def _stop(spark):
    return spark.createDataFrame([("Talk",), ("part",)], "word string")


def _best(spark, sf_dir):
    v = videos(spark, sf_dir)
    return velocity.best_videos(v.unionByName(v.filter("video_id % 5 = 0")), _now())


def _cards(spark):
    rows = [("it|p1|F", "preempt", 0), ("it|p2|O", "preempt", 2), ("it|p3|P", "hook", 0), ("it|p9|P", "preempt", 0), ("it|p4|P", "preempt", 1)]
    return spark.createDataFrame(rows, "path string, pick string, n_books int")


def _trend_lag(spark, sf_dir):
    s = standin.snapshots(spark, sf_dir)
    a = s2_news.articles(spark, sf_dir).withColumn("keywords", F.concat("keywords", F.array(F.lit("Blue"), F.lit("rod"))))
    return board.trend_lag(board.new_titles(s, 2450), board.old_keywords(a, F.lit("2024-05-01").cast("date"), 90, 120))


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


QUERIES = {
    "s5_hit_counts": lambda spark, sf_dir: ops.hit_counts(videos(spark, sf_dir), "Talk", F.date_sub(_now(), 300)),
    "s5_video_sums": lambda spark, sf_dir: ops.video_sums(videos(spark, sf_dir)),
    "s5_content_quality": lambda spark, sf_dir: ops.content_quality(ops.video_sums(videos(spark, sf_dir))),
    "s5_publish_score": lambda spark, sf_dir: ops.publish_score(channels(spark, sf_dir), ops.video_sums(videos(spark, sf_dir)), _now()),
    "s5_relevance": _relevance,
    "s5_rising": lambda spark, sf_dir: ops.rising(channels(spark, sf_dir), _now()),
    "s5_similar": lambda spark, sf_dir: channels(spark, sf_dir).select("channel_id", ops.similar_score(F.col("video_count"), F.col("subs")).alias("similar")),
    "s5_top_tokens": lambda spark, sf_dir: ops.top_tokens(videos(spark, sf_dir), _stop(spark)),
    "s5_keyword_ranking": lambda spark, sf_dir: ops.keyword_ranking(videos(spark, sf_dir), ["talk", "part 2", "high", "none"]),
    "s5_merged_searches": lambda spark, sf_dir: ops.merged_searches(*[videos(spark, sf_dir).filter(f"video_id % {k} = 0").withColumn("title", F.concat("title", F.lit(str(k)))) for k in (2, 3)]).select("video_id", "title"),
    "s6_best_videos": lambda spark, sf_dir: _best(spark, sf_dir).select("path", "video_id", "per_day", "place"),
    "s6_leaf_stats": lambda spark, sf_dir: velocity.leaf_stats(_best(spark, sf_dir), _now(), 200),
    "s6_checked_picks": lambda spark, sf_dir: velocity.checked_picks(_cards(spark), velocity.leaf_stats(_best(spark, sf_dir), _now(), 200)),
    "s6_summary": lambda spark, sf_dir: velocity.summary(velocity.checked_picks(_cards(spark), velocity.leaf_stats(_best(spark, sf_dir), _now(), 200))),
    "s6_path_nodes": lambda spark, sf_dir: velocity.path_nodes(videos(spark, sf_dir)),
    "s6_competing_books": lambda spark, sf_dir: velocity.competing_books(spark.createDataFrame([("a", "Blue rod, x"), ("b", "Gizmo!")], "path string, keyword string"), snapshots.title_stats(standin.snapshots(spark, sf_dir)).withColumn("rank", F.col("best_rank"))),
    "s12_new_titles": lambda spark, sf_dir: board.new_titles(standin.snapshots(spark, sf_dir), 2450),
    "s12_trend_lag": _trend_lag,
    "s12_within_budget": lambda spark, sf_dir: board.within_budget(_pages(spark, sf_dir), ["conv_id"], [F.desc("turn")], F.length("text"), 3000).select("conv_id", "turn", "running"),
    "s12_top_topics": lambda spark, sf_dir: board.top_topics(authors.author_mart(authors.books(s3_authors._snaps(spark, sf_dir)), TOPICS)).select("name", F.array_join("titles", "|").alias("titles"), F.array_join("topics", "|").alias("topics")),
    "s12_risk_flags": lambda spark, sf_dir: videos(spark, sf_dir).select("video_id", F.array_join(board.risk_flags(F.concat_ws(" ", "title", "description"), RISKS), "|").alias("risks")),
    "s12_upserted": lambda spark, sf_dir: board.upserted(*[table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").filter(f"o_orderkey % 2 = {k}") for k in (0, 1)], "o_custkey", "o_orderkey"),
}

_V = """v AS (SELECT o_orderkey AS video_id, o_custkey AS channel_id,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE lower(o_orderpriority) || CASE WHEN o_orderkey % 3 = 0 THEN ' part 2 강의' ELSE ' talk' END END AS title,
  repeat('urgent text ', (o_orderkey % 40)::INTEGER) AS description, o_orderdate::DATE AS published, floor(o_totalprice)::BIGINT AS views,
  floor(floor(o_totalprice)::BIGINT / (10 + o_orderkey % 500))::BIGINT AS likes, floor(floor(o_totalprice)::BIGINT / (100 + o_orderkey % 5000))::BIGINT AS comments,
  'it|p' || substr(o_orderpriority, 1, 1) || '|' || o_orderstatus AS path FROM orders)"""
_CH = f"""ch AS (SELECT c_custkey AS channel_id, lower(c_mktsegment) || CASE WHEN c_custkey % 4 = 0 THEN ' 채널' ELSE ' channel' END AS title, lower(c_mktsegment) || ' tools and ' || lower(c_mktsegment) AS description,
  CASE WHEN c_nationkey = 7 THEN 'KR' ELSE 'US' END AS country, (c_custkey % 2000)::INTEGER AS age_days, floor(greatest(c_acctbal, 0.0) * 40)::BIGINT AS subs,
  floor(greatest(c_acctbal, 0.0) * 40)::BIGINT * (c_custkey % 50) AS views, c_custkey % 60 AS video_count FROM customer)"""
_HITS = "SELECT channel_id, count(*) AS appearances, count(*) FILTER (contains(title, 'talk')) AS title_matches, count(*) FILTER (contains(title, 'talk') AND published >= DATE '{now}' - {days}) AS recent_matches, bool_or(contains(title, '강의')) AS korean FROM v GROUP BY channel_id"
_SUMS = """vs AS (SELECT channel_id, count(*) AS n, sum(views)::BIGINT AS views, sum(likes)::BIGINT AS likes, sum(comments)::BIGINT AS comments, avg(len(description)) AS mean_description,
  coalesce(avg(len(title)) FILTER (title <> ''), 0.0) AS mean_title, floor(count(*) FILTER (len(description) >= 200) * 100 / count(*) + 0.5)::BIGINT AS long_descriptions,
  coalesce(floor(count(*) FILTER (regexp_matches(title, 'part\\.?\\s*[0-9]+|강의')) * 100 / nullif(count(*) FILTER (title <> ''), 0) + 0.5), 0)::BIGINT AS series FROM v GROUP BY channel_id)"""


def _ladder(value: str, steps, otherwise) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {a} THEN {b}" for a, b in steps) + f" ELSE {otherwise} END"


_BEST = f"""{_V}, v2 AS (SELECT path, video_id, published, views, floor(views / greatest(DATE '{NOW}' - published, 1) + 0.5)::BIGINT AS per_day FROM v),
b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY per_day DESC, video_id)::INTEGER AS place FROM v2 QUALIFY place <= 100)"""
_LEAF = f"""{_BEST}, l0 AS (SELECT path, count(*) AS n, sum(views)::BIGINT AS views, floor(avg(per_day) + 0.5)::BIGINT AS mean_per_day, coalesce(avg(per_day) FILTER (published >= DATE '{NOW}' - 200), 0.0) AS r,
  coalesce(avg(per_day) FILTER (published < DATE '{NOW}' - 200), 0.0) AS o, count(*) FILTER (published >= DATE '{NOW}' - 200) AS n_recent, sum(per_day)::BIGINT AS sum_per_day FROM b GROUP BY path),
l1 AS (SELECT *, floor(r + 0.5)::BIGINT AS recent_per_day, floor(o + 0.5)::BIGINT AS older_per_day FROM l0),
l2 AS (SELECT *, CASE WHEN older_per_day > 0 THEN floor(recent_per_day / older_per_day * 10 + 0.5) / 10 WHEN n_recent > 0 THEN 99.0 ELSE 0.0 END::DOUBLE AS ratio FROM l1),
l AS (SELECT path, n, views, mean_per_day, sum_per_day, recent_per_day, older_per_day, ratio, CASE WHEN ratio >= 3 THEN 'surging' WHEN ratio >= 1.5 THEN 'up' END AS label, r > 0 AND (o = 0 OR r >= o * 1.5::DOUBLE) AS rising FROM l2)"""
_PICKS = f"""{_LEAF}, cd(path, pick, n_books) AS (VALUES ('it|p1|F', 'preempt', 0), ('it|p2|O', 'preempt', 2), ('it|p3|P', 'hook', 0), ('it|p9|P', 'preempt', 0), ('it|p4|P', 'preempt', 1)),
k AS (SELECT path, n_books, pick = 'preempt' AND (n_books > 1 OR (NOT coalesce(rising, false) AND coalesce(sum_per_day, 0) < 500)) AS downgraded, pick AS p0 FROM cd LEFT JOIN l USING (path)),
pk AS (SELECT path, CASE WHEN downgraded THEN 'hook' ELSE p0 END AS pick, n_books, downgraded FROM k)"""
_QUALITY = [
    ("comment_points", "CASE WHEN views > 0 THEN comments / views * 100 ELSE 0.0 END", [(0.5, 35), (0.2, 28), (0.05, 18), (0.01, 8)], 3),
    ("like_points", "CASE WHEN views > 0 THEN likes / views * 100 ELSE 0.0 END", [(5, 25), (2, 18), (1, 12), (0.3, 7)], 3),
    ("description_points", "mean_description", [(500, 20), (200, 15), (80, 10), (30, 5)], 2),
    ("title_points", "mean_title", [(25, 20), (18, 15), (12, 10), (7, 5)], 2),
]
_SCORE = f"""ps AS (SELECT ch.channel_id, subs, video_count, vs.views, likes, comments, CASE WHEN n > 0 THEN vs.views / n WHEN video_count > 0 THEN ch.views / video_count ELSE 0.0 END AS mv,
  video_count / greatest(age_days / 30, 1.0) AS per_month FROM ch LEFT JOIN vs USING (channel_id)),
ps2 AS (SELECT channel_id, floor(mv + 0.5)::BIGINT AS mean_views, {_ladder("subs", [(1000000, 30), (100000, 25), (10000, 15), (1000, 8)], 3)} AS audience,
  CASE WHEN subs > 0 AND mv > 0 THEN {_ladder("mv / subs * 100", [(7, 30), (3, 25), (1, 15), (0.3, 8)], 3)} ELSE 0 END AS engagement,
  CASE WHEN video_count > 0 THEN {_ladder("per_month", [(8, 20), (4, 16), (2, 12), (0.5, 8)], 3)} ELSE 0 END AS cadence,
  CASE WHEN views > 0 THEN {_ladder("(likes + comments * 5) / views * 100", [(15, 20), (8, 16), (4, 12), (1, 8)], 3)} ELSE 10 END AS reaction FROM ps)"""
_AGE = "age_days / 365"
_BONUS = f"(CASE WHEN {_AGE} < 0.5 THEN 5.0 WHEN {_AGE} < 1 THEN 4.0 WHEN {_AGE} < 1.5 THEN 3.0 WHEN {_AGE} < 2 THEN 2.5 WHEN {_AGE} < 3 THEN 1.5 ELSE 1.0 END * CASE WHEN video_count >= 5 THEN 1.0 ELSE 0.5 END)::DOUBLE"

ORACLES = {
    "s5_hit_counts": f"WITH {_V} {_HITS.format(now=NOW, days=300)}",
    "s5_video_sums": f"WITH {_V}, {_SUMS} SELECT * FROM vs",
    "s5_content_quality": f"WITH {_V}, {_SUMS}, q AS (SELECT channel_id, {', '.join(f'{_ladder(v, s, o)} AS {k}' for k, v, s, o in _QUALITY)}, long_descriptions, series FROM vs) SELECT *, comment_points + like_points + description_points + title_points AS quality FROM q",
    "s5_publish_score": f"WITH {_V}, {_CH}, {_SUMS}, {_SCORE} SELECT *, audience + engagement + cadence + reaction AS score FROM ps2",
    "s5_relevance": f"""WITH {_V}, {_CH}, h AS ({_HITS.format(now=NOW, days=90)}) SELECT ch.channel_id, {_ladder("coalesce(title_matches, 0)", [(6, 350), (4, 280), (3, 220), (2, 160), (1, 80)], 0)}
        + {_ladder("coalesce(appearances, 0)", [(8, 200), (5, 160), (3, 120), (2, 80), (1, 40)], 0)} + {_ladder("coalesce(recent_matches, 0)", [(3, 200), (2, 140), (1, 80)], 0)}
        + least(100 * contains(ch.title, 'building')::INTEGER + 100 * contains(ch.title, 'tools')::INTEGER, 150)
        + 20 * least((len(description) - len(replace(description, 'building', ''))) // 8, 3) + 20 * least((len(description) - len(replace(description, 'tools', ''))) // 5, 3) + 30 * contains(description, 'building tools')::INTEGER
        + CASE WHEN ch.channel_id % 10 = 0 THEN 120 ELSE 0 END + {_ladder("subs", [(1000000, 50), (500000, 40), (100000, 30), (50000, 20), (10000, 10)], 0)} AS relevance FROM ch LEFT JOIN h USING (channel_id)""",
    "s5_rising": f"""WITH {_CH}, r AS (SELECT channel_id, floor(views / subs * {_BONUS} * log2(video_count + 2.0::DOUBLE) * 10 + 0.5)::BIGINT AS score, CASE WHEN video_count > 0 THEN floor(views / video_count + 0.5) ELSE 0 END AS mv, video_count, subs, {_AGE} AS age
        FROM ch WHERE subs BETWEEN 500 AND 300000 AND (channel_id % 4 = 0 OR country = 'KR') AND {_AGE} <= 4) SELECT channel_id, score, CASE WHEN (subs >= 10000 OR mv >= 20000) AND video_count >= 3 THEN 2 ELSE 3 END AS tier, subs, age FROM r WHERE score > 0""",
    "s5_similar": f"WITH {_CH} SELECT channel_id, least(video_count * 10 + {_ladder('subs', [(1000000, 20), (100000, 15), (10000, 10), (1000, 5)], 0)}, 100) AS similar FROM ch",
    "s5_top_tokens": f"""WITH {_V}, n AS (SELECT channel_id, title FROM v QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY published DESC, video_id) <= 30),
        t AS (SELECT channel_id, unnest(string_split_regex(lower(regexp_replace(title, '[^a-zA-Z0-9가-힣\\s]', ' ', 'g')), '\\s+')) AS token FROM n),
        c AS (SELECT channel_id, token, count(*) AS n FROM t WHERE len(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN ('talk', 'part') GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY n DESC, token)::INTEGER AS place FROM c QUALIFY place <= 3""",
    "s5_keyword_ranking": f"WITH {_V} " + " UNION ALL ".join(f"SELECT '{k}' AS keyword, sum((len(title) - len(replace(title, '{k}', ''))) // {len(k)})::BIGINT AS n FROM v" for k in ("talk", "part 2", "high", "none")),
    "s5_merged_searches": f"WITH {_V} SELECT video_id, title || CASE WHEN video_id % 2 = 0 THEN '2' ELSE '3' END AS title FROM v WHERE video_id % 2 = 0 OR video_id % 3 = 0",
    "s6_best_videos": f"WITH {_BEST} SELECT path, video_id, per_day, place FROM b",
    "s6_leaf_stats": f"WITH {_LEAF} SELECT * FROM l",
    "s6_checked_picks": f"WITH {_PICKS} SELECT * FROM pk",
    "s6_summary": f"WITH {_PICKS} SELECT count(*) AS cards, count(*) FILTER (pick = 'preempt') AS preempt, count(*) FILTER (pick = 'hook') AS hook, count(*) FILTER (pick NOT IN ('preempt', 'hook')) AS safe, 0::BIGINT AS high_gaps FROM pk",
    "s6_path_nodes": f"""WITH {_V}, p AS (SELECT string_split(path, '|') AS p FROM v) SELECT p[1] AS node, NULL::VARCHAR AS parent FROM p UNION SELECT p[1] || '|' || p[2], p[1] FROM p UNION SELECT p[1] || '|' || p[2] || '|' || p[3], p[1] || '|' || p[2] FROM p""",
    "s6_competing_books": f"""WITH {SNAPSHOTS}, k(path, word) AS (VALUES ('a', 'blue'), ('a', 'rod'), ('b', 'gizmo')), m AS (SELECT DISTINCT path, title, best_rank FROM st JOIN k ON list_contains(string_split(title, ' '), word))
        SELECT path, title, row_number() OVER (PARTITION BY path ORDER BY best_rank, title)::INTEGER AS place FROM m QUALIFY place <= 3""",
    "s12_new_titles": f"WITH {SNAPSHOTS} SELECT title, rank, date, publisher FROM snaps JOIN st USING (title, publisher) WHERE first_back <= 2450 AND date = first_date",
    "s12_trend_lag": f"""WITH {SNAPSHOTS}, {s2_news._A}, o AS (SELECT unnest(keywords || ['blue', 'rod']) AS keyword FROM a WHERE date BETWEEN DATE '2024-05-01' - 120 AND DATE '2024-05-01' - 90),
        o2 AS (SELECT keyword, count(*) AS n FROM o GROUP BY 1 HAVING n >= 2 ORDER BY n DESC, keyword LIMIT 20), nt AS (SELECT title, rank FROM snaps JOIN st USING (title) WHERE first_back <= 2450 AND date = first_date)
        SELECT keyword, n, title, rank FROM nt JOIN o2 ON contains(lower(title), keyword)""",
    "s12_within_budget": "WITH x AS (SELECT conv_id, turn, sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM conversations) SELECT * FROM x WHERE running <= 3000",
    "s12_top_topics": f"WITH {s3_authors._B}, x AS (SELECT name, list(title ORDER BY best_rank, title) AS l FROM b GROUP BY name) SELECT name, array_to_string(l[1:3], '|') AS titles, array_to_string(topics[1:5], '|') AS topics FROM x JOIN m USING (name)",
    "s12_risk_flags": f"WITH {_V} SELECT video_id, concat_ws('|', CASE WHEN contains(title || ' ' || description, 'urgent') THEN 'urgent' END, CASE WHEN contains(title || ' ' || description, 'low') THEN 'low' END) AS risks FROM v",
    "s12_upserted": "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
}
