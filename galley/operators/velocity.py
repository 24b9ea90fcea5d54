"""Views a day by leaf of a taxonomy: velocity ratios, checks of picks, summaries.

Videos are rows (path, video_id, title, published, views); a path is 'L1|L2|L3'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.dictionary import half_up
from galley.operators.snapshots import best_of
from galley.session import settled

# The scales of a card, best first.
PICKS, URGENCY, GAPS = ("preempt", "hook", "safe"), ("지금", "3개월 내", "6개월 내"), ("높음", "보통", "낮음")
HIGH_GAP = "높음"


def flattened(taxonomy: DataFrame) -> DataFrame:
    """path, query of a tree (l1, l2, l3, queries array<string>), a row a query."""
    return taxonomy.select(F.concat_ws("|", "l1", "l2", "l3").alias("path"), F.explode("queries").alias("query"))


def merged(base: DataFrame, custom: DataFrame) -> DataFrame:
    """Trees (l1, l2, l3, queries) united: new leaves are added, known ones get the queries they lack, in order."""
    both = base.withColumn("_o", F.lit(0)).unionByName(custom.withColumn("_o", F.lit(1)))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("_o", "queries"))), lambda x: x["queries"])
    return both.groupBy("l1", "l2", "l3").agg(F.array_distinct(F.flatten(lists)).alias("queries"))


def path_nodes(leaves: DataFrame) -> DataFrame:
    """node, parent: each distinct prefix of the paths."""
    parts = F.split("path", r"\|")
    nodes = leaves.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "|").alias("node"), F.array_join(F.slice(parts, 1, k - 1), "|").alias("parent")))).alias("x"))
    return nodes.select("x.node", F.nullif("x.parent", F.lit("")).alias("parent")).distinct()


def views_per_day(views: Column, published: Column, today: Column) -> Column:
    """Views over the days since publishing, one at least, rounded."""
    return half_up(views / F.greatest(F.datediff(today, published), F.lit(1)))


def best_videos(videos: DataFrame, today: Column, top: int = 100) -> DataFrame:
    """A row a path and video with per_day, the ``top`` of each path by it."""
    rows = videos.withColumn("per_day", views_per_day(F.col("views"), F.col("published"), today))
    once = best_of(rows, ["path", "video_id"], [F.desc("per_day"), F.col("title")], 1, "_n").drop("_n")
    return best_of(once, ["path"], [F.desc("per_day"), F.col("video_id")], top)


def leaf_stats(best: DataFrame, today: Column, days: int = 90) -> DataFrame:
    """path, n, views, mean_per_day, recent_per_day, older_per_day, ratio, label, sum_per_day, rising.

    recent are the last ``days`` days. ratio is recent over older mean (both rounded), to one decimal; 99 without
    older videos, 0 without any. label: surging from 3, up from 1.5.
    """
    recent = F.col("published") >= F.date_sub(today, days)
    mean = lambda test: F.avg(F.when(test, F.col("per_day")))
    rows = best.groupBy("path").agg(
        F.count("*").alias("n"), F.sum("views").alias("views"), half_up(F.avg("per_day")).alias("mean_per_day"), F.coalesce(mean(recent), F.lit(0.0)).alias("_recent"), F.coalesce(mean(~recent), F.lit(0.0)).alias("_older"),
        F.count_if(recent).alias("n_recent"), F.sum("per_day").alias("sum_per_day"),
    )
    rows = rows.withColumn("recent_per_day", half_up(F.col("_recent"))).withColumn("older_per_day", half_up(F.col("_older")))
    ratio = F.when(F.col("older_per_day") > 0, half_up(F.col("recent_per_day") / F.col("older_per_day") * 10) / 10).when(F.col("n_recent") > 0, 99.0).otherwise(0.0)
    rows = rows.withColumn("ratio", ratio).withColumn("label", F.when(F.col("ratio") >= 3, "surging").when(F.col("ratio") >= 1.5, "up"))
    rising = (F.col("_recent") > 0) & ((F.col("_older") == 0) | (F.col("_recent") >= F.col("_older") * 1.5))
    return rows.withColumn("rising", rising).drop("_recent", "_older", "n_recent")


def checked_picks(cards: DataFrame, stats: DataFrame) -> DataFrame:
    """``cards`` (path, pick, n_books) with pick and downgraded: preempt becomes hook with two rival books or more,
    or where the path isn't rising and its views a day sum to less than 500."""
    s = stats.select("path", "rising", "sum_per_day")
    rows = cards.join(s, "path", "left")
    weak = ~F.coalesce("rising", F.lit(False)) & (F.coalesce("sum_per_day", F.lit(0)) < 500)
    down = (F.col("pick") == "preempt") & ((F.col("n_books") > 1) | weak)
    return rows.withColumn("downgraded", down).withColumn("pick", F.when(down, "hook").otherwise(F.col("pick"))).drop("rising", "sum_per_day")


def summary(cards: DataFrame) -> DataFrame:
    """cards, preempt, hook, safe, high_gaps (cards whose column ``gap``, where there is one, is '높음')."""
    n = lambda p: F.count_if(F.col("pick") == p)
    high = F.count_if(F.col("gap") == HIGH_GAP) if "gap" in cards.columns else F.lit(0).cast("long")
    return cards.agg(F.count("*").alias("cards"), n("preempt").alias("preempt"), n("hook").alias("hook"), (F.count("*") - n("preempt") - n("hook")).alias("safe"), high.alias("high_gaps"))


def view_totals(best: DataFrame) -> DataFrame:
    """path, n, views of each leaf, and of all under a null path."""
    return best.rollup("path").agg(F.count("*").alias("n"), F.coalesce(F.sum("views"), F.lit(0)).alias("views"))


def ordered_cards(cards: DataFrame, mode: str = "preempt") -> DataFrame:
    """Cards (path, pick, urgency, gap, top_views) by 'preempt' (pick, then urgency), 'urgency', 'views', 'gap' or 'hook'.

    Names that the scales don't know come last; equal cards go by path.
    """
    place = lambda c, scale: F.coalesce(*[F.when(F.col(c) == x, i) for i, x in enumerate(scale)], F.lit(9))
    pick, urgency, gap = place("pick", PICKS), place("urgency", URGENCY), place("gap", GAPS)
    keys = {"preempt": [pick, urgency], "urgency": [urgency], "views": [F.desc_nulls_last("top_views")], "gap": [gap], "hook": [pick]}[mode]
    return cards.orderBy(*keys, "path")


def competing_books(cards: DataFrame, books: DataFrame, top: int = 3) -> DataFrame:
    """path, title, place: books whose title contains a word of the card's keyword, the best ranked first, up to ``top``.

    A card's column ``known`` (array of titles), where there is one, counts towards ``top`` and its titles aren't listed
    again, whatever their case. Words have two letters or more and lie inside a word of the title; the parts of
    titles' words that are as long as some keyword meet them by equality. Of the titles with a word only the best few go on, as a card can list no
    more, so a common word pairs no card with every title.
    """
    cut = lambda c: F.array_distinct(F.split(F.lower(F.regexp_replace(c, r"[^\w가-힣\s]", "")), r"\s+"))
    known = F.transform(F.coalesce("known", F.array().cast("array<string>")), lambda t: F.lower(t)) if "known" in cards.columns else F.array().cast("array<string>")
    k = cards.select("path", known.alias("known"), F.explode(cut(F.col("keyword"))).alias("word")).filter((F.length("word") >= 2) & (F.size("known") < top))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"[\w가-힣]{2,}"), F.lit(0)))
    # numbered once, so that a window carries no title
    t = settled(books.groupBy("title").agg(F.min("rank").alias("rank")).withColumn("id", F.monotonically_increasing_id()))
    # a window of each length that some word has slides over a token, so a token gives rows in proportion to its letters
    sizes = k.agg(F.collect_set(F.length("word"))).scalar()
    window = F.concat(F.lit("(?=(.{"), F.col("n").cast("string"), F.lit("}))"))
    cut_up = t.select("id", F.explode(tokens).alias("token")).select("id", "token", sizes.alias("sizes")).select("id", "token", F.explode("sizes").alias("n"))
    met = cut_up.select("id", F.explode(F.array_distinct(F.regexp_extract_all("token", window, F.lit(1)))).alias("word"))
    met = met.join(k.select("word").distinct(), "word", "left_semi").distinct()
    parts = met.join(t, "id").select("title", "rank", "word")
    parts = best_of(parts, ["word"], [F.col("rank"), F.col("title")], 2 * top, "_n").drop("_n")
    pairs = k.join(parts, "word").filter(~F.array_contains("known", F.lower("title")))
    pairs = pairs.select("path", "title", "rank", F.size("known").alias("held")).distinct()
    return best_of(pairs, ["path"], [F.col("rank"), F.col("title")], top).filter(F.col("place") <= top - F.col("held")).drop("rank", "held")
