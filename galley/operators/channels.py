"""Video channels as author candidates: search hits, scorecards and the index of rising channels.

Channels are rows (channel_id, title, description, country, published, subs, views, video_count), videos
(video_id, channel_id, title, description, published, views, likes, comments). Scores are ladders of
conditional expressions over one aggregate a channel, so a channel with most of all videos is summed by
many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.dictionary import half_up, ladder
from galley.operators.snapshots import best_of

HANGUL = r"[가-힣]"
# Fixed value: marks of a series in a title.
SERIES = r"(?i)(ep\.?\s*\d+|\d+편|\d+강|part\.?\s*\d+|#\d+|시리즈|강의|강좌|course)"


def with_statistics(hits: DataFrame, statistics: DataFrame, key: str, counts: Sequence[str], keep_all: bool = True) -> DataFrame:
    """``hits`` with ``counts`` of ``statistics`` by ``key``; without statistics they are 0, or the row goes."""
    joined = hits.join(statistics.select(key, *counts), key, "left" if keep_all else "inner")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def merged_searches(first: DataFrame, second: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows of two search orders, one a key: the first search's, then the smaller title."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    return best_of(both, [key], [F.col("_o"), F.col("title")], 1, "_n").drop("_n", "_o")


def hit_counts(videos: DataFrame, query: str, since: Column) -> DataFrame:
    """channel_id, appearances, title_matches, recent_matches (dated ``since`` or later), korean."""
    match = F.contains(F.lower("title"), F.lit(query.lower()))
    return videos.filter("channel_id is not null").groupBy("channel_id").agg(
        F.count("*").alias("appearances"), F.count_if(match).alias("title_matches"), F.count_if(match & (F.col("published") >= since)).alias("recent_matches"), F.coalesce(F.bool_or(F.col("title").rlike(HANGUL)), F.lit(False)).alias("korean")
    )


def video_sums(videos: DataFrame) -> DataFrame:
    """One row a channel: n, views, likes, comments, mean lengths, percents of long descriptions and series."""
    titled = F.length("title") > 0
    description = F.length(F.coalesce("description", F.lit("")))
    percent = lambda test, of: F.coalesce(half_up(F.count_if(test) * 100 / F.nullif(of, F.lit(0))), F.lit(0))
    return videos.groupBy("channel_id").agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce("views", F.lit(0))).alias("views"),
        F.sum(F.coalesce("likes", F.lit(0))).alias("likes"),
        F.sum(F.coalesce("comments", F.lit(0))).alias("comments"),
        F.avg(description).alias("mean_description"),
        F.coalesce(F.avg(F.when(titled, F.length("title"))), F.lit(0.0)).alias("mean_title"),
        percent(description >= 200, F.count("*")).alias("long_descriptions"),
        percent(titled & F.col("title").rlike(SERIES), F.count_if(titled)).alias("series"),
    )


def content_quality(sums: DataFrame) -> DataFrame:
    """channel_id and quality 0 to 100: comments 35, likes 25, descriptions 20, titles 20."""
    rate = lambda c: F.when(F.col("views") > 0, F.col(c) / F.col("views") * 100).otherwise(0.0)
    parts = {
        "comment_points": ladder(rate("comments"), [(0.5, 35), (0.2, 28), (0.05, 18), (0.01, 8)], 3),
        "like_points": ladder(rate("likes"), [(5, 25), (2, 18), (1, 12), (0.3, 7)], 3),
        "description_points": ladder(F.col("mean_description"), [(500, 20), (200, 15), (80, 10), (30, 5)], 2),
        "title_points": ladder(F.col("mean_title"), [(25, 20), (18, 15), (12, 10), (7, 5)], 2),
    }
    out = sums.select("channel_id", *[c.alias(k) for k, c in parts.items()], "long_descriptions", "series")
    return out.withColumn("quality", sum((F.col(k) for k in list(parts)[1:]), F.col("comment_points")))


def publish_score(channels: DataFrame, sums: DataFrame, now: Column) -> DataFrame:
    """channel_id and score 0 to 100: audience 30, engagement 30, cadence 20, reaction 20.

    Without videos the mean views come from the channel's totals and the reaction is 10. Months have 30 days and
    number one at least; no date or no video gives no cadence points.
    """
    c = channels.select("channel_id", "subs", "video_count", F.col("views").alias("all_views"), "published")
    v = sums.select("channel_id", "n", "views", "likes", "comments")
    rows = c.join(v, "channel_id", "left")
    mean = F.when(F.col("n") > 0, F.col("views") / F.col("n")).when(F.col("video_count") > 0, F.col("all_views") / F.col("video_count")).otherwise(0.0)
    rows = rows.withColumn("mean_views", mean)
    per_month = F.col("video_count") / F.greatest(F.datediff(now, "published") / 30, F.lit(1.0))
    reaction = (F.col("likes") + F.col("comments") * 5) / F.col("views") * 100
    parts = {
        "audience": ladder(F.col("subs"), [(1000000, 30), (100000, 25), (10000, 15), (1000, 8)], 3),
        "engagement": F.when((F.col("subs") > 0) & (F.col("mean_views") > 0), ladder(F.col("mean_views") / F.col("subs") * 100, [(7, 30), (3, 25), (1, 15), (0.3, 8)], 3)).otherwise(0),
        "cadence": F.when(F.col("published").isNotNull() & (F.col("video_count") > 0), ladder(per_month, [(8, 20), (4, 16), (2, 12), (0.5, 8)], 3)).otherwise(0),
        "reaction": F.when(F.col("views") > 0, ladder(reaction, [(15, 20), (8, 16), (4, 12), (1, 8)], 3)).otherwise(10),
    }
    out = rows.select("channel_id", half_up(F.col("mean_views")).alias("mean_views"), *[p.alias(k) for k, p in parts.items()])
    return out.withColumn("score", F.col("audience") + F.col("engagement") + F.col("cadence") + F.col("reaction"))


def publish_tier(subs: Column, mean_views: Column, videos: Column, matches: Column) -> Column:
    """1 to 3: a large audience with matching content, a fair one with some content, the rest."""
    large, fair = (subs >= 50000) | (mean_views >= 100000), (subs >= 10000) | (mean_views >= 20000)
    return F.when(large & matches & (videos >= 5), 1).when(fair & (matches | (videos >= 3)), 2).otherwise(3)


def relevance(query: str) -> Column:
    """The relevance of a channel (title, description, title_matches, appearances, recent_matches, direct, subs)."""
    q = query.lower()
    words = q.split()
    title, text = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    has = lambda c, w: F.contains(c, F.lit(w)).cast("int")
    times = lambda w: ((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("int")
    zero = F.lit(0)
    name = F.least(sum((has(title, w) * 100 for w in words), zero) + has(title, q) * 80, F.lit(150))
    body = sum((F.least(times(w), F.lit(3)) * 20 for w in words), zero) + has(text, q) * 30
    n = lambda c: F.coalesce(c, zero)
    return (
        ladder(n("title_matches"), [(6, 350), (4, 280), (3, 220), (2, 160), (1, 80)], 0)
        + ladder(n("appearances"), [(8, 200), (5, 160), (3, 120), (2, 80), (1, 40)], 0)
        + ladder(n("recent_matches"), [(3, 200), (2, 140), (1, 80)], 0)
        + name
        + body
        + F.when(F.col("direct"), 120).otherwise(0)
        + ladder(n("subs"), [(1000000, 50), (500000, 40), (100000, 30), (50000, 20), (10000, 10)], 0)
    )


def korean(channels: DataFrame) -> Column:
    """Whether title or description show Hangul, or the country is KR; false where all are null."""
    return F.coalesce(F.concat_ws(" ", "title", "description").rlike(HANGUL), F.lit(False)) | F.coalesce(F.col("country") == "KR", F.lit(False))


def rising(channels: DataFrame, now: Column, order: str = "score") -> DataFrame:
    """channel_id, score, tier, subs, age of Korean channels of 500 to 300,000 subscribers, four years old at most.

    score is views a subscriber times a bonus for youth (halved under five videos) times log2(videos + 2) times
    10, rounded. A column ``matches``, where there is one, says whether the content matches for the tier. Ordered by tier,
    then score or subs.
    """
    years = F.datediff(now, "published") / 365
    rows = channels.filter(F.col("subs").between(500, 300000) & korean(channels)).withColumn("age", years).filter("age <= 4")
    bonus = F.when(F.col("age") < 0.5, 5.0).when(F.col("age") < 1, 4.0).when(F.col("age") < 1.5, 3.0).when(F.col("age") < 2, 2.5).when(F.col("age") < 3, 1.5).otherwise(1.0)
    bonus = F.when(F.col("video_count") >= 5, bonus).otherwise(bonus * 0.5)
    score = half_up(F.col("views") / F.col("subs") * bonus * F.log2(F.col("video_count") + 2.0) * 10)
    mean = F.when(F.col("video_count") > 0, half_up(F.col("views") / F.col("video_count"))).otherwise(0)
    matches = F.coalesce("matches", F.lit(False)) if "matches" in channels.columns else F.lit(False)
    tier = publish_tier(F.col("subs"), mean, F.col("video_count"), matches)
    out = rows.select("channel_id", score.alias("score"), tier.alias("tier"), "subs", "age").filter("score > 0")
    return out.orderBy("tier", F.desc(order), "channel_id")


def similar_score(appearances: Column, subs: Column) -> Column:
    """Ten points an appearance and up to twenty for the size, a hundred at most."""
    return F.least(appearances * 10 + ladder(subs, [(1000000, 20), (100000, 15), (10000, 10), (1000, 5)], 0), F.lit(100))


def top_tokens(videos: DataFrame, stop: DataFrame, top: int = 3, newest: int = 30) -> DataFrame:
    """channel_id, token, n, place: the commonest words of a channel's ``newest`` titles, without stop words (word)."""
    rows = best_of(videos, ["channel_id"], [F.desc_nulls_last("published"), F.col("video_id")], newest, "_n")
    words = F.explode(F.split(F.lower(F.regexp_replace("title", r"[^a-zA-Z0-9가-힣\s]", " ")), r"\s+"))
    tokens = rows.select("channel_id", words.alias("token")).filter((F.length("token") >= 2) & ~F.col("token").rlike(r"^\d+$"))
    tokens = tokens.join(stop.select(F.lower("word").alias("token")).distinct(), "token", "left_anti")
    return best_of(tokens.groupBy("channel_id", "token").agg(F.count("*").alias("n")), ["channel_id"], [F.desc("n"), F.col("token")], top)


def keyword_ranking(texts: DataFrame, keywords: Sequence[str], column: str = "title") -> DataFrame:
    """keyword, n: how often each keyword stands in all texts, most first."""
    counts = texts.agg(*[F.coalesce(F.sum(F.regexp_count(F.lower(column), F.lit("\\Q" + k.lower() + "\\E"))), F.lit(0)).alias(f"k{i}") for i, k in enumerate(keywords)])
    pairs = F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").cast("long").alias("n")) for i, k in enumerate(keywords)])
    return counts.select(F.inline(pairs)).orderBy(F.desc("n"), "keyword")


def resolve_input(raw: Column) -> Column:
    """struct<kind, value> of what a user typed: handle, channel id, custom name, or a search."""
    text = F.trim(raw)
    path = lambda p: F.regexp_extract(text, p, 1)
    handle, ident, custom = path(r"(?:youtube\.com/|^)@([^/?\s]+)"), path(r"(?:youtube\.com/channel/|^)(UC[\w-]{22})"), path(r"youtube\.com/(?:c|user)/([^/?\s]+)")
    named = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return F.when(handle != "", named("handle", handle)).when(ident != "", named("id", ident)).when(custom != "", named("name", custom)).otherwise(named("search", text))


def listed(channels: DataFrame, least: int = 500, top: int = 50) -> DataFrame:
    """The first ``top`` Korean channels with ``least`` subscribers or more, in the order of the search (column ``place``)."""
    rows = channels.filter(korean(channels) & (F.coalesce("subs", F.lit(0)) >= least))
    return rows.orderBy("place").limit(top)


def ordered(channels: DataFrame, query: str, by: str = "relevance") -> DataFrame:
    """Channels by 'relevance' to a query, 'subs' or 'views', most first; equal ones in the order of the search (``place``)."""
    key = relevance(query) if by == "relevance" else F.coalesce(by, F.lit(0))
    return channels.withColumn("_key", key).orderBy(F.desc("_key"), "place").drop("_key")


def sanitised(raw: Column, most: int = 50) -> Column:
    """Search words without signs that a search would read as operators, cut."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(raw, r"[^a-zA-Z0-9가-힣\s]", " "), r"\s+", " ")), 1, most)


def short_number(n: Column) -> Column:
    """A number as it is shown: 천 from a thousand, 만 from ten thousand, 천만 from ten million."""
    tenth = lambda unit: F.format_string("%.1f", n / unit)
    return F.when(n >= 10_000_000, F.concat(tenth(10_000_000.0), F.lit("천만"))).when(n >= 10_000, F.concat(half_up(n / 10_000).cast("string"), F.lit("만"))).when(n >= 1000, F.concat(tenth(1000.0), F.lit("천"))).otherwise(n.cast("string"))


def highlighted(text: Column, query: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The text with the first place of a lower-cased query between two marks."""
    at, size = F.instr(F.lower(text), query), F.length(query)
    marked = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(before), F.substring(text, at, size), F.lit(after), F.substring(text, at + size, F.length(text)))
    return F.when((F.coalesce(query, F.lit("")) == "") | (at == 0), text).otherwise(marked)
