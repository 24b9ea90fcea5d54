"""The planning board: what several marts say together, and what is tracked over time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.functions.dictionary import all_labels
from galley.operators.snapshots import best_of, known_rank, with_recency


def new_titles(snaps: DataFrame, recent: int = 30, least_dates: int = 60) -> DataFrame:
    """title, rank, date, publisher of titles first seen in the last ``recent`` snapshots; none with few dates."""
    rows = with_recency(snaps).filter(F.col("n_dates") >= least_dates)
    known = rows.filter(F.col("back") > recent).select("title").distinct()
    fresh = rows.filter(F.col("back") <= recent).join(known, "title", "left_anti")
    return best_of(fresh, ["title"], [F.col("date"), known_rank().asc_nulls_last()], 1, "_n").select("title", "rank", "date", "publisher")


def old_keywords(articles: DataFrame, today: Column, nearest: int = 90, furthest: int = 180, least: int = 2, top: int = 20) -> DataFrame:
    """keyword, n: lower-cased keywords of articles ``nearest`` to ``furthest`` days old, ``least`` times or more."""
    rows = articles.filter(F.col("date").between(F.date_sub(today, furthest), F.date_sub(today, nearest)))
    counts = rows.select(F.explode("keywords").alias("k")).select(F.lower("k").alias("keyword"))
    return counts.groupBy("keyword").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "keyword").limit(top)


def trend_lag(titles: DataFrame, keywords: DataFrame, top: int = 20) -> DataFrame:
    """keyword, n, title, rank: titles that contain one of the ``top`` most frequent old keywords.

    These few are gathered in one array that every title is tested with, so there is no join of titles and keywords.
    """
    held = keywords.orderBy(F.desc("n"), "keyword").limit(top).agg(F.collect_list(F.struct("keyword", "n")).alias("ks"))  # one row
    low = F.lower("title")
    hits = titles.crossJoin(F.broadcast(held)).select("title", "rank", F.explode(F.filter("ks", lambda k: F.contains(low, k["keyword"]))).alias("k"))
    return hits.select("k.keyword", "k.n", "title", "rank")


def within_budget(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], length: Column, budget: int) -> DataFrame:
    """The rows of each group before the running length first goes over ``budget``."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(length).over(w)).filter(F.col("running") <= budget)


def risk_flags(text: Column, patterns: Mapping[str, Sequence[str]]) -> Column:
    """Names of the risks whose patterns the lower-cased text contains."""
    return all_labels(F.coalesce(text, F.lit("")), {k: [p.lower() for p in v] for k, v in patterns.items()})


def links_in(text: Column) -> Column:
    """The web addresses in a text, in order; null for null."""
    return F.regexp_extract_all(text, F.lit(r"https?://[^\s)\]>\"']+"), F.lit(0))


def pinned_too(items: DataFrame, pinned: DataFrame) -> DataFrame:
    """``items`` and those of ``pinned`` whose (type, title) isn't among them."""
    return items.unionByName(pinned.join(items.select("type", "title"), ["type", "title"], "left_anti"), allowMissingColumns=True)


def item_counts(items: DataFrame) -> DataFrame:
    """type, n: how many items there are of each type, null among them."""
    return items.groupBy("type").agg(F.count("*").alias("n"))


def upserted(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the latest ``version``, of the table and its changes; changes win ties."""
    both = current.withColumn("_o", F.lit(1)).unionByName(changes.withColumn("_o", F.lit(0)))
    return best_of(both, [key], [F.desc_nulls_last(version), F.col("_o")], 1, "_n").drop("_n", "_o")


def tracking(raw: DataFrame) -> DataFrame:
    """``raw`` (id, stage, updated, memo) with the defaults of entries that were a bare stage."""
    return raw.select("id", F.coalesce("stage", F.lit("")).alias("stage"), "updated", F.coalesce("memo", F.lit("")).alias("memo"))


def top_topics(mart: DataFrame, titles: int = 3, topics: int = 5) -> DataFrame:
    """name, titles, topics: the first few of each author, for a prompt."""
    return mart.select("name", F.slice(F.col("books.title"), 1, titles).alias("titles"), F.slice("topics", 1, topics).alias("topics"))


def matches_either_way(items: DataFrame, text: str, column: str = "title") -> DataFrame:
    """The first item, by title, that contains ``text`` or lies in it."""
    return items.filter(F.contains(F.col(column), F.lit(text)) | F.contains(F.lit(text), F.col(column))).orderBy(column).limit(1)


def royalty(price: Column, rate: Column, copies: Column) -> Column:
    """Income of a title: price times rate times copies, of which 80 percent are sold."""
    return price * rate * copies * 0.8


def break_even(cost: Column, price: Column, rate: Column) -> Column:
    """Copies, rounded up, whose royalties make up for the cost; null where a copy brings nothing."""
    return F.ceil(cost / F.nullif(price * rate, F.lit(0)))


def hash_id(text: Column) -> Column:
    """'it' and the 32-bit hash h = 31 h + c of the text's characters, unsigned, in base 36; '' for null."""
    codes = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 2**32)
    return F.concat(F.lit("it"), F.lower(F.conv(h.cast("string"), 10, 36)))


def log_entries(logs: DataFrame, level: str | None = None) -> DataFrame:
    """Log rows (ts, level, source, message) of a level, newest first."""
    return (logs if level is None else logs.filter(F.col("level") == level)).orderBy(F.desc("ts"))


def level_counts(logs: DataFrame, levels: Sequence[str] = ("error", "warn", "info", "nav")) -> DataFrame:
    """A count of each level, and total."""
    return logs.agg(*[F.count_if(F.col("level") == x).alias(x) for x in levels], F.count("*").alias("total"))


def luminance(colour: Column) -> Column:
    """Relative luminance of a hexadecimal colour (#rgb or #rrggbb), by the sRGB curve."""
    digits = F.replace(colour, F.lit("#"), F.lit(""))
    wide = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)

    def channel(at: int) -> Column:
        c = F.conv(F.substring(wide, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return channel(1) * 0.2126 + channel(3) * 0.7152 + channel(5) * 0.0722


def brightness(pixels: DataFrame, step: int = 8) -> DataFrame:
    """image_id, brightness: the mean of 0.299 r + 0.587 g + 0.114 b over every ``step``-th pixel (image_id, place, r, g, b)."""
    light = F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114
    return pixels.filter(F.col("place") % step == 0).groupBy("image_id").agg(F.avg(light).alias("brightness"))
