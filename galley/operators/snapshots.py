"""Statistics of ranked daily snapshots: rows (date, rank, title, publisher, price, author).

A missing rank is 0 or null and counts in no rank statistic. "Days" of a title are distinct dates. The
last n snapshots are the last n distinct dates in the table, whatever calendar days lie between.
Lists that end in a limit break ties by title, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.functions import fixed
from galley.functions.dictionary import all_labels


def everything():
    """A window over all rows, for tables of few rows."""
    return W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def known_rank(missing: int | None = None) -> Column:
    """The rank with 0 as null, or with null and 0 as ``missing`` where that policy is asked for."""
    rank = F.when(F.col("rank") != 0, F.col("rank"))
    return rank if missing is None else F.coalesce(rank, F.lit(missing))


def recency(snaps: DataFrame) -> DataFrame:
    """date, back (1 for the last snapshot), n_dates: one row a distinct date."""
    days = snaps.select("date").filter("date is not null").distinct()
    return days.select("date", F.row_number().over(W.orderBy(F.desc("date"))).alias("back"), F.count("*").over(everything()).alias("n_dates"))


def with_recency(snaps: DataFrame) -> DataFrame:
    """``snaps`` with back, n_dates, and recent / previous: among the last 30 snapshots / the 30 before.

    With fewer than 30 dates all are recent; with fewer than 60 none are previous.
    """
    out = snaps.join(recency(snaps), "date")
    return out.withColumn("recent", F.col("back") <= 30).withColumn("previous", F.col("back").between(31, 60) & (F.col("n_dates") >= 60))


def title_stats(snaps: DataFrame) -> DataFrame:
    """One row a title: days, n_ranks, rank_sum, best_rank, first_date, publisher and price at first sight.

    first sight is the earliest date, then the best rank. recent_days and previous_days count the dates in the
    two windows of :func:`with_recency`; recent_mean and previous_mean are mean ranks there.
    """
    rank = known_rank()
    when = F.struct("date", F.coalesce(rank, F.lit(2**31 - 1)), "publisher")
    return (
        with_recency(snaps)
        .groupBy("title")
        .agg(
            F.countDistinct("date").alias("days"),
            F.count(rank).alias("n_ranks"),
            F.sum(rank).alias("rank_sum"),
            F.min(rank).alias("best_rank"),
            F.min("date").alias("first_date"),
            F.min_by("publisher", when).alias("publisher"),
            F.min_by("price", when).alias("price"),
            F.max(F.col("recent").cast("int")).alias("in_recent"),
            F.max(F.col("previous").cast("int")).alias("in_previous"),
            F.avg(F.when(F.col("recent"), rank)).alias("recent_mean"),
            F.avg(F.when(F.col("previous"), rank)).alias("previous_mean"),
            F.max("n_dates").alias("n_dates"),
            F.max("back").alias("first_back"),
        )
    )


def totals(snaps: DataFrame) -> DataFrame:
    """records, titles, days."""
    return snaps.agg(F.count("*").alias("records"), F.countDistinct("title").alias("titles"), F.countDistinct("date").alias("days"))


def publisher_titles(stats: DataFrame, top: int = 20) -> DataFrame:
    """publisher, titles: publishers with most titles."""
    named = stats.filter("publisher <> ''")
    return named.groupBy("publisher").agg(F.count("*").alias("titles")).orderBy(F.desc("titles"), "publisher").limit(top)


def publisher_share(stats: DataFrame) -> DataFrame:
    """publisher, days, share: percent of the days of all titles with a named publisher."""
    days = stats.filter("publisher <> ''").groupBy("publisher").agg(F.sum("days").alias("days"))
    total = F.greatest(F.sum("days").over(everything()), F.lit(1))
    return days.select("publisher", "days", (F.col("days") * 100.0 / total).alias("share"))


def price_label(price: Column, bins: Sequence[tuple[float, str]] = fixed.PRICE_BINS, top: str = fixed.PRICE_TOP) -> Column:
    """The label of the first bin whose upper bound lies above the price; null for null."""
    (bound, label), *rest = bins
    out = F.when(price < bound, F.lit(label))
    for bound, label in rest:
        out = out.when(price < bound, F.lit(label))
    return F.when(price.isNotNull(), out.otherwise(F.lit(top)))


def price_histogram(stats: DataFrame, bins: Sequence[tuple[float, str]] = fixed.PRICE_BINS, top: str = fixed.PRICE_TOP, least: float | None = None, below: float | None = None) -> DataFrame:
    """bin, titles, percent of the titles with a price (above ``least`` and under ``below``, where given)."""
    priced = stats.filter("price is not null")
    if least is not None:
        priced = priced.filter(F.col("price") > least)
    if below is not None:
        priced = priced.filter(F.col("price") < below)
    counts = priced.groupBy(price_label(F.col("price"), bins, top).alias("bin")).agg(F.count("*").alias("titles"))
    return counts.select("bin", "titles", (F.col("titles") * 100.0 / F.sum("titles").over(everything())).alias("percent"))


def new_by_month(stats: DataFrame) -> DataFrame:
    """month, titles first seen in it."""
    return stats.groupBy(F.trunc("first_date", "MM").alias("month")).agg(F.count("*").alias("titles"))


def with_topics(stats: DataFrame, topics: Mapping[str, Sequence[str]] = fixed.TOPICS, otherwise: str = fixed.NO_TOPIC) -> DataFrame:
    """A row for each title and topic that its words show."""
    return stats.withColumn("topic", F.explode(all_labels(F.col("title"), topics, otherwise)))


def trend(recent: Column, previous: Column, enough: Column, band: float = 0.1) -> Column:
    """up, down or flat: ``recent`` against ``previous`` with a band; flat where there isn't enough history."""
    # one tenth more or less, in integers times ten so that no engine rounds
    up, down = recent * 10 > previous * round(10 + band * 10), recent * 10 < previous * round(10 - band * 10)
    return F.when(enough & up, "up").when(enough & down, "down").otherwise("flat")


def topic_table(stats: DataFrame, topics: Mapping[str, Sequence[str]] = fixed.TOPICS, otherwise: str = fixed.NO_TOPIC) -> DataFrame:
    """topic, titles, mean_rank (over records), mean_days, recent_titles, previous_titles, trend."""
    rows = with_topics(stats, topics, otherwise).groupBy("topic").agg(
        F.count("*").alias("titles"),
        F.coalesce(F.sum("rank_sum") / F.sum("n_ranks"), F.lit(0.0)).alias("mean_rank"),
        (F.sum("days") / F.count("*")).alias("mean_days"),
        F.sum("in_recent").alias("recent_titles"),
        F.sum("in_previous").alias("previous_titles"),
        F.max("n_dates").alias("n_dates"),
    )
    return rows.withColumn("trend", trend(F.col("recent_titles"), F.col("previous_titles"), F.col("n_dates") >= 60)).drop("n_dates")


def topic_rank_trend(snaps: DataFrame, topics: Mapping[str, Sequence[str]] = fixed.TOPICS, otherwise: str = fixed.NO_TOPIC, missing: int = 999) -> DataFrame:
    """topic, recent_mean, previous_mean, trend by mean rank over calendar days.

    The last 31 days, the last date included, against the 30 days before. Missing ranks count as ``missing``. A
    mean lower (better) by more than 3 is up, higher by more than 3 down; without either mean, null.
    """
    last = snaps.agg(F.max("date").alias("last_date"))  # one row
    rank = known_rank(missing)
    start = F.date_sub("last_date", 30)
    rows = snaps.crossJoin(F.broadcast(last)).filter(F.col("date") >= F.date_sub("last_date", 60))
    rows = rows.withColumn("topic", F.explode(all_labels(F.col("title"), topics, otherwise)))
    means = rows.groupBy("topic").agg(F.avg(F.when(F.col("date") >= start, rank)).alias("recent_mean"), F.avg(F.when(F.col("date") < start, rank)).alias("previous_mean"))
    gain = F.col("previous_mean") - F.col("recent_mean")
    return means.withColumn("trend", F.when(gain > 3, "up").when(gain < -3, "down").when(gain.isNotNull(), "flat"))


def topic_publishers(stats: DataFrame, topics: Mapping[str, Sequence[str]] = fixed.TOPICS, otherwise: str = fixed.NO_TOPIC, top: int = 5) -> DataFrame:
    """topic, publisher, titles, place: the publishers with most titles of each topic."""
    counts = with_topics(stats.filter("publisher <> ''"), topics, otherwise).groupBy("topic", "publisher").agg(F.count("*").alias("titles"))
    return best_of(counts, ["topic"], [F.desc("titles"), F.col("publisher")], top, "place")


def best_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], top: int, place: str = "place") -> DataFrame:
    """The first ``top`` rows of each group in ``order``, numbered; Spark limits groups before the shuffle."""
    return rows.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(place) <= top)


def rising_titles(stats: DataFrame, least: float = 5, within: float = 30, top: int = 15) -> DataFrame:
    """Titles whose mean rank of the last 30 snapshots is at most ``within`` and better by ``least`` than before."""
    gain = F.col("previous_mean") - F.col("recent_mean")
    rows = stats.select("title", "publisher", "recent_mean", "previous_mean", gain.alias("gain"))
    return rows.filter((F.col("gain") >= least) & (F.col("recent_mean") <= within)).orderBy(F.desc("gain"), "title").limit(top)


def long_sellers(stats: DataFrame, top: int = 20) -> DataFrame:
    """Titles seen on 100 dates, or, where there are fewer than 100, on 70 percent of them and 10 at least."""
    least = F.when(F.col("n_dates") >= 100, 100).otherwise(F.greatest(F.floor(F.col("n_dates") * 7 / 10), F.lit(10)))
    mean = F.coalesce(F.col("rank_sum") / F.col("n_ranks"), F.lit(0.0))
    return stats.filter(F.col("days") >= least).select("title", "publisher", "days", mean.alias("mean_rank")).orderBy(F.desc("days"), "title").limit(top)


def new_entrants(stats: DataFrame, back: int = 60, least_days: int = 2, within: int = 30, top: int = 20) -> DataFrame:
    """Titles first seen within the last ``back`` snapshots, on ``least_days`` dates, with a best rank ``within``."""
    rows = stats.filter((F.col("first_back") <= back) & (F.col("days") >= least_days) & (F.col("best_rank") <= within))
    return rows.select("title", "publisher", "first_date", "best_rank", "days").orderBy("best_rank", F.desc("days"), "title").limit(top)


def own_topics(stats: DataFrame, publisher: str, topics: Mapping[str, Sequence[str]] = fixed.TOPICS, otherwise: str = fixed.NO_TOPIC) -> DataFrame:
    """topic, own, market, weak: titles of publishers whose name contains ``publisher`` against all.

    A topic is weak with at most one own title and at least five in the market.
    """
    own = F.coalesce(F.contains(F.col("publisher"), F.lit(publisher)), F.lit(False)).cast("int")
    rows = with_topics(stats, topics, otherwise).groupBy("topic").agg(F.sum(own).alias("own"), F.count("*").alias("market"))
    return rows.withColumn("weak", (F.col("own") <= 1) & (F.col("market") >= 5))


def own_books(stats: DataFrame, publisher: str, missing: int = 999) -> DataFrame:
    """title, mean_rank, days of the publisher's titles."""
    mean = F.coalesce(F.col("rank_sum") / F.col("n_ranks"), F.lit(float(missing)))
    return stats.filter(F.contains(F.col("publisher"), F.lit(publisher))).select("title", mean.alias("mean_rank"), "days")


def topic_competition(stats: DataFrame, topics: Mapping[str, Sequence[str]] = fixed.TOPICS, otherwise: str = fixed.NO_TOPIC, top: int = 10, missing: int = 999) -> DataFrame:
    """topic, place, title, publisher, mean_rank, days: the best titles of each topic but ``otherwise``."""
    mean = F.coalesce(F.col("rank_sum") / F.col("n_ranks"), F.lit(float(missing)))
    rows = with_topics(stats, topics, otherwise).filter(F.col("topic") != otherwise).select("topic", "title", "publisher", mean.alias("mean_rank"), "days")
    return best_of(rows, ["topic"], [F.col("mean_rank"), F.col("title")], top)


def insights(stats: DataFrame, topics: Mapping[str, Sequence[str]] = fixed.TOPICS, otherwise: str = fixed.NO_TOPIC) -> DataFrame:
    """kind, name, value: the largest topic, rising topics (three), the two largest publishers by share of days,
    the longest seller (half of all dates, ten at least) and the best new title (three dates, rank up to 30)."""
    table = topic_table(stats, topics, otherwise)
    row = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
    size = [F.desc("titles"), F.col("topic")]
    share = publisher_share(stats).orderBy(F.desc("days"), "publisher").limit(2)
    steady = stats.filter(F.col("days") >= F.greatest(F.floor(F.col("n_dates") / 2), F.lit(10))).orderBy(F.desc("days"), "title").limit(1)
    fresh = stats.filter("first_back <= 60 and days >= 3 and best_rank <= 30").orderBy("best_rank", "title").limit(1)
    parts = [
        row(table.orderBy(*size).limit(1), "largest topic", "topic", "titles"),
        row(table.filter("trend = 'up'").orderBy(*size).limit(3), "rising topic", "topic", "titles"),
        row(share, "publisher share", "publisher", "share"),
        row(steady, "longest seller", "title", "days"),
        row(fresh, "best new title", "title", "best_rank"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def new_dates(incoming: DataFrame, archive: DataFrame) -> DataFrame:
    """The rows of ``incoming`` on dates that ``archive`` doesn't have."""
    return incoming.join(archive.select("date").distinct(), "date", "left_anti")
