"""Competition by category: our titles, rivals' titles, planned titles and lectures side by side.

The four tables meet in one grouping by category: each is reduced to the same columns with a tag for its
side, so there is one shuffle and no chain of outer joins. Titles are rows (category, rank, title,
publisher, year), planned ones (category, title, team, month, status), lectures (category, title,
popularity).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A status of planned titles that are out, and one of those still being thought of (fixed values).
DONE, PLANNING = ("출간", "중단"), "기획예정"
UNDATED = "미정"


def month_label(raw: Column) -> Column:
    """'2026년03월' with a space after the year; other texts as they are."""
    return F.regexp_replace(raw, r"^(\d{4}년)(\d{2}월)$", "$1 $2")


def active(planned: DataFrame, teams: Sequence[str] | None = None, done: Sequence[str] = DONE) -> DataFrame:
    """Planned titles of the teams that aren't out yet."""
    rows = planned.filter(~F.coalesce(F.col("status").isin(*done), F.lit(False)))
    return rows if teams is None else rows.filter(F.col("team").isin(*teams))


def categories(titles: DataFrame, planned: DataFrame, lectures: DataFrame, own: Sequence[str], rivals: Sequence[str], skip: str = "기타") -> DataFrame:
    """A row for each category with any title, plan or lecture.

    category, n_rival, n_own, n_planned, n_planning, n_lectures, rival_best, own_best (ranks, null without),
    rival_year (of the best rival, on a tie the first by year and title), popularity, status. Titles and lectures of category ``skip`` are left out, plans
    are not. status: plan-only without titles but with plans, lecture-only with neither, gap with rivals' only,
    leading with ours only or where our best rank is at most 1.3 times theirs, else behind.
    """
    none = lambda kind: F.lit(None).cast(kind)
    named = lambda rows: F.col("title") if "title" in rows.columns else none("string").alias("title")
    side = F.when(F.col("publisher").isin(*own), "own").when(F.col("publisher").isin(*rivals), "rival")
    shelf = titles.select("category", side.alias("side"), "rank", "year", named(titles), none("string").alias("status"), none("long").alias("popularity")).filter(F.col("side").isNotNull() & (F.col("category") != skip))
    plans = planned.select("category", F.lit("planned").alias("side"), none("int").alias("rank"), none("int").alias("year"), named(planned), "status", none("long").alias("popularity"))
    talks = lectures.filter(F.col("category") != skip).select("category", F.lit("lecture").alias("side"), none("int").alias("rank"), none("int").alias("year"), named(lectures), none("string").alias("status"), F.col("popularity").cast("long"))
    of = lambda s: F.col("side") == s
    rows = shelf.unionByName(plans).unionByName(talks).groupBy("category")
    rows = rows.agg(
        F.count_if(of("rival")).alias("n_rival"),
        F.count_if(of("own")).alias("n_own"),
        F.count_if(of("planned")).alias("n_planned"),
        F.count_if(of("planned") & (F.col("status") == PLANNING)).alias("n_planning"),
        F.count_if(of("lecture")).alias("n_lectures"),
        F.min(F.when(of("rival"), F.col("rank"))).alias("rival_best"),
        F.min(F.when(of("own"), F.col("rank"))).alias("own_best"),
        F.min_by("year", F.when(of("rival"), F.struct("rank", "year", "title"))).alias("rival_year"),
        F.coalesce(F.sum(F.when(of("lecture"), F.col("popularity"))), F.lit(0)).alias("popularity"),
    )
    status = (
        F.when((F.col("n_rival") == 0) & (F.col("n_own") == 0), F.when(F.col("n_planned") > 0, "plan-only").otherwise("lecture-only"))
        .when(F.col("n_own") == 0, "gap")
        .when(F.col("n_rival") == 0, "leading")
        .when(F.col("own_best") * 10 <= F.col("rival_best") * 13, "leading")
        .otherwise("behind")
    )
    return rows.withColumn("status", status)


def status_counts(cats: DataFrame) -> DataFrame:
    """status, categories, planned, with_lectures."""
    return cats.groupBy("status").agg(F.count("*").alias("categories"), F.sum("n_planned").alias("planned"), F.count_if(F.col("n_lectures") > 0).alias("with_lectures"))


def age(year: Column, this_year: int) -> Column:
    """Years since a year after 2000, else null."""
    return F.when(year > 2000, this_year - year)


def priority(cats: DataFrame, this_year: int, top: int = 5) -> DataFrame:
    """category, status, score: the categories to act on first, among those with a gap or behind."""
    score = (
        F.when(F.col("status") == "gap", 40).when(F.col("status") == "behind", 20).otherwise(0)
        + F.least(F.col("n_rival") * 2, F.lit(20))
        + F.least(F.col("n_lectures") * 3, F.lit(15))
        + F.least(F.floor(F.col("popularity") / 1000), F.lit(10))
        + F.when(age(F.col("rival_year"), this_year) >= 4, 10).otherwise(0)
        + F.when(F.col("n_planned") > 0, 5).otherwise(0)
    )
    return cats.filter(F.col("status").isin("gap", "behind")).select("category", "status", score.alias("score")).orderBy(F.desc("score"), "category").limit(top)


def proposals(cats: DataFrame, top: int = 8) -> DataFrame:
    """category, score for new proposals: 40, 20 or 5 by status, and 2 a rival title, 3 a lecture."""
    score = F.when(F.col("status") == "gap", 40).when(F.col("status") == "behind", 20).otherwise(5) + F.col("n_rival") * 2 + F.col("n_lectures") * 3
    return cats.select("category", score.alias("score")).orderBy(F.desc("score"), "category").limit(top)


def largest(cats: DataFrame, by: str, top: int = 10, unless: str | None = None) -> DataFrame:
    """category, value: the categories with most of column ``by``, without those that have ``unless``."""
    rows = cats.filter(F.col(by) > 0)
    if unless is not None:
        rows = rows.filter(F.col(unless) == 0)
    return rows.select("category", F.col(by).alias("value")).orderBy(F.desc("value"), "category").limit(top)


def insights(cats: DataFrame, this_year: int, top: int = 6) -> DataFrame:
    """kind, category, value: gaps, categories behind and leading, lectures without a book of ours (two at least), gaps
    with a plan, and ageing rivals (best title four years old or more)."""
    old = age(F.col("rival_year"), this_year)
    groups = [
        ("gap", F.col("status") == "gap", F.col("n_rival")),
        ("behind", F.col("status") == "behind", (F.col("own_best") - F.col("rival_best")).cast("long")),
        ("leading", F.col("status") == "leading", F.col("n_own")),
        ("lectures without book", (F.col("n_lectures") >= 2) & (F.col("n_own") == 0), F.col("n_lectures")),
        ("gap with plan", (F.col("status") == "gap") & (F.col("n_planned") > 0), F.col("n_planned")),
        ("ageing rival", (F.col("n_rival") > 0) & (old >= 4), old.cast("long")),
    ]
    out = None
    for kind, test, value in groups:
        rows = cats.filter(test).select(F.lit(kind).alias("kind"), "category", value.alias("value")).orderBy(F.desc("value"), "category").limit(top)
        out = rows if out is None else out.unionByName(rows)
    return out


def search(cats: DataFrame, titles: DataFrame, status: str = "all", text: str = "") -> DataFrame:
    """Categories of a status ('planning': with a title still in planning) whose name or titles contain ``text``."""
    rows = cats if status == "all" else cats.filter("n_planning > 0") if status == "planning" else cats.filter(F.col("status") == status)
    if not text:
        return rows
    has = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    named = titles.filter(has(F.col("title"))).select(F.col("category").alias("_c")).distinct()
    return rows.join(named, F.col("category") == F.col("_c"), "left").filter(has(F.col("category")) | F.col("_c").isNotNull()).drop("_c")


def ordered(cats: DataFrame, mode: str = "gap") -> DataFrame:
    """Categories by 'gap' (status, then rivals), 'rivals', 'own', 'lectures', 'planned' or 'name' (Korean order)."""
    rank = F.when(F.col("status") == "gap", 0).when(F.col("status") == "behind", 1).when(F.col("status") == "leading", 2).otherwise(3)
    keys = {
        "gap": [rank, F.desc("n_rival")],
        "rivals": [F.desc("n_rival")],
        "own": [F.desc("n_own")],
        "lectures": [F.desc("n_lectures")],
        "planned": [F.desc("n_planned")],
        "name": [F.collate("category", "ko")],
    }[mode]
    return cats.orderBy(*keys, "category")


def timeline(planned: DataFrame) -> DataFrame:
    """month, planning, publishing, undated last."""
    month = F.coalesce(F.nullif(month_label(F.col("month")), F.lit("")), F.lit(UNDATED))
    thinking = F.coalesce(F.col("status") == PLANNING, F.lit(False))
    rows = planned.groupBy(month.alias("month")).agg(F.count_if(thinking).alias("planning"), F.count_if(~thinking).alias("publishing"))
    return rows.orderBy(F.col("month") == UNDATED, "month")


def workload(planned: DataFrame, months: Sequence[str], without_planning: bool = False) -> DataFrame:
    """team, a count for each of ``months``, overloaded (months with three or more), busy (months with two)."""
    rows = planned.filter(F.coalesce(F.col("status") != PLANNING, F.lit(True))) if without_planning else planned
    label = month_label(F.col("month"))
    counts = rows.groupBy("team").agg(*[F.count_if(label == m).alias(m) for m in months])
    return counts.withColumns({"overloaded": sum((F.when(F.col(f"`{m}`") >= 3, 1).otherwise(0) for m in months), F.lit(0)), "busy": sum((F.when(F.col(f"`{m}`") == 2, 1).otherwise(0) for m in months), F.lit(0))})


def matching_authors(mart: DataFrame, category: str) -> DataFrame:
    """name, topics of authors whose name or topics contain a word of the category's name (two letters at least)."""
    words = [w for w in category.lower().replace("/", " ").split() if len(w) >= 2]
    hay = F.lower(F.concat_ws(" ", "name", F.array_join("topics", " ")))
    test = F.lit(False)
    for w in words:
        test |= F.contains(hay, F.lit(w))
    return mart.filter(test).select("name", "topics")
