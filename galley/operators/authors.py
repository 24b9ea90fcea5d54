"""Authors of ranked titles: parsing the author field, the author mart, its filters and orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import fixed
from galley.functions.dictionary import all_labels
from galley.operators.snapshots import known_rank


def people(field: Column, bare: bool = False) -> Column:
    """array<struct<name, role>> of an author field.

    Parts stand between slashes. A part that ends in a role mark after a space, or is nothing else, has that role;
    with ``bare`` the space may be missing (and a name that ends so loses its end). Other parts are
    authors. Names stand between commas; shorter than two characters they are skipped.
    """

    def one(part: Column) -> Column:
        p = F.trim(part)
        role, name = None, None
        for mark in fixed.ROLES:
            meant = F.lit(fixed.AUTHOR if mark == fixed.ROLES[0] else mark)
            rest = F.trim(F.substring(p, F.lit(1), F.length(p) - len(mark)))
            hit = F.endswith(p, F.lit(mark)) if bare else (F.endswith(p, F.lit(f" {mark}")) | (p == mark))
            role = F.when(hit, meant) if role is None else role.when(hit, meant)
            name = F.when(hit, rest) if name is None else name.when(hit, rest)
        names = F.filter(F.transform(F.split(name.otherwise(p), ","), lambda n: F.trim(n)), lambda n: F.length(n) >= 2)
        return F.transform(names, lambda n: F.struct(n.alias("name"), role.otherwise(F.lit(fixed.AUTHOR)).alias("role")))

    return F.flatten(F.transform(F.split(F.coalesce(field, F.lit("")), "/"), one))


def books(snaps: DataFrame, bare: bool = False) -> DataFrame:
    """name, title, publisher, best_rank (999 without any), appearances (rows), last_date of each author's titles."""
    rows = snaps.withColumn("p", F.explode(people(F.col("author"), bare))).filter(F.col("p.role") == fixed.AUTHOR)
    first = F.min_by(F.trim("publisher"), F.struct("date", F.coalesce(known_rank(), F.lit(2**31 - 1)), "publisher"))
    rows = rows.groupBy(F.col("p.name").alias("name"), F.trim("title").alias("title"))
    return rows.agg(first.alias("publisher"), F.coalesce(F.min(F.when(F.col("rank") > 0, F.col("rank"))), F.lit(999)).alias("best_rank"), F.count("*").alias("appearances"), F.max("date").alias("last_date"))


def author_mart(author_books: DataFrame, topics: Mapping[str, Sequence[str]] = fixed.TOPICS) -> DataFrame:
    """name, books (best first), publishers (sorted), n_books, best_rank, total_days, topics of all titles."""
    row = F.struct("best_rank", "title", "publisher", F.col("appearances").alias("days"), "last_date")
    mart = author_books.groupBy("name").agg(
        F.array_sort(F.collect_list(row)).alias("books"),
        F.array_sort(F.filter(F.collect_set("publisher"), lambda p: p != "")).alias("publishers"),
        F.count("*").alias("n_books"),
        F.min("best_rank").alias("best_rank"),
        F.sum("appearances").alias("total_days"),
    )
    return mart.withColumn("topics", all_labels(F.array_join(F.col("books.title"), " "), topics))


def ordered(mart: DataFrame) -> DataFrame:
    """Most books first, then most days, then the best rank, then the name."""
    return mart.orderBy(F.desc("n_books"), F.desc("total_days"), "best_rank", "name")


def filtered(mart: DataFrame, publisher: str | None = None, topic: str | None = None, text: str | None = None) -> DataFrame:
    """Authors of a publisher and topic whose name, titles or publishers contain ``text``."""
    out = mart
    if publisher is not None:
        out = out.filter(F.array_contains("publishers", publisher))
    if topic is not None:
        out = out.filter(F.array_contains("topics", topic))
    if text:
        has = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
        out = out.filter(has(F.col("name")) | F.exists("books", lambda b: has(b["title"])) | F.exists("publishers", has))
    return out


def page(mart: DataFrame, key: str = "n_books", descending: bool = True, number: int = 0, rows: int = 30) -> DataFrame:
    """A page of the mart by ``key``; for best_rank the better (smaller) counts as the larger."""
    down = descending != (key == "best_rank")
    return mart.orderBy(F.desc(key) if down else F.asc(key), "name").offset(number * rows).limit(rows)


def pool_stats(mart: DataFrame) -> DataFrame:
    """authors, with_topics, distinct_topics."""
    tagged = mart.agg(F.count("*").alias("authors"), F.count_if(F.size("topics") > 0).alias("with_topics"), F.size(F.array_distinct(F.flatten(F.collect_set("topics")))).cast("long").alias("distinct_topics"))
    return tagged


def relevance(mart: DataFrame, terms: Sequence[str], top: int = 50) -> DataFrame:
    """name, relevance: 2 for each topic that is one of ``terms``, else 1 if a term contains it or lies in it."""
    low = [t.lower() for t in terms]

    def score(topic: Column) -> Column:
        t = F.lower(topic)
        part = F.lit(False)
        for term in low:
            part |= F.contains(t, F.lit(term)) | F.contains(F.lit(term), t)
        return F.when(t.isin(low), 2).when(part, 1).otherwise(0)

    total = F.aggregate(F.transform("topics", score), F.lit(0), lambda a, b: a + b)
    return mart.select("name", total.alias("relevance"), "n_books").orderBy(F.desc("relevance"), F.desc("n_books"), "name").limit(top)


def pool_filtered(pool: DataFrame, text: str = "", kind: str = "", manager: str = "", published: str = "") -> DataFrame:
    """Authors (name, tags, manager, kind, published) of a pool kept by hand.

    ``text`` lies in the name, tags or manager, in any case; ``kind`` in the kind; the manager is equal. ``published``
    lies in the column of that name; '미' asks for those that have nothing out.
    """
    has = lambda c, x: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(x.lower()))
    test = F.lit(True)
    if text:
        test &= has("name", text) | has("tags", text) | has("manager", text)
    if kind:
        test &= F.contains(F.coalesce("kind", F.lit("")), F.lit(kind))
    if manager:
        test &= F.coalesce(F.col("manager") == manager, F.lit(False))
    if published:
        out = F.coalesce("published", F.lit(""))
        test &= ~F.contains(out, F.lit("출간")) if published == "미" else F.contains(out, F.lit(published))
    return pool.filter(test)
