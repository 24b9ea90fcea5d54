"""Document structure: elements in order, runs of one kind, outline numbers, lines from positioned items, virtual pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged_runs(elements: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Elements (doc_id, pos, type, text) with neighbours of one of ``kinds`` as one: doc_id, pos, type, n, items.

    A run begins where the type changes or is not among ``kinds``; the number of beginnings so far names it.
    """
    w = W.partitionBy("doc_id").orderBy("pos")
    begins = ~F.col("type").isin(*kinds) | F.coalesce(F.col("type") != F.lag("type").over(w), F.lit(True))
    rows = elements.withColumn("_run", F.sum(begins.cast("int")).over(w))
    out = rows.groupBy("doc_id", "_run").agg(F.min("pos").alias("pos"), F.first("type").alias("type"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_i"))
    return out.select("doc_id", "pos", "type", "n", F.col("_i.text").alias("items"))


def outline_numbers(entries: DataFrame, fill: bool = False, deepest: int = 5) -> DataFrame:
    """Entries (doc_id, pos, level) with number, '1.2.3'; a level restarts below each new one above it.

    The count of a level since the last entry above it is a window sum, so no state is carried by hand. With ``fill``
    levels that were skipped count as 1, else as 0.
    """
    rows = entries.withColumn("level", F.greatest(F.lit(1), F.least(F.col("level"), F.lit(deepest))))
    w = W.partitionBy("doc_id").orderBy("pos")
    parts = []
    for k in range(1, deepest + 1):
        section = f"_s{k}"
        rows = rows.withColumn(section, F.sum((F.col("level") < k).cast("int")).over(w))
        inside = W.partitionBy("doc_id", section).orderBy("pos")
        count = F.sum((F.col("level") == k).cast("int")).over(inside)
        rows = rows.withColumn(f"_n{k}", F.greatest(count, F.lit(1)) if fill else count)
        parts.append(F.when(F.col("level") >= k, F.col(f"_n{k}").cast("string")))
    number = F.array_join(F.array_compact(F.array(*parts)), ".")
    return rows.select(*[c for c in rows.columns if not c.startswith("_")], number.alias("number"))


def upper_medians(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """``keys`` and median: the element at floor(n / 2) of each group's sorted values, so nothing is interpolated.

    Equal values are counted first, and running sums over the counts find the place, so no group is held as a list.
    Nulls don't count.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy("_v"))
    placed = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(w))
    return placed.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min("_v").alias("median"))


def page_lines(items: DataFrame, tolerance: float = 3.0, em: float = 0.25, tab: float | None = None) -> DataFrame:
    """Positioned items (doc_id, page, x, y, width, font_size, str) as lines: doc_id, page, line, y, x, text.

    Items follow y downwards, then x. A line begins where y lies more than ``tolerance`` below its first item, an anchor
    that only a fold over the page can know; a page's items are few, so the fold runs over an array of them. A gap wider than
    ``em`` of the font size puts a space, one wider than ``tab`` points, where that is given, a tab.
    """
    item = F.struct((-F.col("y")).alias("down"), "x", "width", "font_size", "str")
    pages = items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(float("-inf")).alias("anchor"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("lines"))

    def step(state: Column, i: Column) -> Column:
        new = i["down"] - state["anchor"] > tolerance
        n = F.when(new, state["n"] + 1).otherwise(state["n"])
        return F.struct(F.when(new, i["down"]).otherwise(state["anchor"]).alias("anchor"), n.alias("n"), F.concat(state["lines"], F.array(n)).alias("lines"))

    lines = F.aggregate("items", start, step, lambda s: s["lines"])
    rows = pages.withColumn("lines", lines).select("doc_id", "page", F.inline(F.arrays_zip("items", "lines"))).select("doc_id", "page", F.col("lines").alias("line"), "items.*")
    w = W.partitionBy("doc_id", "page", "line").orderBy("x", "down")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    between = F.when(gap > em * F.col("font_size"), " ").otherwise("")
    if tab is not None:
        between = F.when(gap > tab, "\t").otherwise(between)
    rows = rows.withColumn("piece", F.concat(between, F.col("str")))
    out = rows.groupBy("doc_id", "page", "line").agg(F.max(-F.col("down")).alias("y"), F.min("x").alias("x"), F.array_sort(F.collect_list(F.struct("x", "down", "piece"))).alias("p"))
    return out.select("doc_id", "page", "line", "y", "x", F.array_join(F.col("p.piece"), "").alias("text"))


def virtual_pages(texts: DataFrame, size: int = 1500) -> DataFrame:
    """Texts (doc_id, text) as pages: doc_id, page, text. Paragraphs fill a page until it has ``size`` characters."""
    paragraphs = F.filter(F.split("text", r"\n\s*\n"), lambda p: F.trim(p) != "")
    start = F.struct(F.array().cast("array<string>").alias("pages"), F.lit("").alias("held"))

    def step(s: Column, p: Column) -> Column:
        held = F.when(s["held"] == "", p).otherwise(F.concat(s["held"], F.lit("\n\n"), p))
        full = F.length(held) >= size
        return F.struct(F.when(full, F.concat(s["pages"], F.array(held))).otherwise(s["pages"]).alias("pages"), F.when(full, F.lit("")).otherwise(held).alias("held"))

    pages = F.aggregate(paragraphs, start, step, lambda s: F.when(s["held"] == "", s["pages"]).otherwise(F.concat(s["pages"], F.array(s["held"]))))
    return texts.select("doc_id", F.posexplode(pages).alias("page", "text")).withColumn("page", F.col("page") + 1)


def element_counts(elements: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id and the number of elements of each kind."""
    return elements.groupBy("doc_id").agg(*[F.count_if(F.col("type") == k).alias(k) for k in kinds])


def figure_check(elements: DataFrame, mention: str = r"(?i)(?:그림|figure)\s*(\d+(?:[-.]\d+)?)") -> DataFrame:
    """doc_id, mentioned, figures: distinct figure numbers in the text against figure elements."""
    named = elements.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(mention), F.lit(1))).alias("n")).groupBy("doc_id").agg(F.countDistinct("n").alias("mentioned"))
    there = elements.groupBy("doc_id").agg(F.count_if(F.col("type") == "figure").alias("figures"))
    return there.join(named, "doc_id", "left").select("doc_id", F.coalesce("mentioned", F.lit(0)).alias("mentioned"), "figures")


def section_size(sections: DataFrame, line: int = 40, page: int = 35) -> DataFrame:
    """doc_id, characters, lines, pages (to one decimal, rounded up) of sections (doc_id, level, title, summary, intro, body).

    A heading takes 4, 3 or 2.5 lines by its level, 2 below; a summary a line more than its own, an intro and a body
    two more; parts that are empty take none.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = lambda c, more: F.when(filled(c) == "", 0).otherwise(more + F.aggregate(F.split(filled(c), "\n"), F.lit(0).cast("long"), lambda n, p: n + F.greatest(F.ceil(F.length(p) / line), F.lit(1))))
    level = F.coalesce("level", F.lit(1))
    heading = F.when(level == 1, 4.0).when(level == 2, 3.0).when(level == 3, 2.5).otherwise(2.0)
    size = F.length(F.regexp_replace(F.concat(*map(filled, ("title", "summary", "intro", "body"))), r"\s", ""))
    sums = sections.groupBy("doc_id").agg(F.sum(size).alias("characters"), F.sum(heading + own("summary", 1) + own("intro", 2) + own("body", 2)).alias("lines"))
    return sums.withColumn("pages", F.ceil(F.round(F.col("lines") / page * 10, 6)) / 10)


def manuscript_size(texts: DataFrame, line: int = 40, page: int = 35) -> DataFrame:
    """doc_id, characters (without white space), lines (of ``line`` characters, one a paragraph at least), pages."""
    lines = F.aggregate(F.split("text", "\n"), F.lit(0).cast("long"), lambda n, p: n + F.greatest(F.ceil(F.length(p) / line), F.lit(1)))
    rows = texts.select("doc_id", F.length(F.regexp_replace("text", r"\s", "")).cast("long").alias("characters"), lines.alias("lines"))
    return rows.withColumn("pages", F.ceil(F.col("lines") / page))


# Ordered rules for the kind of a paragraph: the first that holds names it.
def paragraph_kind() -> Column:
    """The type of a paragraph (style, text, numbered, bullet, font, drawing): heading, code, list, quote or body."""
    style, text = F.lower(F.coalesce("style", F.lit(""))), F.coalesce("text", F.lit(""))
    heading = F.nullif(F.regexp_extract(style, r"(?:heading|제목|개요)\s*(\d)", 1), F.lit(""))
    return (
        F.when(F.col("drawing"), "figure")
        .when(heading.isNotNull(), F.concat(F.lit("heading"), heading))
        .when(style.rlike("title|표제"), "title")
        .when(F.coalesce("font", F.lit("")).rlike(r"(?i)consol|courier|mono|d2coding|menlo") | style.rlike("code|소스"), "code")
        .when(F.col("numbered"), "numbered")
        .when(F.col("bullet") | text.rlike(r"^\s*[•·▪◦\-]\s"), "bullet")
        .when(style.rlike("quote|인용"), "quote")
        .when(style.rlike("caption|캡션") | text.rlike(r"^(?:그림|표|Figure|Table)\s*\d"), "caption")
        .when(text.rlike(r"^(?:TIP|NOTE|참고|주의|여기서 잠깐)"), "note")
        .when(F.trim(text) == "", "blank")
        .otherwise("body")
    )


def completeness(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """``rows`` with missing (names of empty required columns) and state: empty, partial or done."""
    missing = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in required]))
    return rows.withColumn("missing", missing).withColumn("state", F.when(F.size("missing") == 0, "done").when(F.size("missing") == len(required), "empty").otherwise("partial"))
