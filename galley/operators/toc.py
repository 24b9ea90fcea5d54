"""Tables of contents against the body: entries (doc_id, entry, title, level, page), pages (doc_id, page, printed, text).

A title is looked for on the pages near its number, nearest first, then near the number plus the document's
offset, then anywhere. A document's titles and pages meet once, in blocks, where each word is looked for once; of all
pages that have a title the best one is kept.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.operators.snapshots import best_of

BAND = 5


def normal_title(text: Column) -> Column:
    """Lower case, letters of ASCII and Hangul and digits only, single spaces."""
    # the ranges between those of letters and digits: Java takes about seven times as long over [^a-z0-9가-힣]
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-/:-`{-\x{ABFF}\x{D7A4}-\x{10FFFF}]+", " "))


def found_in(title: Column, page: Column) -> Column:
    """Whether a normalised title stands on a normalised page.

    As it is; or without spaces, if four characters or more; or two and 60 percent of its words of two characters.
    """
    bare, bare_page = F.replace(title, F.lit(" "), F.lit("")), F.replace(page, F.lit(" "), F.lit(""))
    words = F.filter(F.split(title, " "), lambda w: F.length(w) >= 2)
    # a word has no space, so what stands on the page stands there without its spaces; the outer function makes that text once, not for each word
    hits = F.size(F.get(F.transform(F.array(bare_page), lambda text: F.filter(words, lambda w: F.contains(text, w))), F.lit(0)))
    most = (F.size(words) >= 2) & (hits >= 2) & (hits * 10 >= F.size(words) * 6)
    return (title != "") & (page != "") & (F.contains(page, title) | ((F.length(bare) >= 4) & F.contains(bare_page, bare)) | most)


#: Pages, and titles, of a document that are held against each other at a time.
BLOCK = 512
#: Words that are looked up at a time.
WORDS = 16_384


def _standing(wants: Sequence[str], norms: Sequence[str]) -> Iterator[tuple[int, Sequence[int]]]:
    """The number of each title and of the pages on which it stands as :func:`found_in` says, if any.

    A word is looked for once in all pages, however many titles have it. With two words or more, the other two ways to be
    found need all of them, so the number of words that stand there decides.
    """
    import numpy as np

    bare = [n.replace(" ", "") for n in norms]
    text, starts = "\n".join(bare), list(accumulate((len(x) + 1 for x in bare[:-1]), initial=0))

    def looked_up(words: dict[str, int]):
        there = np.zeros((len(words), len(bare)), np.bool_)
        for word, k in words.items():
            at, held = text.find(word), []
            while at >= 0:
                page = bisect_right(starts, at) - 1
                held.append(page)
                at = text.find(word, starts[page + 1]) if page + 1 < len(starts) else -1
            there[k, held] = True
        return there

    words: dict[str, int] = {}
    asked: list[tuple[int, list[int]]] = []
    for i, want in enumerate(wants):
        spelt = [w for w in want.split(" ") if len(w) >= 2]
        if len(spelt) >= 2:
            asked.append((i, [words.setdefault(w, len(words)) for w in spelt]))
        elif want:
            whole = want.replace(" ", "")
            pages = [k for k, n in enumerate(norms) if want in n or (len(whole) >= 4 and whole in bare[k])]
            if pages:
                yield i, pages
        if asked and (len(words) >= WORDS or i + 1 == len(wants)):
            there = looked_up(words)
            for k, mine in asked:
                hits = there[mine].sum(axis=0, dtype=np.int32)
                pages = np.flatnonzero((hits >= 2) & (hits * 10 >= len(mine) * 6)).tolist()
                if pages:
                    yield k, pages
            words, asked = {}, []


def _met(entries: DataFrame, pages: DataFrame, choose: Callable, made: Mapping[str, str]) -> DataFrame:
    """doc_id, entry and the columns ``made`` of titles (doc_id, entry, want, more) that stand on pages (doc_id, at, norm, more) of their document.

    A document's titles and pages come in blocks of about ``BLOCK``, and each block of titles meets each of pages in one row,
    so the texts are dealt once, not for each page that a title might be on. ``choose`` makes rows of ``made`` from a
    title's columns and those of the pages of a block that have it.
    """
    import pyarrow as pa

    of = {c: entries.schema[c].dataType.simpleString() for c in ("doc_id", "entry")}
    parts = entries.groupBy("doc_id").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    # entries are dealt by hash, as their numbers may be any
    asked = entries.join(parts, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("entry"), "parts").alias("part")).agg(F.collect_list(F.struct(*entries.columns[1:])).alias("titles"))
    held = pages.groupBy("doc_id", F.floor(F.col("at") / BLOCK).alias("part")).agg(F.collect_list(F.struct(*pages.columns[1:])).alias("pages"))
    both = asked.drop("part").join(held.drop("part"), "doc_id")

    def columns(of_lists) -> list[dict[str, list]]:
        flat = of_lists.flatten()
        names = [f.name for f in flat.type]
        all_of = {n: c if n == "entry" else c.to_pylist() for n, c in zip(names, flat.flatten(), strict=True)}
        ends = list(accumulate(of_lists.value_lengths().to_pylist(), initial=0))
        return [{n: c[a:b] for n, c in all_of.items()} for a, b in zip(ends, ends[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                some = batch.slice(first, 64)
                docs, found, rows = [], [], []
                for i, (titles, there) in enumerate(zip(columns(some.column("titles")), columns(some.column("pages")), strict=True)):
                    for k, places in _standing(titles["want"], there["norm"]):
                        chosen = choose(titles, k, there, places)
                        rows += chosen
                        docs += [i] * len(chosen)
                        found += [titles["entry"][k]] * len(chosen)
                if rows:
                    values = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(found, titles["entry"].type), *values], names=["doc_id", "entry", *made])

    types = [{"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[t] for t in made.values()]
    return both.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in (of | dict(made)).items()))


def found_anywhere(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, entry, at of the pages (doc_id, at, norm) on which a title (doc_id, entry, want) stands as :func:`found_in` says."""
    kind = pages.schema["at"].dataType.simpleString()
    every = lambda titles, k, there, places: [(there["at"][p],) for p in places]
    return _met(entries.select("doc_id", "entry", "want"), pages.select("doc_id", "at", "norm").filter("at is not null"), every, {"at": kind}).distinct()


def page_offset(pages: DataFrame) -> DataFrame:
    """doc_id, offset: the commonest difference of page and printed number, the smaller on a tie."""
    counts = pages.filter("printed is not null").groupBy("doc_id", (F.col("page") - F.col("printed")).alias("offset")).agg(F.count("*").alias("n"))
    return best_of(counts, ["doc_id"], [F.desc("n"), F.col("offset")], 1, "_n").select("doc_id", "offset")


def compare(entries: DataFrame, pages: DataFrame, band: int = BAND) -> DataFrame:
    """doc_id, entry, title, page, body_page, difference, status: match, page-mismatch, missing or no-page.

    Titles shorter than two characters are skipped. Equal distances prefer the later page.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    p = pages.join(page_offset(pages), "doc_id", "left").select("doc_id", F.col("page").cast("long").alias("at"), long("printed"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"), normal_title(F.col("text")).alias("norm"))
    e = entries.filter(F.length("title") >= 2).withColumn("want", normal_title(F.col("title")))

    def nearest(titles: dict, k: int, there: dict, places: Sequence[int]) -> list[tuple]:
        # stage 1 is by printed number, 2 by the page less the offset, 3 the first page that has the title
        page, best = titles["page"][k], []
        for at, printed, offset in ((there["at"][i], there["printed"][i], there["offset"][i]) for i in places):
            if printed is not None and printed >= 1 and abs(printed - page) <= band:
                best.append((1, abs(printed - page), printed < page, printed))
            if at is not None:
                number = at - offset
                if number >= 1 and abs(number - page) <= band:
                    best.append((2, abs(number - page), number < page, number))
                best.append((3, at, False, number if number >= 1 else at))
        return [min(best)] if best else []

    made = {"stage": "int", "away": "bigint", "before": "boolean", "body_page": "bigint"}
    hits = _met(e.filter("page is not null").select("doc_id", "entry", long("page"), "want"), p, nearest, made)
    hit = hits.groupBy("doc_id", "entry").agg(F.min(F.struct(*made)).alias("hit")).select("doc_id", "entry", "hit.body_page")
    out = e.join(hit, ["doc_id", "entry"], "left").withColumn("difference", F.abs(F.col("page") - F.col("body_page")))
    status = F.when(F.col("page").isNull(), "no-page").when(F.col("body_page").isNull(), "missing").when(F.col("difference") == 0, "match").otherwise("page-mismatch")
    return out.select("doc_id", "entry", "title", "page", "body_page", "difference", status.alias("status"))


def summary(rows: DataFrame) -> DataFrame:
    """doc_id, matches, mismatches, missing, no_page, percent of matches among entries with a page."""
    n = lambda s: F.count_if(F.col("status") == s)
    sums = rows.groupBy("doc_id").agg(n("match").alias("matches"), n("page-mismatch").alias("mismatches"), n("missing").alias("missing"), n("no-page").alias("no_page"), F.count("*").alias("_n"))
    return sums.withColumn("percent", F.floor(F.col("matches") * 100 / F.nullif(F.col("_n") - F.col("no_page"), F.lit(0)) + 0.5)).drop("_n")


def parsed_line(line: Column) -> Column:
    """struct<title, level, page> of a line of a table of contents; null page without one.

    The page is a number after dots, dashes, two spaces or a tab at the end. The level is that of a leading number
    (1.2.3 is 3), 1 for a part or chapter word, else 2.
    """
    pattern = r"^\s*(.*?)(?:[.·…\-]{2,}\s*|\s{2,}|\t+)(\d{1,4})\s*$"
    page = F.nullif(F.regexp_extract(line, pattern, 2), F.lit(""))
    title = F.trim(F.when(page.isNotNull(), F.regexp_extract(line, pattern, 1)).otherwise(line))
    number = F.regexp_extract(title, r"^(\d+(?:\.\d+)*)\.?\s", 1)
    level = F.when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(5))).when(title.rlike(r"(?i)^(?:part|chapter|제?\s*\d+\s*(?:부|장))"), 1).otherwise(2)
    return F.struct(title.alias("title"), level.alias("level"), page.cast("int").alias("page"))


def kept_headings(headings: DataFrame) -> DataFrame:
    """Headings (doc_id, pos, page, title) without those that repeat the one before on the same or next page."""
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id").orderBy("pos")
    same = (normal_title(F.col("title")) == F.lag(normal_title(F.col("title"))).over(w)) & (F.col("page") - F.lag("page").over(w) <= 1)
    return headings.withColumn("_s", F.coalesce(same, F.lit(False))).filter("not _s").drop("_s")


def outline_lines(texts: DataFrame, longest: int = 100) -> DataFrame:
    """doc_id, line, level, title, memo, pages of the entries in the lines of outlines (doc_id, text).

    Blank lines, rules of signs and comments are skipped. The level is that of a Markdown heading, of a number (1.2.3
    is 3, at most 4), of a list mark by its indent (2 at least), else of the indent, by tabs and four spaces, at most
    5; parts, chapters and appendices are 1. A number of pages at the end ('(30p)', ' 30p') and a memo behind a dash
    are cut off the title. Titles over ``longest`` characters below level 1 are body text.
    """
    lines = texts.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("line", "raw")).withColumn("t", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")))
    lines = lines.filter((F.col("t") != "") & ~F.col("t").rlike(r"^[-=]{3,}$|^//"))
    t = F.col("t")
    indent = F.regexp_extract("raw", r"^(\s*)", 1)
    tabs = F.length(indent) - F.length(F.replace(indent, F.lit("\t"), F.lit("")))
    depth = tabs + F.floor((F.length(indent) - tabs) / 4)
    marks = F.regexp_extract(t, r"^(#{1,5})\s+.", 1)
    dots = F.length(F.regexp_replace(F.regexp_extract(t, r"^(\d+(?:\.\d+){1,3})", 1), r"\d", ""))
    cut = lambda p: F.coalesce(F.nullif(F.trim(F.regexp_replace(t, p, "")), F.lit("")), t)
    named = lambda level, title: F.struct(level.cast("int").alias("level"), title.alias("title"))
    entry = (
        F.when(marks != "", named(F.length(marks), F.trim(F.regexp_replace(t, r"^#{1,5}\s+", ""))))
        .when(t.rlike(r"^\d+장(?![\w가-힣])"), named(F.lit(1), t))
        .when(dots > 0, named(dots + 1, cut(r"^\d+(?:\.\d+){1,3}\.?\s*")))
        .when(t.rlike(r"^\d+\.?\s") & (F.length(t) > 3), named(F.lit(1), cut(r"^\d+\.?\s*")))
        .when(t.rlike(r"^[-*+]\s"), named(F.least(depth + 2, F.lit(5)), F.trim(F.regexp_replace(t, r"^[-*+]\s+", ""))))
        .otherwise(named(F.least(depth + 1, F.lit(5)), t))
    )
    # each step is a row of its own, so that no later one computes it again
    rows = lines.select("doc_id", "line", F.inline(F.array(entry)))
    rows = rows.withColumn("level", F.when(F.col("title").rlike(r"(?i)^(?:PART|부록|Appendix|Chapter|챕터)"), 1).otherwise(F.col("level")))
    bracketed, bare = r"[(\[]\s*(\d+)\s*[pP페이지]*\s*[)\]]\s*$", r"\s+(\d+)\s*[pP]\s*$"
    first, second = (F.nullif(F.regexp_extract("title", p, 1), F.lit("")) for p in (bracketed, bare))
    shorter = F.trim(F.when(first.isNotNull(), F.regexp_replace("title", bracketed, "")).when(second.isNotNull(), F.regexp_replace("title", bare, "")).otherwise(F.col("title")))
    rows = rows.select("doc_id", "line", "level", F.inline(F.array(F.struct(F.coalesce(first, second, F.lit("0")).cast("int").alias("pages"), shorter.alias("title")))))
    dash = F.coalesce(F.nullif(F.regexp_extract("title", r"(\s+—\s+.+)$", 1), F.lit("")), F.nullif(F.regexp_extract("title", r"(\s+-\s+.+)$", 1), F.lit("")))
    rows = rows.select("*", F.explode(F.array(F.when(F.instr("title", dash) > 4, dash))).alias("_d"))
    memo = F.coalesce(F.trim(F.regexp_replace("_d", r"^\s+[—-]\s+", "")), F.lit(""))
    title = F.when(F.col("_d").isNull(), F.col("title")).otherwise(F.trim(F.substring("title", F.lit(1), F.instr("title", F.col("_d")) - 1)))
    rows = rows.select("doc_id", "line", "level", title.alias("title"), memo.alias("memo"), "pages")
    return rows.filter((F.col("title") != "") & ((F.length("title") <= longest) | (F.col("level") == 1)))
