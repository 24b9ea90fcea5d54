"""Markdown reports: their title, date and summary, sections and headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metadata(reports: DataFrame, ordered: bool = True) -> DataFrame:
    """Reports (filename, content) with title, date and summary, the newest file name first if ``ordered``.

    title: the first level-one heading, else the file name. date: of the file name, else the first in the text.
    summary: the first quoted line, else the first plain line, cut to 200 characters.
    """
    lines = F.transform(F.split("content", r"\r?\n"), lambda x: F.trim(x))
    first = lambda test: F.get(F.filter(lines, test), F.lit(0))
    title = F.nullif(F.trim(F.regexp_replace(first(lambda x: x.rlike("^# ")), "^# +", "")), F.lit(""))
    quoted = F.trim(F.regexp_replace(first(lambda x: x.rlike("^> *[^ ]")), "^> *", ""))
    plain = first(lambda x: (x != "") & ~x.rlike(r"^(?:[#>|\-*]|\d+\.)"))
    digits = F.regexp_extract("filename", r"^(\d{8})", 1)
    date = F.coalesce(F.try_to_date(F.nullif(digits, F.lit("")), "yyyyMMdd"), F.try_to_date(F.nullif(F.regexp_extract("content", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd"))
    rows = reports.select("filename", F.coalesce(title, F.regexp_replace("filename", r"\.md$", "")).alias("title"), date.alias("date"), F.substring(F.coalesce(quoted, plain), 1, 200).alias("summary"), "content")
    return rows.orderBy(F.desc("filename")) if ordered else rows


def section(content: Column, heading: str) -> Column:
    """The text under the level-two heading that contains ``heading``, up to the next; null without it."""
    parts = F.split(F.concat(F.lit("\n"), content), r"\n(?=## )")
    hit = F.get(F.filter(parts, lambda p: F.contains(F.regexp_extract(p, r"^## ([^\n]*)", 1), F.lit(heading))), F.lit(0))
    return F.trim(F.regexp_replace(hit, r"^## [^\n]*\n?", ""))


def headlines(content: Column) -> Column:
    """The bold texts at the beginnings of numbered or dashed lines."""
    return F.regexp_extract_all(content, F.lit(r"(?m)^\s*(?:\d+\.|-)\s*\*\*(.+?)\*\*"), F.lit(1))


def unread(reports: DataFrame, marker: str | None) -> DataFrame:
    """Reports whose (filename, length) signature is not the reader's marker."""
    signature = F.concat_ws(":", "filename", F.length("content"))
    return reports if marker is None else reports.filter(signature != marker)
