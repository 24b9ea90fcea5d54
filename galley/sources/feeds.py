"""Readers of news feeds, scraped pages, CSV and JSON as they come from outside, and of plain files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators.listings import excluded
from galley.session import local_path

PER_FEED = 30
SUMMARY = 300


def feed_date(raw: Column) -> Column:
    """RFC 822, ISO with an offset or Z, or a plain date; else a date in the first ten characters, else null."""
    text = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
    zone = F.regexp_replace(text, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    ways = [F.try_to_timestamp(zone, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")]
    return F.coalesce(*[F.to_date(w) for w in ways], F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def stripped(html: Column, size: int = SUMMARY) -> Column:
    """Text without tags, single spaces, cut."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", ""), r"\s+", " ")), 1, size)


def _first(xml: Column, *tags: str) -> Column:
    """Content of the first of ``tags`` in an element's source, with CDATA opened and entities read."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{t}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{t}>", 1), F.lit("")) for t in tags])
    out = F.regexp_replace(found, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(out)


def escaped(text: Column) -> Column:
    """Text as it stands in HTML; '' for null."""
    out = F.coalesce(text, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def feed_items(feeds: DataFrame, per_feed: int = PER_FEED) -> DataFrame:
    """feed_id, place, title, link, date, summary of RSS items and Atom entries; the first ``per_feed`` of a feed.

    ``feeds`` has feed_id and xml. Titles and links may be missing, dates are null where they can't be read.
    """
    items = F.regexp_extract_all("xml", F.lit(r"(?s)<(?:\w+:)?(?:item|entry)[\s>].*?</(?:\w+:)?(?:item|entry)>"), F.lit(0))
    rows = feeds.select("feed_id", F.posexplode(F.slice(items, 1, per_feed)).alias("place", "x"))
    x = F.col("x")
    href = F.nullif(F.regexp_extract(x, r"<(?:\w+:)?link\s[^>]*href=[\"']([^\"']+)", 1), F.lit(""))
    return rows.select("feed_id", "place", stripped(_first(x, "title")).alias("title"), F.coalesce(_first(x, "link"), href).alias("link"), feed_date(_first(x, "pubDate", "date", "published", "updated")).alias("date"), stripped(_first(x, "description", "summary", "content")).alias("summary"))


def scraped_links(pages: DataFrame, prefix: str, shortest: int = 5, back: int = 300) -> DataFrame:
    """url, link, title, summary, date of the anchors under ``prefix`` in scraped pages (url, html), once a link.

    The lines of an anchor's text are its title, then its summary; the date is one in the text, else the last in the
    ``back`` characters before the anchor.
    """
    pattern = rf"(?s)(.{{0,{back}}}?)<a\s[^>]*href=[\"']({re.escape(prefix)}[^\"'#?]+)[^>]*>(.*?)</a>"
    hits = F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    rows = pages.select("url", F.posexplode(hits).alias("place", "x"))
    part = lambda k: F.regexp_extract("x", pattern, k)
    lines = F.filter(F.transform(F.split(F.regexp_replace(part(3), r"<[^>]+>", "\n"), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    word = r"([A-Z][a-z]{2} \d{1,2}, \d{4})"
    dates = F.coalesce(F.nullif(F.regexp_extract(part(3), word, 1), F.lit("")), F.nullif(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(part(1), F.lit(word), F.lit(1))), -1), F.lit("")))
    text = F.filter(lines, lambda s: ~s.rlike(f"^{word}$"))
    rows = rows.select("url", "place", part(2).alias("link"), F.get(text, F.lit(0)).alias("title"), F.array_join(F.slice(text, F.lit(2), F.greatest(F.size(text), F.lit(1))), " ").alias("summary"), F.try_to_date(dates, "MMM d, yyyy").alias("date"))
    rows = rows.filter(F.length("title") >= shortest)
    once = rows.groupBy("url", "link").agg(F.min_by(F.struct("title", "summary", "date"), "place").alias("r"))
    return once.select("url", "link", "r.*")


def repositories(pages: DataFrame) -> DataFrame:
    """url, place, repo, description, language of the article blocks of a page of trending repositories."""
    rows = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<article.*?</article>"), F.lit(0))).alias("place", "x"))
    repo = F.regexp_replace(F.regexp_extract("x", r"(?s)<h2.*?href=[\"']/([^\"']+)", 1), r"\s", "")
    description = stripped(F.regexp_extract("x", r"(?s)<p[^>]*>(.*?)</p>", 1))
    return rows.select("url", "place", repo.alias("repo"), description.alias("description"), F.trim(F.regexp_extract("x", r"programmingLanguage[\"'][^>]*>([^<]+)", 1)).alias("language")).filter("repo <> ''")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with quoted line breaks, doubled quotes and a byte order mark; rows with nothing in them go."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.filter(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in rows.columns]).isNotNull())


def archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON archive with a schema; an empty table where there is no file yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def answer_cells(answers: DataFrame, column: str = "raw") -> DataFrame:
    """``answers`` with line (from 0) and cells (array of strings) of each row of a spreadsheet service's answer, header first.

    An answer is an array of arrays, an array of objects, an object with values or with headers and data, or a table of
    cols and rows wrapped in a call. It is read as a variant, so answers of all shapes pass through the same
    expressions, none through the driver. A cell without a value is '', a date shows its formatted text; the columns of objects
    are their keys in order of first appearance. What isn't JSON, nulls included, gives no rows.
    """
    text = F.regexp_extract(column, r"(?s)([\[{].*[\]}])", 1)
    v, held = F.col("_v"), answers.withColumn("_text", text).withColumn("_v", F.try_parse_json("_text"))
    get = lambda x, path, kind: F.try_variant_get(x, path, kind)
    many = "array<variant>"
    cell = lambda x: F.coalesce(get(x, "$", "string"), F.lit(""))
    cells = lambda r: F.transform(get(r, "$", many), cell)
    rows = lambda x: F.transform(x, cells)
    maps = F.from_json("_text", "array<map<string, string>>")  # keeps the keys in their order
    names = F.array_distinct(F.flatten(F.transform(F.filter(maps, lambda m: m.isNotNull()), F.map_keys)))
    objects = F.concat(F.array(names), F.transform(maps, lambda m: F.transform(names, lambda n: F.coalesce(m[n], F.lit("")))))
    shown = lambda c: F.when(F.startswith(get(c, "$.v", "string"), F.lit("Date(")), F.coalesce(get(c, "$.f", "string"), F.lit(""))).otherwise(F.coalesce(get(c, "$.v", "string"), F.lit("")))
    head = F.transform(get(v, "$.table.cols", many), lambda c: F.coalesce(get(c, "$.label", "string"), F.lit("")))
    body = F.transform(get(v, "$.table.rows", many), lambda r: F.transform(get(r, "$.c", many), shown))
    titles = F.transform(get(v, "$.headers", many), cell)
    valued = rows(F.coalesce(get(v, "$.values", many), get(v, "$.data", many), F.array().cast(many)))
    found = (
        F.when(get(v, "$.table", "variant").isNotNull(), F.concat(F.array(head), body))
        .when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.when(F.size(titles) > 0, F.concat(F.array(titles), valued)).otherwise(valued))
        .when(F.startswith(F.schema_of_variant(get(v, "$[0]", "variant")), F.lit("OBJECT")), objects)
        .otherwise(rows(get(v, "$", many)))
    )
    return held.select(*answers.columns, F.posexplode(found).alias("line", "cells"))


def sources_among(files: DataFrame, endings: tuple[str, ...] = (".py", ".js", ".java", ".html", ".css", ".ts")) -> DataFrame:
    """path, folder, filename, content of the source files among ``files`` (path, content), without vendored ones."""
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lit(False)
    for e in endings:
        wanted |= F.endswith(name, F.lit(e))
    return files.filter(wanted & ~excluded(F.col("path"))).select("path", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), name.alias("filename"), "content")


def source_files(spark: SparkSession, path: str, endings: tuple[str, ...] = (".py", ".js", ".java", ".html", ".css", ".ts")) -> DataFrame:
    """path, folder, filename, content of the source files under a folder, without vendored ones."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return sources_among(rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")), endings)


#: Tasks for each core that read files, and about how many bytes of texts one holds at once.
SPLITS, READ_BYTES = 16, 1 << 22


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """filename, content of the Markdown files under a folder, but for folders whose names begin with a dot; empty files have ''.

    A task lists what lies in the folder and in its folders, and others list and read what is below, so that the driver holds no
    names; it needs a file system that all share. Under a path of another kind Spark lists the files on the driver, without empty ones and hidden ones.
    """
    import pyarrow as pa

    tasks = SPLITS * spark.sparkContext.defaultParallelism
    folder = local_path(path)
    if folder is None:
        # Spark puts some thirty small files in a split; a task takes many splits, one after the other
        rows = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(path, wholetext=True).coalesce(tasks)
        return rows.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = (p for batch in batches for _ in range(batch.num_rows) for p in _two_levels(folder))
        while paths := list(islice(below, 1024)):
            yield pa.record_batch({"path": pa.array(paths, pa.string())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, size = [], [], 0
        full = lambda: pa.record_batch({"filename": pa.array(names, pa.string()), "content": pa.array(texts, pa.binary())})
        for batch in batches:
            for file in (f for p in batch.column(0) for f in _markdown_under(p.as_py())):
                with open(file, "rb") as opened:
                    texts.append(opened.read())
                names.append(os.path.basename(file))
                size += len(texts[-1]) + len(names[-1])
                if size >= READ_BYTES:
                    yield full()
                    names, texts, size = [], [], 0
        yield full()

    paths = spark.range(0, 1, 1, 1).mapInArrow(listed, "path string").repartition(tasks, "path")
    return paths.mapInArrow(read, "filename string, content binary").select("filename", F.col("content").cast("string").alias("content"))


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """The Markdown files of a folder, and its folders whose names don't begin with a dot."""
    with os.scandir(folder) as entries:
        yield from (e for e in entries if (not e.name.startswith(".") if e.is_dir() else e.name.endswith(".md")))


def _two_levels(folder: str) -> Iterator[str]:
    """The Markdown files of a folder, and what lies in its folders."""
    for e in _entries(folder):
        yield from (b.path for b in _entries(e.path)) if e.is_dir() else (e.path,)


def _markdown_under(path: str) -> Iterator[str]:
    """A file itself, or the Markdown files at any depth under a folder."""
    if not os.path.isdir(path):
        yield path
        return
    for e in _entries(path):
        yield from _markdown_under(e.path)


def tolerant_json(raw: str | None) -> str | None:
    """The JSON in a model's answer as a clean text, or None.

    Fences and chatter around it go, control characters too; line breaks in strings are escaped, trailing commas
    dropped. A list that breaks off is closed after its last whole item. Numbers of views with commas or a unit behind
    them are made plain; where nothing else helps, a list of the objects that can be read one by one is the answer.
    """
    if not raw:
        return None
    text = re.sub(r"[\ufeff\u200b-\u200d]", "", re.sub(r"```(?:json)?", "", raw))
    text = _VIEWS.sub(lambda m: f'"views": {(m[1] or m[2] or m[3]).replace(",", "")}', text)
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    out, closing, inside, skip = [], [], False, False
    whole: list[tuple[int, list[str]]] = []  # where an item of a list ended, and what was open there
    for c in text[start:]:
        if inside:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                inside = False
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, c if c >= " " else ""))
            continue
        if c < " " and c not in "\n\r\t":
            continue
        if c == '"':
            inside = True
        elif c in "{[":
            closing.append("}" if c == "{" else "]")
        elif c in "}]":
            if not closing or closing.pop() != c:
                return _objects_alone(text[start:])
        out.append(c)
        if c in "}]":
            whole.append((len(out), list(closing)))
            if not closing:
                break
    options = [("".join(out), [])] if not closing else [("".join(out[:n]), rest) for n, rest in reversed(whole)]
    for body, rest in options:
        candidate = re.sub(r",\s*([}\]])", r"\1", body + "".join(reversed(rest)))
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False)
        except ValueError:
            continue
    return _objects_alone(text[start:])


#: A number of views with a unit behind it or commas in it.
_VIEWS = re.compile(r'"views"\s*:\s*(?:"?(\d[\d,]*)\s*[가-힣A-Za-z]+"?|"?(\d[\d,]*)"\s*[가-힣A-Za-z]+|(?=\d{1,3},\d{3})(\d[\d,]*\d))')


def _objects_alone(text: str) -> str | None:
    """A JSON list of the objects without others around them that can be read, None without any."""
    found, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                body = re.sub(r",\s*([}\]])", r"\1", re.sub(r"[\x00-\x1f]", " ", text[start : i + 1]))
                try:
                    found.append(json.loads(body))
                except ValueError:
                    continue
    return json.dumps(found, ensure_ascii=False) if found else None


def parsed_answers(answers: DataFrame, schema: str, column: str = "raw") -> DataFrame:
    """``answers`` with json (clean text, null where there is none) and value (of ``schema``)."""
    import pandas as pd

    def read(raw: pd.Series) -> pd.Series:
        return raw.map(tolerant_json)

    read.__annotations__ = {"raw": pd.Series, "return": pd.Series}
    clean = F.pandas_udf(read, "string")
    return answers.withColumn("json", clean(F.col(column))).withColumn("value", F.from_json("json", schema))


def scraped_fields(raw: Column, keys: tuple[str, ...]) -> Column:
    """map<string, string> of the ``keys`` whose texts can be picked out of broken JSON."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.nullif(F.regexp_extract(raw, rf'"{k}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit("")).alias("value")) for k in keys])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
