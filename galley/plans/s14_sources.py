"""Queries of sources and sinks: files and feeds made from tables are read back whole, and sinks are read after writing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.operators import proofread as pr, structure
from galley.plans import office, s2_news
from galley.session import table
from galley.sources import archives, feeds, sinks
from galley.streaming import ingest


def _folder(spark) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-galley-")
    return f"{root}/galley-plans-{uuid.uuid4().hex}"


def _parts(spark, sf_dir):
    """Parts with a place in their file (a brand's, of a thousand numbers) and a date a brand."""
    p = table(spark, sf_dir, "part")
    p = p.withColumn("file", F.floor(F.col("p_partkey") / 1000)).withColumn("k", F.row_number().over(W.partitionBy("p_brand", "file").orderBy("p_partkey")))
    date = F.date_add(F.lit("2024-01-01").cast("date"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int"))
    return p.withColumn("date", date).withColumn("price", F.floor("p_retailprice").cast("int"))


_PARTS = "p AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY p_partkey) AS k, p_partkey // 1000 AS file, DATE '2024-01-01' + regexp_extract(p_brand, '(\\d+)', 1)::INTEGER AS date, floor(p_retailprice)::INTEGER AS price FROM part)"


def _sheet(rows, header, cells, suffix):
    """A workbook a file of parts: its header, then its rows in order."""
    row = F.array(*[c.cast("string") for c in cells])
    held = rows.groupBy("p_brand", "file", "date").agg(F.array_sort(F.collect_list(F.struct("k", row.alias("row")))).alias("r"))
    body = F.transform("r", lambda x: x["row"])
    data = F.concat(F.array(F.array(*map(F.lit, header))), body) if header else body
    name = F.concat(F.date_format("date", "yyyyMMdd"), F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("-"), F.col("file").cast("string"), F.lit(suffix))
    return office.made(held.select(name.alias("name"), "date", data.alias("data")), "xlsx")


def _ranked(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    title = F.when(F.col("k") % 9 == 0, "x").otherwise(F.col("p_name"))  # too short for a title
    rank = F.when(F.col("k") % 5 == 0, "none").otherwise(F.concat("k", F.lit(".0")))
    files = _sheet(rows, ("Rank", "도서명 (전체)", "저자", "출판사", "정가"), (rank, title, F.col("p_type"), F.col("p_brand"), F.col("price")), ".xlsx")
    return archives.spreadsheets(archives.dated(files.drop("date"))).select("date", "rank", "title", "author", "publisher", F.col("price").cast("int").alias("price"))


def _listing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(""), F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("_a"), F.lit(".xlsx"))
    name = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("20249999"), F.lit("_a.xlsx"))).otherwise(name)
    return archives.dated(o.select("o_orderkey", name.alias("name"))).select("o_orderkey", "name", "date")


def _isbn(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    isbn = F.when(F.col("k") % 4 == 0, "None").when(F.col("k") % 7 == 0, " ").otherwise(F.concat(F.lit("'979"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"), F.lit("'")))
    rank = F.when(F.col("k") % 5 == 0, "-").otherwise(F.col("k").cast("string"))
    price = F.when(F.col("k") % 6 == 0, "?").otherwise(F.concat(F.format_number("price", 0), F.lit("원")))
    files = _sheet(rows, ("순위", "ISBN", "제목", "저자", "출판사", "정가"), (rank, isbn, F.col("p_name"), F.col("p_type"), F.col("p_brand"), price), ".xlsx")
    return archives.isbn_snapshots(archives.dated(files.drop("date"))).select("date", "isbn", "rank", "title", "publisher", "price")


def _best_by_header(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    title = F.when(F.col("k") % 8 == 0, "").when(F.col("k") % 3 == 0, F.concat("p_name", F.lit(" (2021)"))).otherwise(F.col("p_name"))
    year = F.when(F.col("k") % 2 == 0, F.concat(F.lit("20"), F.lpad((F.col("p_size") % 30).cast("string"), 2, "0"), F.lit("년 3월")))
    cells = (F.when(F.col("k") % 5 > 0, F.col("k")), title, F.col("p_type"), F.col("p_brand"), F.concat(F.format_number("price", 0), F.lit("점")), year)
    return archives.bestsellers(_sheet(rows, ("순위", "상품명", "저자", "출판사", "세일즈포인트", "발행일"), cells, ".xlsx")).drop("name")


def _best_by_content(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    publisher = F.element_at(F.array(F.lit("한빛미디어"), F.lit("길벗"), F.lit("제이펍")), (F.col("k") % 3 + 1).cast("int"))
    cells = (F.col("k"), F.concat(F.lit("The book of the "), "p_name"), F.col("p_type"), publisher, F.concat(F.format_number("price", 0), F.lit("원")))
    return archives.bestsellers(_sheet(rows, (), cells, ".xlsx")).drop("name")


def _lectures(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    cells = (F.lit("site"), F.lit("wide"), F.col("p_type"), F.when(F.col("k") % 4 > 0, F.col("p_name")), F.concat(F.lit("수강생 "), F.format_number("price", 0), F.lit("명")))
    return archives.lectures(_sheet(rows, ("서비스", "전체 카테고리", "카테고리", "강의명", "인기도"), cells, ".xlsx")).drop("name")


def _planned(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    month = F.when(F.col("k") % 3 == 0, "2026년03월").when(F.col("k") % 3 == 1, "2026년 04월")
    cells = (F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.lit("someone"), month, F.lit("집필중"))
    return archives.planned(_sheet(rows, ("도서명", "분류", "담당팀", "저자", "출간월", "진행상태"), cells, ".xlsx")).drop("name")


def _feeds(spark, sf_dir, atom):
    a = s2_news.articles(spark, sf_dir).withColumn("ts", F.col("date").cast("timestamp"))
    esc = lambda c: feeds.escaped(F.concat(c, F.lit(" <b>&</b> more")))
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+09:00'") if atom else F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    when = F.when(F.col("event_id") % 11 == 0, "soon").when(F.col("event_id") % 7 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(when)
    if atom:
        x = F.concat(F.lit("<a:entry><a:title>"), esc(F.col("title")), F.lit('</a:title><a:link rel="self" href="'), "link", F.lit('"/><a:updated>'), when, F.lit("</a:updated><a:summary>"), "summary", F.lit("</a:summary></a:entry>"))
    else:
        x = F.concat(F.lit("<item><title><![CDATA["), "title", F.lit("]]></title><link>"), "link", F.lit("</link><pubDate>"), when, F.lit("</pubDate><description>"), esc(F.col("summary")), F.lit("</description></item>"))
    rows = a.select(F.concat_ws("-", "source", F.floor(F.col("event_id") / 5000)).alias("feed_id"), "event_id", x.alias("x"))
    held = rows.groupBy("feed_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "x"))).alias("i"))
    return feeds.feed_items(held.select("feed_id", F.concat(F.lit("<channel>"), F.array_join("i.x", "\n"), F.lit("</channel>")).alias("xml")), per_feed=30)


_FEED = """a AS (SELECT *, source || '-' || (event_id // 5000) AS feed_id, row_number() OVER (PARTITION BY source, event_id // 5000 ORDER BY event_id) - 1 AS place FROM (SELECT event_id, 'https://n.example/' || (event_id * 7 % 3001) AS link, 's' || (user_id % 21) AS source,
  'New ' || event_type || ' release' AS title, 'data k' || coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) AS summary, ts::DATE AS date FROM events))"""


def _scraped(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    shown = F.date_format("d", "MMM d, yyyy")
    inside = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<span>"), shown, F.lit("</span>"))).otherwise("")
    before = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("<p>"), shown, F.lit("</p>"))).otherwise("<p>no date</p>")
    title = F.when(F.col("o_orderkey") % 6 == 0, "abc").otherwise(F.concat(F.lit("News "), F.col("o_orderkey").cast("string")))
    link = F.concat(F.lit("/news/"), (F.col("o_orderkey") % 1000).cast("string"))
    a = F.concat(before, F.lit("<a class=x href='"), link, F.lit("?q=1'><h3>"), title, F.lit("</h3>"), inside, F.lit("<p>first line</p><p>of "), F.col("o_orderpriority"), F.lit("</p></a>"))
    rows = o.withColumn("url", F.concat(F.lit("u"), F.floor(F.col("o_custkey") / 20).cast("string"))).select("url", "o_orderkey", a.alias("a"))
    held = rows.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "a"))).alias("i"))
    return feeds.scraped_links(held.select("url", F.array_join("i.a", "\n").alias("html")), "/news/", back=60)


def _repositories(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x = F.concat(F.lit("<article class='b'><h2 class=h><a href=\"/own /"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit('">x</a></h2><p class="c">A <b>'), "p_type", F.lit("</b>   thing</p><span itemprop=\"programmingLanguage\">"), "p_brand", F.lit(" </span></article>"))
    rows = p.select(F.floor(F.col("p_partkey") / 50).cast("string").alias("url"), "p_partkey", x.alias("x")).groupBy("url").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "x"))).alias("i"))
    return feeds.repositories(rows.select("url", F.array_join("i.x", "").alias("html"))).withColumn("place", F.col("place").cast("long"))


def _csv(spark, sf_dir):
    path = _folder(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit('say "'), "source", F.lit('", then'))).alias("note"))
    sinks.write_csv(d.filter("text is not null"), path)
    back = feeds.csv(spark, path)
    return back.select(F.col(back.columns[0]).cast("long").alias("doc_id"), F.md5(F.regexp_replace("text", r"\s+$|^\s+", "").cast("binary")).alias("text_md5"), F.coalesce("note", F.lit("")).alias("note"))


def _json(spark, sf_dir):
    path = _folder(spark)
    schema = "event_id long, link string, source string, title string, date date, keywords array<string>"
    none = feeds.archive(spark, f"{path}-none", schema)
    sinks.write_json(s2_news.articles(spark, sf_dir).select("event_id", "link", "source", "title", "date", "keywords"), path)
    lines = spark.read.schema(schema).json(path)
    return none.unionByName(lines).select("event_id", "link", "date", F.array_join("keywords", "|").alias("keywords"))


def _archive(spark, sf_dir):
    """A write by date, then one of a single date again with other rows: only that date changes."""
    path = _folder(spark)
    a = s2_news.articles(spark, sf_dir).select("event_id", "source", "date")
    sinks.write_archive(a, path, "date")
    sinks.write_archive(a.filter("date = '2024-01-05'").withColumn("source", F.lit("again")), path, "date")
    return spark.read.parquet(path).groupBy("date", (F.col("source") == "again").alias("again")).agg(F.count("*").alias("n"))


def _report(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean")).orderBy("c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")
    text = sinks.report("Market", [("Segments", c, ["segment", "n", "mean"]), ("Nations", n, ["key", "name"])], ["done"], limit=10)
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line long, text string")


def _cells(spark, sf_dir):
    """Each customer's orders as an answer of a spreadsheet service, in one of its four shapes."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))).alias("x"))
    head = F.array(F.lit("key"), F.lit("status"))
    rows = F.transform("x", lambda r: F.array(r["key"].cast("string"), r["status"]))
    label = lambda t: F.struct(F.lit(t).alias("label"))
    dated = F.transform("x", lambda r: F.struct(F.array(F.struct(r["key"].cast("string").alias("v"), F.lit(None).cast("string").alias("f")), F.struct(F.lit("Date(2024,0,1)").alias("v"), r["status"].alias("f"))).alias("c")))
    shapes = (
        F.to_json(F.concat(F.array(head), rows)),
        F.to_json("x"),
        F.to_json(F.struct(head.alias("headers"), rows.alias("data"))),
        F.concat(F.lit("call("), F.to_json(F.struct(F.struct(F.array(label("key"), label("status")).alias("cols"), dated.alias("rows")).alias("table"))), F.lit(");")),
    )
    raw = F.element_at(F.array(*shapes), (F.col("o_custkey") % 4 + 1).cast("int"))
    out = feeds.answer_cells(o.select("o_custkey", raw.alias("raw")))
    return out.select("o_custkey", F.col("line").cast("long").alias("line"), F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))


def _documents(spark, sf_dir):
    """doc_id and paragraphs of whole documents: (kind, text) for the makers, headings and code among them."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    lines = d.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", ""), "\n")).alias("k", "t")).filter("trim(t) <> ''")
    kinds = F.element_at(F.array(*map(F.lit, ("heading1", "body", "code", "numbered", "bullet", "bold", "heading2"))), (F.col("k") % 7 + 1).cast("int"))
    return lines.select("doc_id", "k", kinds.alias("kind"), F.regexp_replace("t", "\r", "").alias("text"))


def _made(spark, sf_dir, kind):
    rows = _documents(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "kind", "text"))).alias("p"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("." + kind))
    return office.made(rows.select(name.alias("name"), F.lit(None).cast("date").alias("date"), F.transform("p", lambda x: F.struct(x["kind"], x["text"])).alias("data")), kind)


def _texts(kind):
    def query(spark, sf_dir):
        out = archives.documents(_made(spark, sf_dir, kind))
        return out.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "error")

    return query


def _elements(kind):
    def query(spark, sf_dir):
        e = archives.elements(_made(spark, sf_dir, kind))
        e = e.withColumn("drawing", F.col("drawing").isNotNull())
        return e.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("doc_id"), "pos", structure.paragraph_kind().alias("kind"), F.length("text").alias("size"), "bold")

    return query


def _unsupported(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, ".hwp").when(F.col("n_nationkey") % 3 == 1, ".docx").otherwise(".odt")).alias("name"), F.lit("no zip").cast("binary").alias("content"))
    return archives.documents(n).select("name", F.col("text").isNull().alias("no_text"), F.substring_index("error", ":", 1).alias("error"))


def _old_docs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.repeat(F.lit("가나다라 마바사 아자차카 "), (F.col("p_size") % 20).cast("int"))
    files = office.made(p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".doc")).alias("name"), F.lit(None).cast("date").alias("date"), text.alias("data")), "doc")
    return archives.documents(files).select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("p_partkey"), F.length("text").alias("size"))


def _source_tree(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    folder = F.element_at(F.array(*map(F.lit, ("src", "node_modules", "lib/build", "rebuild", ".git", "app"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".py", ".txt", ".js", ".md"))), (F.col("p_size") % 4 + 1).cast("int"))
    path = F.concat(F.lit("file:/r/"), folder, F.lit("/"), F.col("p_partkey").cast("string"), ending)
    return feeds.sources_among(p.select(path.alias("path"), F.col("p_name").alias("content"))).select("path", "folder", "filename")


def _stream(spark, sf_dir):
    """Articles in files, one link in several: the archive after two runs of the stream."""
    path = _folder(spark)
    a = s2_news.articles(spark, sf_dir).select("link", "source", "title", F.col("date").cast("timestamp").alias("ts"), "keywords")
    a.repartition(3).write.json(f"{path}/in")
    for _ in range(2):
        ingest.into_archive(ingest.arriving(spark, f"{path}/in", files_per_trigger=1), f"{path}/archive", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/archive").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("link").alias("links"))


def _stream_weeks(spark, sf_dir):
    path = _folder(spark)
    s2_news.articles(spark, sf_dir).select("link", "source", "title", F.col("date").cast("timestamp").alias("ts"), "keywords").write.json(f"{path}/in")
    sums = ingest.weekly_keywords(ingest.arriving(spark, f"{path}/in"), s2_news.feeds(spark))
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")
    sums.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.to_date("week_start").alias("week_start"), "keyword", "points")


def _first_sightings(spark, sf_dir):
    path = _folder(spark)
    s2_news.articles(spark, sf_dir).select(F.when(F.col("event_id") % 10 > 0, F.col("link")).otherwise("").alias("link"), "source", "title", F.col("date").cast("timestamp").alias("ts"), "keywords").coalesce(1).write.json(f"{path}/in")
    seen = ingest.first_sightings(ingest.arriving(spark, f"{path}/in"), "60 days")
    seen.select("id", "link").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("id").agg(F.min("link").alias("link"), F.count("*").alias("n"))


def _corrected(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    words = spark.createDataFrame([("the ", "THE "), ("the end", "x"), ("und", "&"), ("", "y")], "found string, suggestion string")
    return pr.corrected(d, d.filter("doc_id % 3 > 0").select("doc_id").crossJoin(F.broadcast(words)), "[", "]").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _index_groups(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("term")).agg(F.array_sort(F.collect_set(F.col("p_size"))).alias("pages"))
    return sinks.index_groups(p).select("grp", "lines")


QUERIES = {
    "s14_dated_files": _listing,
    "s14_spreadsheets": _ranked,
    "s14_isbn_snapshots": _isbn,
    "s14_bestsellers_by_header": _best_by_header,
    "s14_bestsellers_by_content": _best_by_content,
    "s14_lectures": _lectures,
    "s14_planned": _planned,
    "s14_rss": lambda spark, sf_dir: _feeds(spark, sf_dir, False),
    "s14_atom": lambda spark, sf_dir: _feeds(spark, sf_dir, True),
    "s14_scraped_links": _scraped,
    "s14_repositories": _repositories,
    "s14_csv": _csv,
    "s14_json_archive": _json,
    "s14_archive_by_date": _archive,
    "s14_report": _report,
    "s14_table_rows": _cells,
    "s14_docx_text": _texts("docx"),
    "s14_hwpx_text": _texts("hwpx"),
    "s14_docx_elements": _elements("docx"),
    "s14_hwpx_elements": _elements("hwpx"),
    "s14_unsupported": _unsupported,
    "s14_old_docs": _old_docs,
    "s14_source_tree": _source_tree,
    "s14_stream_archive": _stream,
    "s14_stream_weeks": _stream_weeks,
    "s14_stream_first_sightings": _first_sightings,
    "s14_corrected": _corrected,
    "s14_index_groups": _index_groups,
}

_DOCS = """ln AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) - 1 AS k FROM (SELECT doc_id, string_split(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{fffe}\\x{ffff}]', '', 'g'), chr(10)) AS t FROM documents WHERE text IS NOT NULL)),
x AS (SELECT doc_id, k, replace(t, chr(13), '') AS text, ['heading1', 'body', 'code', 'numbered', 'bullet', 'bold', 'heading2'][k % 7 + 1] AS kind FROM ln WHERE trim(t) <> '')"""
_KINDS = "CASE kind WHEN 'bold' THEN {body} WHEN 'body' THEN {body} {extra} ELSE kind END"
_BODY = "CASE WHEN regexp_matches(text, '^\\s*[•·▪◦\\-]\\s') THEN 'bullet' WHEN regexp_matches(text, '^(?:그림|표|Figure|Table)\\s*\\d') THEN 'caption' WHEN regexp_matches(text, '^(?:TIP|NOTE|참고|주의|여기서 잠깐)') THEN 'note' ELSE 'body' END"

ORACLES = {
    "s14_dated_files": """SELECT o_orderkey, name, try_strptime(substr(name, 1, 8), '%Y%m%d')::DATE AS date FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '20249999_a.xlsx' ELSE
        CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END || strftime(o_orderdate, '%Y%m%d') || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '_a' END || '.xlsx' END AS name FROM orders) WHERE regexp_matches(name, '^\\d{8}') AND try_strptime(substr(name, 1, 8), '%Y%m%d') IS NOT NULL""",
    "s14_spreadsheets": f"WITH {_PARTS} SELECT date, CASE WHEN k % 5 = 0 THEN 0 ELSE k END::INTEGER AS rank, p_name AS title, p_type AS author, p_brand AS publisher, price FROM p WHERE k % 9 > 0",
    "s14_isbn_snapshots": f"WITH {_PARTS} SELECT date, '979' || lpad(p_partkey::VARCHAR, 10, '0') AS isbn, CASE WHEN k % 5 = 0 THEN 999 ELSE k END::INTEGER AS rank, p_name AS title, p_brand AS publisher, CASE WHEN k % 6 = 0 THEN 0 ELSE price END AS price FROM p WHERE k % 4 > 0 AND k % 7 > 0",
    "s14_bestsellers_by_header": f"""WITH {_PARTS} SELECT k AS rank, CASE WHEN k % 3 = 0 THEN p_name || ' (2021)' ELSE p_name END AS title, p_brand AS publisher, p_type AS author, price::BIGINT AS sales,
        CASE WHEN k % 2 = 0 THEN 2000 + p_size % 30 WHEN k % 3 = 0 THEN 2021 ELSE 0 END::INTEGER AS year FROM p WHERE k % 8 > 0""",
    "s14_bestsellers_by_content": f"WITH {_PARTS} SELECT k AS rank, 'The book of the ' || p_name AS title, ['한빛미디어', '길벗', '제이펍'][k % 3 + 1] AS publisher, p_type AS author, price::BIGINT AS sales, 0 AS year FROM p",
    "s14_lectures": f"WITH {_PARTS} SELECT 'site' AS service, 'wide' AS cat1, p_type AS cat2, p_name AS title, price::BIGINT AS popularity FROM p WHERE k % 4 > 0",
    "s14_planned": f"WITH {_PARTS} SELECT p_name AS title, p_type AS category, p_brand AS team, 'someone' AS author, CASE k % 3 WHEN 0 THEN '2026년 03월' WHEN 1 THEN '2026년 04월' ELSE '' END AS month, '집필중' AS status FROM p",
    "s14_rss": f"WITH {_FEED} SELECT feed_id, place::INTEGER AS place, title, link, CASE WHEN event_id % 11 > 0 THEN date END AS date, summary || ' & more' AS summary FROM a WHERE place < 30",
    "s14_atom": f"WITH {_FEED} SELECT feed_id, place::INTEGER AS place, title || ' & more' AS title, link, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN date ELSE date - 1 END AS date, summary FROM a WHERE place < 30",
    "s14_scraped_links": """WITH o AS (SELECT 'u' || (o_custkey // 20) AS url, o_orderkey, '/news/' || (o_orderkey % 1000) AS link, o_orderdate::DATE AS d, o_orderpriority AS p FROM orders WHERE o_orderkey % 6 > 0)
        SELECT url, link, 'News ' || o_orderkey AS title, 'first line of ' || p AS summary, d AS date FROM o QUALIFY row_number() OVER (PARTITION BY url, link ORDER BY o_orderkey) = 1""",
    "s14_repositories": """SELECT (p_partkey // 50)::VARCHAR AS url, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS place, 'own/' || replace(p_name, ' ', '-') AS repo, 'A ' || p_type || ' thing' AS description, p_brand AS language FROM part""",
    "s14_csv": """SELECT doc_id, md5(regexp_replace(text, '\\s+$|^\\s+', '', 'g')) AS text_md5, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'say "' || source || '", then' END AS note FROM documents WHERE text IS NOT NULL""",
    "s14_json_archive": f"WITH {_FEED} SELECT a.event_id, link, date, event_type || '|k' || (coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) % 9 + day(ts) % 3) AS keywords FROM a JOIN events USING (event_id)",
    "s14_archive_by_date": f"WITH {_FEED} SELECT date, date = DATE '2024-01-05' AS again, count(*) AS n FROM a GROUP BY 1, 2",
    "s14_report": """WITH c AS (SELECT '| ' || c_mktsegment || ' | ' || count(*) || ' | ' || format('{:.1f}', avg(c_acctbal)) || ' |' AS t FROM customer GROUP BY c_mktsegment ORDER BY c_mktsegment),
        n AS (SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS t FROM nation ORDER BY n_nationkey LIMIT 10),
        l AS (SELECT ['# Market', '', '## Segments', '', '| segment | n | mean |', '| --- | --- | --- |'] || (SELECT list(t ORDER BY t) FROM c) || ['', '## Nations', '', '| key | name |', '| --- | --- |'] || (SELECT list(t ORDER BY t) FROM n) || ['', '(the first 10 rows)', '', '## Notes', '', '- done', ''] AS l)
        SELECT generate_subscripts(l, 1) - 1 AS line, unnest(l) AS text FROM l""",
    "s14_table_rows": "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, o_orderkey::VARCHAR AS a, o_orderstatus AS b FROM orders UNION ALL SELECT DISTINCT o_custkey, 0, 'key', 'status' FROM orders",
    "s14_docx_text": f"WITH {_DOCS} SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY k)) AS text_md5, NULL::VARCHAR AS error FROM x GROUP BY doc_id",
    "s14_hwpx_text": f"WITH {_DOCS} SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY k)) AS text_md5, NULL::VARCHAR AS error FROM x GROUP BY doc_id",
    "s14_docx_elements": f"WITH {_DOCS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS pos, {_KINDS.format(body=_BODY, extra='')} AS kind, len(text)::INTEGER AS size, kind = 'bold' AS bold FROM x",
    "s14_hwpx_elements": f"WITH {_DOCS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS pos, {_KINDS.format(body=_BODY, extra='')} AS kind, len(text)::INTEGER AS size, false AS bold FROM (SELECT doc_id, k, text, CASE WHEN kind NOT LIKE 'heading%' AND regexp_matches(trim(text), '^(?:\\d+\\.\\s|제?\\s*\\d+\\s*절)') THEN 'heading2' WHEN kind = 'bullet' THEN 'body' ELSE kind END AS kind FROM x)",
    "s14_unsupported": "SELECT n_name || CASE n_nationkey % 3 WHEN 0 THEN '.hwp' WHEN 1 THEN '.docx' ELSE '.odt' END AS name, true AS no_text, CASE n_nationkey % 3 WHEN 1 THEN 'BadZipFile' ELSE 'unsupported format' END AS error FROM nation",
    "s14_old_docs": "SELECT p_partkey, CASE WHEN n >= 100 THEN n ELSE 0 END::INTEGER AS size FROM (SELECT p_partkey, len(trim(repeat('가나다라 마바사 아자차카 ', p_size % 20))) AS n FROM part)",
    "s14_source_tree": """SELECT * FROM (SELECT 'file:/r/' || f || '/' || p_partkey || e AS path, regexp_extract(f, '([^/]*)$', 1) AS folder, p_partkey || e AS filename FROM (SELECT p_partkey, ['src', 'node_modules', 'lib/build', 'rebuild', '.git', 'app'][p_partkey % 6 + 1] AS f, ['.py', '.txt', '.js', '.md'][p_size % 4 + 1] AS e FROM part)
        WHERE f IN ('src', 'rebuild', 'app') AND e IN ('.py', '.js'))""",
    "s14_stream_archive": f"WITH {_FEED}, f AS (SELECT DISTINCT link FROM a) SELECT count(*) AS n, count(*) AS ids, count(*) AS links FROM f",
    "s14_stream_weeks": f"""WITH {_FEED}, k AS (SELECT a.date, source, unnest([event_type, 'k' || (coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) % 9 + day(ts) % 3)]) AS keyword FROM a JOIN events USING (event_id))
        SELECT date_trunc('week', date)::DATE AS week_start, keyword, sum(CASE WHEN source = 's20' THEN 1.0 ELSE [0.5, 1.0, 1.5, 2.0][substr(source, 2)::INTEGER % 4 + 1] END)::DOUBLE AS points FROM k GROUP BY ALL""",
    "s14_stream_first_sightings": f"WITH {_FEED} SELECT substr(md5(link), 1, 12) AS id, link, 1::BIGINT AS n FROM a WHERE event_id % 10 > 0 GROUP BY link",
    "s14_corrected": "SELECT doc_id, md5(CASE WHEN doc_id % 3 > 0 THEN replace(replace(replace(text, 'the end', '[x]'), 'the ', '[THE ]'), 'und', '[&]') ELSE text END) AS text_md5 FROM documents WHERE text IS NOT NULL",
    "s14_index_groups": """WITH t AS (SELECT p_type AS term, array_to_string(list_sort(list_distinct(list(p_size))), ', ') AS pages FROM part GROUP BY 1)
        SELECT upper(substr(term, 1, 1)) AS grp, string_agg(term || chr(9) || pages, chr(10) ORDER BY term) AS lines FROM t GROUP BY 1""",
}
