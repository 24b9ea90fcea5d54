"""Queries of paged services, exports, reports as files, and upkeep by late articles; all are made from tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.functions import rules
from galley.operators import classify, proofread, reports
from galley.plans import gate, s2_news, s3_authors, s7_texts, s14_sources
from galley.plans.s14_sources import _folder, _made, _parts, _sheet
from galley.session import settled, table
from galley.sources import feeds, functions, paged, sinks
from galley.streaming import ingest, state

#: Customers on a page of the service, and what its two keys may spend; the large one pays for a table of any size.
ON_PAGE = 25
KEYS = '{"small": 9, "large": 1000000000000}'
SHELVES = "galley.sources.paged:PageShelves"


def _pages(spark, sf_dir):
    """Customers as items of a service: a query a market segment, a page for each 25 numbers."""
    c = table(spark, sf_dir, "customer")
    token = F.lpad(F.floor(F.col("c_custkey") / ON_PAGE).cast("string"), 8, "0")
    return c.select(F.col("c_mktsegment").alias("query"), token.alias("token"), F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))).alias("item"))


def _summed(rows):
    read = rows.filter("state = 'read'").withColumn("id", F.get_json_object("item", "$.id").cast("long"))
    return read.groupBy("query").agg(F.count("*").alias("items"), F.sum("id").alias("ids"), F.count_distinct("token").alias("pages"), F.count_if(F.col("key") == "small").alias("by_small"))


def _paged_service(spark, sf_dir):
    path = _folder(spark)
    paged.write_shelves(_pages(spark, sf_dir), path)
    spark.dataSource.register(paged.PagedSource)
    return _summed(spark.read.format("paged").options(path=path, keys=KEYS, transport=SHELVES).load())


def _paged_stream(spark, sf_dir):
    """The service read as a stream that stops and goes on after pages have been added."""
    path = _folder(spark)
    spark.dataSource.register(paged.PagedSource)
    rows = _pages(spark, sf_dir)
    middle = F.lit("00000003")
    for part in (rows.filter(F.col("token") < middle), rows.filter(F.col("token") >= middle)):
        paged.write_shelves(part, f"{path}/pages")
        stream = spark.readStream.format("paged").options(path=f"{path}/pages", keys='{"k": 1000000000000}', transport=SHELVES).load()
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _summed(spark.read.parquet(f"{path}/out")).drop("by_small")


def _session(spark, sf_dir):
    """Events as session entries with credentials at three depths; what the export holds of each."""
    path = _folder(spark)
    e = table(spark, sf_dir, "events")
    secret = F.concat(F.lit("s"), F.col("event_id").cast("string"))
    inner = F.struct(secret.alias("password"), F.col("event_type").alias("type"))
    s = e.select("event_id", secret.alias("apiKey"), F.struct(secret.alias("Token"), F.col("user_id").alias("user"), F.array(inner, inner).alias("steps")).alias("state"), F.create_map(F.lit("SECRET"), secret, F.lit("kind"), F.col("event_type")).alias("settings"))
    sinks.write_session(s, path)
    back = spark.read.schema("event_id long, apiKey string, state struct<Token: string, user: long, steps: array<struct<password: string, type: string>>>, settings map<string, string>").json(path)
    leaks = F.col("apiKey").isNotNull() | F.col("state.Token").isNotNull() | F.exists("state.steps", lambda x: x["password"].isNotNull()) | F.map_contains_key("settings", "SECRET")
    return back.select("event_id", F.col("state.user").alias("user"), F.array_join("state.steps.type", "|").alias("types"), F.col("settings")["kind"].alias("kind"), leaks.alias("leaks"))


def _late_weeks(spark, sf_dir):
    """Weekly points kept by a stream whose files hold the weeks in mixed order, so that most weeks are revised."""
    path = _folder(spark)
    a = s2_news.articles(spark, sf_dir).groupBy("link").agg(F.min_by(F.struct("source", "title", "date", "keywords"), F.struct("date", "event_id")).alias("a"))
    a = a.select("link", "a.source", "a.title", F.col("a.date").cast("timestamp").alias("ts"), "a.keywords")
    a.repartition(3, F.crc32(F.col("link").cast("binary"))).write.json(f"{path}/in")
    for _ in range(2):  # the second run finds nothing new
        ingest.into_weeks(ingest.arriving(spark, f"{path}/in", files_per_trigger=1), s2_news.feeds(spark), f"{path}/archive", f"{path}/weeks", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/weeks").select("week_start", "keyword", "points")


def _report_files(spark, sf_dir):
    """The texts of documents as Markdown files in a folder: an index with title, date and summary of each, by what stands in them."""
    path = _folder(spark)
    sinks.write_files(s7_texts.report_texts(spark, sf_dir), path)
    # kept before they are sorted, as a sort reads its input once for the ranges and once for the rows
    known = settled(reports.metadata(feeds.markdown(spark, path), ordered=False).select("filename", "title", "date", "summary"))
    return sinks.report_index(known).select("id", "filename", "title", "date", "summary")


def _author_files(spark, sf_dir):
    """The author mart in its three places; what each of them says."""
    path = _folder(spark)
    mart = s3_authors._mart(lambda m: m)(spark, sf_dir)
    sinks.write_mart(mart, f"{path}/authors.json", [f"{path}/authors.js", f"{path}/panel/authors.js"], "_AUTHORS_DATA")
    plain = spark.read.schema(mart.schema).json(f"{path}/authors.json").select(F.lit("json").alias("place"), "name", "n_books", "best_rank")
    scripts = [sinks.read_scripts(spark, p, "_AUTHORS_DATA", mart.schema).select(F.lit(place).alias("place"), "name", "n_books", "best_rank") for place, p in (("js", f"{path}/authors.js"), ("panel", f"{path}/panel/authors.js"))]
    return plain.unionByName(scripts[0]).unionByName(scripts[1])


def _rises(spark, sf_dir):
    """The first day on which each keyword has been seen often enough within a week, told by a stream with state."""
    path = _folder(spark)
    a = s2_news.articles(spark, sf_dir).select("link", "source", "title", F.col("date").cast("timestamp").alias("ts"), "keywords")
    a.coalesce(1).write.json(f"{path}/in")
    before = spark.conf.get(state.ROCKS[0], None)
    spark.conf.set(*state.ROCKS)
    try:
        out = state.rises(ingest.arriving(spark, f"{path}/in"), least=OFTEN)
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(state.ROCKS[0]) if before is None else spark.conf.set(state.ROCKS[0], before)
    return spark.read.schema(state.RISES).parquet(f"{path}/out").filter("event = 'rise'").select("keyword", "day", "n")


def _sql_documents(spark, sf_dir):
    """Word documents read by SQL."""
    functions.register(spark)
    _made(spark, sf_dir, "docx").createOrReplaceTempView("office_files_of_documents")
    rows = spark.sql("SELECT name, text, error FROM office_rows(TABLE(office_files_of_documents), 'text')")
    return rows.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "error")


def _sql_sheets(spark, sf_dir):
    """Workbooks of parts read by SQL line by line, the files of a name in one task."""
    functions.register(spark)
    p = _parts(spark, sf_dir)
    _sheet(p, ("Rank", "Title", "Price"), (F.col("k"), F.col("p_name"), F.col("price")), ".xlsx").createOrReplaceTempView("office_files_of_parts")
    return spark.sql("""
        SELECT regexp_extract(name, '_(.*)[.]xlsx', 1) AS brand, line, cells[0] AS a, cells[1] AS b, cells[2] AS c
        FROM office_rows(TABLE(office_files_of_parts) PARTITION BY (name), 'cells')""")


def _many_subjects(spark, sf_dir):
    """Customers' names under 67 subjects of two words each, the first that a name mentions."""
    subjects = {f"subject {i}": (f"{i:02}7", f"9{i:02}") for i in range(67)}
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", classify.category(F.col("c_name"), subjects, otherwise="none").alias("category"))


def _gate(spark, sf_dir):
    """The sentences of the gate, one before each part's name: how many slips all rules together find, and how many clean ones they accuse."""
    rows = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(kind).alias("type"), F.lit(found).alias("found")) for t, kind, found in gate.SENTENCES])
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", F.element_at(rows, (F.col("p_partkey") % len(gate.SENTENCES) + 1).cast("int")).alias("s"))
    # some hundreds of rules cost far more than reading a row, and a table of short rows is few splits of a file
    p = p.repartition(SPREAD * spark.sparkContext.defaultParallelism, "doc_id")
    pages = p.select("doc_id", F.lit(1).alias("page"), F.concat_ws(" ", "s.text", "p_name").alias("text"))
    issues = proofread.scan(pages, rules.EVERY).select("doc_id", "type", "found").unionByName(proofread.repeated_words(pages).select("doc_id", "type", "found"))
    return proofread.confusion(p.select("doc_id", "s.type", "s.found"), issues)


#: Tasks for each core where short rows cost much.
SPREAD = 4
#: Sightings within a week that make a rise.
OFTEN = 20

QUERIES = {
    "s16_gate": _gate,
    "s16_rises": _rises,
    "s16_sql_documents": _sql_documents,
    "s16_sql_sheets": _sql_sheets,
    "s16_many_subjects": _many_subjects,
    "s16_paged_service": _paged_service,
    "s16_paged_stream": _paged_stream,
    "s16_session_export": _session,
    "s16_late_weeks": _late_weeks,
    "s16_report_files": _report_files,
    "s16_author_files": _author_files,
}

_PAGES = f"g AS (SELECT c_mktsegment AS query, c_custkey // {ON_PAGE} AS token, c_custkey AS id FROM customer)"
ORACLES = {
    "s16_gate": "SELECT count(*) FILTER (p_partkey % 40 < 30) AS detected, 0::BIGINT AS missed, 0::BIGINT AS false_positives, count(*) FILTER (p_partkey % 40 >= 30) AS clean FROM part",
    "s16_rises": f"""WITH k AS (SELECT ts::DATE AS date, unnest([event_type, 'k' || (coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) % 9 + day(ts) % 3)]) AS keyword FROM events),
        d AS (SELECT keyword, date, count(*) AS n FROM k GROUP BY ALL), w AS (SELECT keyword, date, sum(n) OVER (PARTITION BY keyword ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS n FROM d)
        SELECT keyword, date AS day, n::BIGINT AS n FROM w WHERE n >= {OFTEN} QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY date) = 1""",
    "s16_sql_documents": s14_sources.ORACLES["s14_docx_text"],
    "s16_sql_sheets": f"""WITH {s14_sources._PARTS} SELECT replace(p_brand, '#', '') || '-' || file AS brand, k::INTEGER AS line, k::VARCHAR AS a, p_name AS b, price::VARCHAR AS c FROM p
        UNION ALL SELECT DISTINCT replace(p_brand, '#', '') || '-' || file, 0, 'Rank', 'Title', 'Price' FROM p""",
    "s16_many_subjects": """SELECT c_custkey, coalesce('subject ' || (SELECT min(i) FROM range(67) AS r(i) WHERE contains(c_name, lpad(i::VARCHAR, 2, '0') || '7') OR contains(c_name, '9' || lpad(i::VARCHAR, 2, '0'))), 'none') AS category FROM customer""",
    "s16_paged_service": f"""WITH {_PAGES}, o AS (SELECT query, token, row_number() OVER (ORDER BY token, query) AS n FROM (SELECT DISTINCT query, token FROM g))
        SELECT query, count(*) AS items, sum(id)::BIGINT AS ids, count(DISTINCT token) AS pages, count(*) FILTER (n <= 9) AS by_small FROM g JOIN o USING (query, token) GROUP BY query""",
    "s16_paged_stream": f"WITH {_PAGES} SELECT query, count(*) AS items, sum(id)::BIGINT AS ids, count(DISTINCT token) AS pages FROM g GROUP BY query",
    "s16_session_export": "SELECT event_id, user_id AS user, event_type || '|' || event_type AS types, event_type AS kind, false AS leaks FROM events",
    "s16_late_weeks": """WITH e AS (SELECT 'https://n.example/' || (event_id * 7 % 3001) AS link, 's' || (user_id % 21) AS source, ts::DATE AS date, event_id,
          [event_type, 'k' || (coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) % 9 + day(ts) % 3)] AS keywords FROM events),
        a AS (SELECT link, arg_min(source, (date, event_id)) AS source, min(date) AS date, arg_min(keywords, (date, event_id)) AS keywords FROM e GROUP BY link)
        SELECT date_trunc('week', date)::DATE AS week_start, keyword, sum(CASE WHEN source = 's20' THEN 1.0 ELSE [0.5, 1.0, 1.5, 2.0][substr(source, 2)::INTEGER % 4 + 1] END)::DOUBLE AS points
        FROM (SELECT date, source, unnest(keywords) AS keyword FROM a) GROUP BY ALL""",
    "s16_report_files": f"WITH {s7_texts.REPORTS} SELECT id, filename, title, date, summary FROM rp",
    "s16_author_files": f"WITH {s3_authors._B} SELECT place, name, n_books, best_rank FROM m0, (VALUES ('json'), ('js'), ('panel')) AS x(place)",
}
