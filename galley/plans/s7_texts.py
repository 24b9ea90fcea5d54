"""Queries over texts: proofreading, contents against body, listings, index terms and structure.

Pages are the lines of documents, or whole documents; rules are ones that both engines can express.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.operators import index_terms, listings, proofread as pr, reports, structure, toc
from galley.plans.standin import in_place
from galley.session import table

RULES = (
    (r"[?!]{2,}", "marks", "high", "one mark"),
    (r",\s*,", "commas", "medium", "one comma"),
    (r"\.{4,}", "dots", "low", "an ellipsis"),
    (r"[#$%&*]{3}", "junk", "low", ""),
)
STYLES = {"formal": r"tion[. ]", "plain": r"he[. ]", "polite": r"en[. ]"}
PARTICLES = {"the": r"the(?=\s)", "of": r"of(?=\s)"}
#: A line that looks like source code: indented, or ended by a sign of its syntax.
CODE = r"^(?: {4}|\t)|[;{}]\s*$"
KINDS = ("user", "assistant", "system")


def lines(spark, sf_dir):
    """doc_id, page, text, printed: a page a line. The printed numbers lag by two to four, every fifth is missing, every seventh wrong."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    page = F.col("page") + 1
    printed = F.when(page % 5 == 0, None).when(page % 7 == 0, page).otherwise(page - 2 - F.col("doc_id") % 3)
    return d.select("doc_id", page.alias("page"), "text", printed.cast("int").alias("printed"))


def _lines(f):
    return lambda spark, sf_dir: f(lines(spark, sf_dir))


def _whole(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.lit(1).alias("page"), "text")


def _styles(f):
    def query(spark, sf_dir):
        counts = pr.style_counts(lines(spark, sf_dir), STYLES)
        return f(counts, pr.mixed_styles(counts, styles=tuple(STYLES)))

    return query


def _elements(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("role").alias("type"), "text", (F.when(F.col("role") == "user", 1).when(F.col("role") == "system", 2).otherwise(3)).alias("level"))


def _entries(spark, sf_dir):
    """The lines of over 30 characters as titles, some without a number, most with a number before the line's; and a title a document that stands nowhere."""
    p = lines(spark, sf_dir)
    number = F.when(F.col("page") % 4 > 0, F.greatest(F.lit(1), F.col("page") - 2 - F.col("page") % 9 * 3))
    long = p.filter("length(text) > 30").select("doc_id", F.col("page").alias("entry"), F.col("text").alias("title"), F.lit(1).alias("level"), number.alias("page"))
    none = p.filter("page = 1").select("doc_id", F.lit(0).alias("entry"), F.lit("zzqx zzqy").alias("title"), F.lit(1).alias("level"), F.when(F.col("doc_id") % 2 == 0, 1).alias("page"))
    return long.unionByName(none)


def _blocks(spark, sf_dir):
    """Benchmark items as printed listings, some lines left out."""
    b = table(spark, sf_dir, "benchmark")
    words = F.filter(F.split("text", r"(?<=\.)\s+"), lambda x: x != "")
    left = F.when(F.col("item_id") % 3 == 0, F.concat(words, F.array(F.lit(None).cast("string")))).otherwise(words)
    return b.select(F.col("item_id").cast("string").alias("block_id"), F.concat(F.lit("f"), (F.col("item_id") % 7).cast("string")).alias("filename"), F.lit(1).alias("page"), left.alias("lines"))


def _files(spark, sf_dir):
    """Documents that hold no benchmark sentence are files too: a line a sentence."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.concat(F.lit("f"), "doc_id").alias("filename"), F.regexp_replace("text", r"(?<=\.)\s+", "\n").alias("content"))


def report_texts(spark, sf_dir):
    """The texts of documents as reports (filename, content); every fifth has a heading and a quotation of its own first line, some names a date, some one that isn't."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "20240229_").when(F.col("doc_id") % 3 == 1, "20240231_").otherwise("r"), F.col("doc_id").cast("string"), F.lit(".md"))
    mine = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("# "), F.substring("text", 1, 20), F.lit("\n> "), F.substring("text", 1, 30), F.lit("\n"))).otherwise("")
    return d.select(name.alias("filename"), F.concat(mine, "text").alias("content"))


def _absent(spark, sf_dir):
    """Benchmark items that refer to every 37th document's file."""
    blocks = _blocks(spark, sf_dir).withColumn("filename", F.concat(F.lit("f"), (F.col("block_id").cast("long") * 37).cast("string")))
    return listings.absent_files(blocks, _files(spark, sf_dir))


def _compared(f):
    def query(spark, sf_dir):
        b, s = _blocks(spark, sf_dir), _files(spark, sf_dir)
        return f(b, s, listings.best_files(b, s))

    return query


QUERIES = {
    "s7_scan": _lines(lambda p: pr.scan(p, RULES).select("doc_id", "page", "rule", "place", "type", "severity", "found")),
    "s7_issue_order": _lines(lambda p: in_place(pr.in_order(pr.scan(p, RULES)).select("doc_id", "page", "type", "found"), "doc_id")),
    "s7_filtered": _lines(lambda p: pr.filtered(pr.scan(p, RULES), "low", text="%%").groupBy("type").agg(F.count("*").alias("n"))),
    "s7_repeated_words": lambda spark, sf_dir: pr.repeated_words(_whole(spark, sf_dir), r"\b(\p{L}{3,})[ \t]+\1\b").select("doc_id", "found"),
    "s7_particle_repeats": _lines(lambda p: pr.particle_repeats(p, PARTICLES, sentence_end=r"\.\s+").groupBy("doc_id", "particle").agg(F.count("*").alias("sentences"), F.sum("n").alias("n"))),
    "s7_style_counts": _styles(lambda c, m: c),
    "s7_mixed_styles": _styles(lambda c, m: m),
    "s7_outlier_pages": _styles(lambda c, m: pr.outlier_pages(c, m, tuple(STYLES))),
    "s7_both_counts": _lines(lambda p: pr.both_counts(p, "the ", "und ", 3)),
    "s7_term_variants": _lines(lambda p: pr.term_variants(p, ("and",))),
    "s7_repeating_lines": _lines(lambda p: pr.repeating_lines(p, share=0.2)),
    "s7_without_lines": _lines(lambda p: pr.without_lines(p, pr.repeating_lines(p, share=0.2)).groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"))),
    "s7_estimated_tokens": lambda spark, sf_dir: _whole(spark, sf_dir).select("doc_id", pr.estimated_tokens(F.col("text")).alias("n")),
    "s7_sampled": _lines(lambda p: pr.sampled(p, words=5)),
    "s7_batches": _lines(lambda p: pr.batches(p, 3).groupBy("doc_id", "batch").agg(F.count("*").alias("pages"), F.max(F.length("before")).alias("before"))),
    "s7_picked_evenly": _lines(lambda p: pr.picked_evenly(p).select("doc_id", "page")),
    "s7_confusion": lambda spark, sf_dir: pr.confusion(_whole(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "junk").alias("type"), F.lit("%%%").alias("found")), pr.scan(_whole(spark, sf_dir), RULES)),
    "s8_compare": lambda spark, sf_dir: toc.compare(_entries(spark, sf_dir), lines(spark, sf_dir)),
    "s8_summary": lambda spark, sf_dir: toc.summary(toc.compare(_entries(spark, sf_dir), lines(spark, sf_dir))),
    "s8_page_offset": _lines(lambda p: toc.page_offset(p)),
    "s9_candidates": lambda spark, sf_dir: index_terms.candidates(_whole(spark, sf_dir).withColumn("code", F.lit(False)), "[A-Z][a-z]{3,}").groupBy("doc_id", "term").agg(F.count("*").alias("n")),
    "s9_signals": lambda spark, sf_dir: index_terms.valued(index_terms.signals(lines(spark, sf_dir).select("doc_id", "page", "text", F.col("text").rlike(CODE).alias("code")), "[A-Z][a-z]{2,}", " the", " of"), 5).select("doc_id", "term", "freq", "score"),
    "s9_term_order": lambda spark, sf_dir: in_place(index_terms.valued(index_terms.signals(lines(spark, sf_dir).select("doc_id", "page", "text", F.col("text").rlike(CODE).alias("code")), "[A-Z][a-z]{2,}", " the", " of"), 5).select("doc_id", "term", "score")),
    "s10_best_files": _compared(lambda b, s, c: c),
    "s10_compare_lines": _compared(listings.compare_lines),
    "s10_coverage": _compared(listings.coverage),
    "s10_totals": _compared(lambda b, s, c: listings.totals(listings.compare_lines(b, s, c))),
    "s10_match_blocks": lambda spark, sf_dir: listings.match_blocks(_blocks(spark, sf_dir), _files(spark, sf_dir)),
    "s10_absent_files": _absent,
    "s11_merged_runs": lambda spark, sf_dir: structure.merged_runs(_elements(spark, sf_dir), ("user",)).select("doc_id", "pos", "type", "n"),
    "s11_outline_numbers": lambda spark, sf_dir: structure.outline_numbers(_elements(spark, sf_dir)).select("doc_id", "pos", "number"),
    "s11_element_counts": lambda spark, sf_dir: structure.element_counts(_elements(spark, sf_dir), KINDS),
    "s11_virtual_pages": lambda spark, sf_dir: structure.virtual_pages(table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))).select("doc_id", "page", F.length("text").alias("size")),
    "s11_manuscript_size": lambda spark, sf_dir: structure.manuscript_size(_whole(spark, sf_dir)),
    "s11_upper_median": lambda spark, sf_dir: structure.upper_medians(table(spark, sf_dir, "customer"), ("c_nationkey",), "c_acctbal"),
    "s11_completeness": lambda spark, sf_dir: structure.completeness(table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 > 0, F.col("props")).alias("props")), ("event_type", "props")).groupBy("state").agg(F.count("*").alias("n")),
    "s13_metadata": lambda spark, sf_dir: reports.metadata(report_texts(spark, sf_dir)).select("filename", "title", "date", "summary"),
}

_L = "l AS (SELECT doc_id, page::INTEGER AS page, text, (CASE WHEN page % 5 = 0 THEN NULL WHEN page % 7 = 0 THEN page ELSE page - 2 - doc_id % 3 END)::INTEGER AS printed FROM (SELECT doc_id, unnest(t) AS text, generate_subscripts(t, 1) AS page FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL)))"
_RULES = " UNION ALL ".join(
    f"SELECT {i} AS rule, '{p}' AS pattern, '{t}' AS type, '{s}' AS severity" for i, (p, t, s, _) in enumerate(RULES)
)
_I = f"""{_L}, r AS ({_RULES}),
x AS (SELECT doc_id, page, rule, type, severity, CASE rule {" ".join(f"WHEN {i} THEN regexp_extract_all(text, '{p}')" for i, (p, _, _, _) in enumerate(RULES))} END AS hits FROM l CROSS JOIN r WHERE len(text) >= 20),
i AS (SELECT doc_id, page, rule, type, severity, substr(unnest(hits), 1, 60) AS found, (generate_subscripts(hits, 1) - 1)::INTEGER AS place FROM x)"""
_COUNTS = ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS {k}" for k, p in STYLES.items())
_S = f"""{_L}, c AS (SELECT doc_id, page, {_COUNTS} FROM l WHERE len(text) >= 50),
s0 AS (SELECT doc_id, sum(formal)::BIGINT AS formal, sum(plain)::BIGINT AS plain, sum(polite)::BIGINT AS polite FROM c GROUP BY doc_id),
s1 AS (SELECT doc_id, formal + plain + polite AS total, greatest(formal, plain, polite) AS best, CASE WHEN formal >= plain AND formal >= polite THEN 'formal' WHEN plain >= polite THEN 'plain' ELSE 'polite' END AS main FROM s0),
m AS (SELECT doc_id, main, floor(best * 100 / total + 0.5)::BIGINT AS percent, total FROM s1 WHERE total >= 10 AND floor(best * 100 / total + 0.5) < 80)"""
_P = f"""{_L}, e AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM (SELECT doc_id, text FROM l)),
z AS (SELECT doc_id, count(*) AS pages FROM l GROUP BY doc_id HAVING pages >= 3),
en AS (SELECT doc_id, unnest(list_distinct([ls[1], ls[-1]])) AS line FROM e WHERE len(ls) > 0),
rl AS (SELECT doc_id, line, count(*) AS n FROM en WHERE len(line) BETWEEN 2 AND 80 GROUP BY ALL),
rep AS (SELECT doc_id, line, n FROM rl JOIN z USING (doc_id) WHERE n >= floor(pages * 0.2::DOUBLE))"""
_E = "el AS (SELECT conv_id AS doc_id, turn AS pos, role AS type, text, CASE role WHEN 'user' THEN 1 WHEN 'system' THEN 2 ELSE 3 END AS level FROM conversations)"
_B = """b0 AS (SELECT item_id::VARCHAR AS block_id, 'f' || (item_id % 7) AS filename, item_id % 3 = 0 AS gaps, list_filter(string_split_regex(regexp_replace(text, '\\.\\s+', '.' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ls FROM benchmark),
f0 AS (SELECT 'd/' || doc_id AS path, string_split_regex(regexp_replace(text, '\\.\\s+', '.' || chr(10), 'g'), '\\r?\\n') AS ls FROM documents WHERE text IS NOT NULL),
bl AS (SELECT block_id, number, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS k FROM (SELECT block_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS number FROM b0) WHERE k <> ''),
sl AS (SELECT path, number, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS k FROM (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS number FROM f0) WHERE k <> ''),
bn AS (SELECT *, regexp_replace(k, '\\s+', '', 'g') AS b FROM bl), sn AS (SELECT *, regexp_replace(k, '\\s+', '', 'g') AS b FROM sl),
ht AS (SELECT DISTINCT block_id, bn.number, path FROM bn JOIN sn USING (b)),
hc AS (SELECT block_id, path, count(*) AS hits FROM ht GROUP BY block_id, path QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY count(*) DESC, path) = 1),
ch AS (SELECT block_id, path, hits FROM hc JOIN (SELECT block_id, count(*) AS size FROM bn GROUP BY 1) USING (block_id) WHERE CASE WHEN size <= 2 THEN hits >= size WHEN size <= 5 THEN hits * 2 >= size ELSE hits * 5 >= size END)"""

_OF = "oc AS (SELECT doc_id, page - printed AS o, count(*) AS n FROM l WHERE printed IS NOT NULL GROUP BY ALL), oo AS (SELECT doc_id, o FROM oc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) = 1)"
_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9가-힣]+', ' ', 'g'), ' +', ' ', 'g'))"
#: Entries, each against all pages of its document; a hit's stage says whether it is near by either number.
_TOC = f"""en0 AS (SELECT doc_id, page AS entry, text AS title, CASE WHEN page % 4 > 0 THEN greatest(1, page - 2 - page % 9 * 3) END AS page FROM l WHERE len(text) > 30 UNION ALL SELECT doc_id, 0, 'zzqx zzqy', CASE WHEN doc_id % 2 = 0 THEN 1 END FROM l WHERE page = 1),
tp AS (SELECT l.doc_id, l.page AS at_page, printed, coalesce(o, 0) AS o, {_NORM.format("text")} AS norm FROM l LEFT JOIN oo USING (doc_id)),
te AS (SELECT *, {_NORM.format("title")} AS want FROM en0),
th AS (SELECT te.doc_id, entry, page, at_page, printed, o, norm, want, list_filter(string_split(want, ' '), lambda w: len(w) >= 2) AS ws FROM te JOIN tp USING (doc_id) WHERE page IS NOT NULL),
tf AS (SELECT *, list_count(list_filter(ws, lambda w: contains(norm, w) OR contains(replace(norm, ' ', ''), w))) AS k FROM th),
tg AS (SELECT * FROM tf WHERE want <> '' AND norm <> '' AND (contains(norm, want) OR (len(replace(want, ' ', '')) >= 4 AND contains(replace(norm, ' ', ''), replace(want, ' ', ''))) OR (len(ws) >= 2 AND k >= 2 AND k * 10 >= len(ws) * 6))),
ti AS (SELECT doc_id, entry, 1 AS stage, abs(printed - page) AS away, printed < page AS before, printed AS body FROM tg WHERE printed >= 1 AND abs(printed - page) <= 5 UNION ALL SELECT doc_id, entry, 2, abs(at_page - o - page), at_page - o < page, at_page - o FROM tg WHERE at_page - o >= 1 AND abs(at_page - o - page) <= 5
  UNION ALL SELECT doc_id, entry, 3, at_page, false, CASE WHEN at_page - o >= 1 THEN at_page - o ELSE at_page END FROM tg),
tj AS (SELECT doc_id, entry, body FROM ti QUALIFY row_number() OVER (PARTITION BY doc_id, entry ORDER BY stage, away, before) = 1),
tc AS (SELECT te.doc_id, te.entry, title, page, body::BIGINT AS body_page, CASE WHEN page IS NULL THEN 'no-page' WHEN body IS NULL THEN 'missing' WHEN page = body THEN 'match' ELSE 'page-mismatch' END AS status FROM te LEFT JOIN tj ON tj.doc_id = te.doc_id AND tj.entry = te.entry)"""
#: Lines against the chosen file: equal with single spaces, without spaces, or within a tenth by edit distance.
_CL = """cx AS (SELECT bl.block_id, bl.number, bl.k, path FROM bl JOIN ch USING (block_id)), cy AS (SELECT path, number, k, replace(k, ' ', '') AS b FROM sl WHERE path IN (SELECT path FROM ch)),
ce AS (SELECT cx.block_id, cx.number, min(cy.number) FILTER (cy.k = cx.k) AS exact, min(cy.number) FILTER (cy.b = replace(cx.k, ' ', '')) AS bare,
  arg_min(cy.number, (levenshtein(cy.k, cx.k) / greatest(len(cy.k), len(cx.k)), cy.number)) FILTER (levenshtein(cy.k, cx.k) <= floor(greatest(len(cy.k), len(cx.k)) * 0.1::DOUBLE + 1e-9)) AS near FROM cx JOIN cy USING (path) GROUP BY ALL),
bo AS (SELECT block_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS number FROM b0),
cl AS (SELECT ce.block_id, ce.number, bo.line, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN bare IS NOT NULL THEN 'bare' WHEN near IS NOT NULL THEN 'near' ELSE 'diff' END AS stage, coalesce(exact, bare, near) AS source_number FROM ce JOIN bo ON bo.block_id = ce.block_id AND bo.number = ce.number)"""

#: Reports and what their texts say of themselves.
REPORTS = """d0 AS (SELECT CASE doc_id % 3 WHEN 0 THEN '20240229_' WHEN 1 THEN '20240231_' ELSE 'r' END || doc_id AS id, doc_id,
  CASE WHEN doc_id % 5 = 0 THEN '# ' || substr(text, 1, 20) || chr(10) || '> ' || substr(text, 1, 30) || chr(10) ELSE '' END || text AS content FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT *, list_transform(string_split_regex(content, '\\r?\\n'), lambda x: trim(x, ' ')) AS ls FROM d0),
p0 AS (SELECT id, doc_id, content, list_filter(ls, lambda x: regexp_matches(x, '^# '))[1] AS t, list_filter(ls, lambda x: regexp_matches(x, '^> *[^ ]'))[1] AS q,
  list_filter(ls, lambda x: x <> '' AND NOT regexp_matches(x, '^(?:[#>|\\-*]|\\d+\\.)'))[1] AS s FROM l0),
rp AS (SELECT id, id || '.md' AS filename, coalesce(nullif(trim(regexp_replace(t, '^# +', ''), ' '), ''), id) AS title,
  coalesce(CASE WHEN doc_id % 3 = 0 THEN DATE '2024-02-29' END, try_cast(nullif(regexp_extract(content, '(\\d{4}-\\d{2}-\\d{2})', 1), '') AS DATE)) AS date,
  substr(coalesce(trim(regexp_replace(q, '^> *', ''), ' '), s), 1, 200) AS summary FROM p0)"""

ORACLES = {
    "s7_scan": f"WITH {_I} SELECT * FROM i",
    "s7_issue_order": f"WITH {_I} SELECT doc_id, page, type, found, row_number() OVER (PARTITION BY doc_id ORDER BY page, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, type, found)::INTEGER AS n FROM i",
    "s7_filtered": f"WITH {_I} SELECT type, count(*) AS n FROM i WHERE severity = 'low' AND contains(found, '%%') GROUP BY type",
    "s7_particle_repeats": f"""WITH {_L}, s AS (SELECT doc_id, unnest(string_split_regex(text, '\\.\\s+')) AS s FROM l), n AS (SELECT doc_id, s, 'the' AS particle, len(regexp_extract_all(s, 'the\\s')) AS n FROM s UNION ALL SELECT doc_id, s, 'of', len(regexp_extract_all(s, 'of\\s')) FROM s)
        SELECT doc_id, particle, count(*) AS sentences, sum(n)::BIGINT AS n FROM n WHERE len(s) >= 15 AND n >= 3 GROUP BY ALL""",
    "s7_style_counts": f"WITH {_S} SELECT * FROM c",
    "s7_mixed_styles": f"WITH {_S} SELECT * FROM m",
    "s7_outlier_pages": f"""WITH {_S}, o AS (SELECT doc_id, page, main, formal + plain + polite AS t, CASE main WHEN 'formal' THEN formal WHEN 'plain' THEN plain ELSE polite END AS own,
        CASE WHEN formal >= plain AND formal >= polite THEN 'formal' WHEN plain >= polite THEN 'plain' ELSE 'polite' END AS dominant FROM c JOIN m USING (doc_id)) SELECT doc_id, page, dominant FROM o WHERE t >= 3 AND dominant <> main AND own * 10 < t * 4""",
    "s7_both_counts": f"WITH {_L} SELECT doc_id, sum(len(regexp_extract_all(text, 'the ')))::BIGINT AS first, sum(len(regexp_extract_all(text, 'und ')))::BIGINT AS second FROM l GROUP BY doc_id HAVING first >= 3 AND second >= 3",
    "s7_term_variants": f"""WITH {_L}, w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]+')) AS variant FROM l), c AS (SELECT doc_id, lower(variant) AS term, variant, count(*) AS n FROM w WHERE lower(variant) <> 'and' GROUP BY ALL),
        g AS (SELECT doc_id, term, arg_min(variant, (-n, variant)) AS canonical, max(n) AS most FROM c GROUP BY ALL HAVING bool_or(regexp_matches(variant, '^[A-Z]')) AND bool_or(regexp_matches(variant, '^[a-z]')) AND sum(n) >= 4)
        SELECT doc_id, variant, n, canonical FROM c JOIN g USING (doc_id, term) WHERE variant <> canonical AND most >= 2 * n""",
    "s7_repeating_lines": f"WITH {_P} SELECT * FROM rep",
    "s7_without_lines": f"WITH {_P} SELECT doc_id, sum(CASE WHEN (doc_id, trim(text)) IN (SELECT (doc_id, line) FROM rep) THEN 0 ELSE len(text) END)::BIGINT AS n FROM l GROUP BY doc_id",
    "s7_estimated_tokens": "SELECT doc_id, ceil(len(regexp_extract_all(text, '[가-힣]')) / 1.5::DOUBLE + len(regexp_extract_all(text, '[\\x00-\\x7F]')) / 4 + (len(text) - len(regexp_extract_all(text, '[가-힣]')) - len(regexp_extract_all(text, '[\\x00-\\x7F]'))) / 2)::BIGINT AS n FROM documents WHERE text IS NOT NULL",
    "s7_sampled": f"""WITH {_L}, k AS (SELECT doc_id, page, text, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE len(text) >= 50)
        SELECT doc_id, page, array_to_string(string_split_regex(trim(text), '\\s+')[1:5], ' ') AS words FROM k WHERE k % greatest(n // 8, 1) = 0""",
    "s7_batches": f"""WITH {_L}, k AS (SELECT doc_id, row_number() OVER w - 1 AS k, lag(text) OVER w AS b FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY page)) SELECT doc_id, k // 3 AS batch, count(*) AS pages, max(len(b)) FILTER (k % 3 = 0) AS before FROM k GROUP BY 1, 2""",
    "s7_picked_evenly": f"WITH {_L}, k AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM l) SELECT doc_id, page FROM k WHERE k < 2 OR k = n // 2 OR k = n // 2 - 1 OR k >= n - 2",
    "s7_confusion": "WITH t AS (SELECT doc_id % 2 = 0 AS want, len(text) >= 20 AND contains(text, '%%%') AS hit, len(text) >= 20 AND (regexp_matches(text, '[?!]{2,}') OR regexp_matches(text, ',\\s*,') OR regexp_matches(text, '\\.{4,}') OR regexp_matches(text, '[#$%&*]{3}')) AS any_hit FROM documents WHERE text IS NOT NULL) SELECT count(*) FILTER (want AND hit) AS detected, count(*) FILTER (want AND NOT hit) AS missed, count(*) FILTER (NOT want AND any_hit) AS false_positives, count(*) FILTER (NOT want AND NOT any_hit) AS clean FROM t",
    "s8_page_offset": f'WITH {_L}, {_OF} SELECT doc_id, o::INTEGER AS "offset" FROM oo',
    "s8_compare": f"WITH {_L}, {_OF}, {_TOC} SELECT doc_id, entry, title, page, body_page, abs(page - body_page) AS difference, status FROM tc",
    "s8_summary": f"WITH {_L}, {_OF}, {_TOC} SELECT doc_id, count(*) FILTER (status = 'match') AS matches, count(*) FILTER (status = 'page-mismatch') AS mismatches, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'no-page') AS no_page, floor(count(*) FILTER (status = 'match') * 100 / nullif(count(*) FILTER (status <> 'no-page'), 0) + 0.5)::BIGINT AS percent FROM tc GROUP BY doc_id",
    "s9_signals": f"""WITH {_L}, h AS (SELECT doc_id, page, regexp_matches(text, '^(?: {{4}}|\\t)|[;{{}}]\\s*$') AS code, unnest(list_transform(regexp_extract_all(text, '[A-Z][a-z]{{2,}}'), lambda x: {{'k': 't', 'term': x}}) || list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{{2,}}')), lambda x: {{'k': 'n', 'term': x}})
          || list_transform(regexp_extract_all(text, '([A-Z][a-z]{{2,}}) the', 1), lambda x: {{'k': 'd', 'term': x}}) || list_transform(regexp_extract_all(text, '([A-Z][a-z]{{2,}}) of', 1), lambda x: {{'k': 'a', 'term': x}}) || list_transform(regexp_extract_all(text, '([A-Z][a-z]{{2,}})\\s?\\(', 1), lambda x: {{'k': 'e', 'term': x}})) AS x FROM l),
        p AS (SELECT doc_id, page, code, x.term AS term, count(*) FILTER (x.k = 'n') AS n, bool_or(x.k = 't') AS t, bool_or(x.k = 'd') AS d, bool_or(x.k = 'a') AS a, bool_or(x.k = 'e') AS e FROM h GROUP BY ALL HAVING bool_or(x.k = 't')),
        g AS (SELECT doc_id, term, sum(n)::BIGINT AS freq, bool_or(d) AS d, bool_or(a) AS a, bool_or(e) AS e, bool_and(code) AS code FROM p GROUP BY ALL),
        s AS (SELECT doc_id, term, freq, greatest(0, least(10, 5 + CASE WHEN d AND e THEN 5 WHEN d THEN 4 ELSE 0 END + CASE WHEN freq >= 3 THEN 3 ELSE 0 END + CASE WHEN a THEN 2 ELSE 0 END - 3 - CASE WHEN code THEN 5 ELSE 0 END)) AS score FROM g) SELECT * FROM s WHERE score >= 5""",
    "s9_term_order": f"""WITH {_L}, h AS (SELECT doc_id, page, regexp_matches(text, '^(?: {{4}}|\\t)|[;{{}}]\\s*$') AS code, unnest(list_transform(regexp_extract_all(text, '[A-Z][a-z]{{2,}}'), lambda x: {{'k': 't', 'term': x}}) || list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{{2,}}')), lambda x: {{'k': 'n', 'term': x}})
          || list_transform(regexp_extract_all(text, '([A-Z][a-z]{{2,}}) the', 1), lambda x: {{'k': 'd', 'term': x}}) || list_transform(regexp_extract_all(text, '([A-Z][a-z]{{2,}}) of', 1), lambda x: {{'k': 'a', 'term': x}}) || list_transform(regexp_extract_all(text, '([A-Z][a-z]{{2,}})\\s?\\(', 1), lambda x: {{'k': 'e', 'term': x}})) AS x FROM l),
        p AS (SELECT doc_id, page, code, x.term AS term, count(*) FILTER (x.k = 'n') AS n, bool_or(x.k = 't') AS t, bool_or(x.k = 'd') AS d, bool_or(x.k = 'a') AS a, bool_or(x.k = 'e') AS e FROM h GROUP BY ALL HAVING bool_or(x.k = 't')),
        g AS (SELECT doc_id, term, sum(n)::BIGINT AS freq, bool_or(d) AS d, bool_or(a) AS a, bool_or(e) AS e, bool_and(code) AS code FROM p GROUP BY ALL),
        s AS (SELECT doc_id, term, freq, greatest(0, least(10, 5 + CASE WHEN d AND e THEN 5 WHEN d THEN 4 ELSE 0 END + CASE WHEN freq >= 3 THEN 3 ELSE 0 END + CASE WHEN a THEN 2 ELSE 0 END - 3 - CASE WHEN code THEN 5 ELSE 0 END)) AS score FROM g) SELECT doc_id, term, score, row_number() OVER (ORDER BY score DESC, term, doc_id)::INTEGER AS n FROM s WHERE score >= 5""",
    "s10_match_blocks": f"""WITH {_B}, f1 AS (SELECT block_id, 'd/' || (block_id::BIGINT % 7) AS path FROM b0 WHERE EXISTS (SELECT 1 FROM documents WHERE text IS NOT NULL AND doc_id = block_id::BIGINT % 7)),
        allh AS (SELECT block_id, path, count(*) AS hits FROM ht GROUP BY ALL), sz AS (SELECT block_id, count(*) AS size FROM bn GROUP BY 1), r AS (SELECT f1.block_id, f1.path, size, coalesce(hits, 0) AS hits FROM f1 LEFT JOIN sz USING (block_id) LEFT JOIN allh ON allh.block_id = f1.block_id AND allh.path = f1.path),
        alt AS (SELECT allh.block_id, allh.path FROM allh JOIN r ON r.block_id = allh.block_id AND size >= 5 AND r.hits < 0.4 * size AND allh.hits > r.hits QUALIFY row_number() OVER (PARTITION BY allh.block_id ORDER BY allh.hits DESC, allh.path) = 1),
        nf AS (SELECT ch.block_id, ch.path, 'content' AS how FROM ch WHERE ch.block_id NOT IN (SELECT block_id FROM f1)) SELECT r.block_id, coalesce(alt.path, r.path) AS path, CASE WHEN alt.path IS NULL THEN 'name' ELSE 'again' END AS how FROM r LEFT JOIN alt USING (block_id) UNION ALL SELECT * FROM nf""",
    "s10_compare_lines": f"WITH {_B}, {_CL} SELECT block_id, number::INTEGER AS number, line, stage, source_number::INTEGER AS source_number FROM cl",
    "s10_totals": f"WITH {_B}, {_CL} SELECT block_id, count(*) AS lines, count(*) FILTER (stage NOT IN ('near', 'diff')) AS same, count(*) FILTER (stage = 'near') AS near, count(*) FILTER (stage = 'diff') AS diff, count(*) FILTER (stage IN ('near', 'diff')) = 0 AS clean FROM cl GROUP BY block_id",
    "s11_virtual_pages": """WITH RECURSIVE p AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, list_filter(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: trim(x) <> '') AS t FROM documents WHERE text IS NOT NULL)),
        w(doc_id, i, page, size) AS (SELECT doc_id, i, 1, len(t) FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN w.size >= 1500 THEN w.page + 1 ELSE w.page END, CASE WHEN w.size >= 1500 THEN len(p.t) ELSE w.size + 2 + len(p.t) END FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
        SELECT doc_id, page, max(size)::INTEGER AS size FROM w GROUP BY ALL""",
    "s9_candidates": "SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY ALL",
    "s10_best_files": f"WITH {_B} SELECT * FROM ch",
    "s10_absent_files": "SELECT DISTINCT 'f' || (item_id * 37) AS filename FROM benchmark WHERE NOT EXISTS (SELECT 1 FROM documents WHERE text IS NOT NULL AND doc_id = item_id * 37)",
    "s10_coverage": f"""WITH {_B}, so AS (SELECT block_id, sn.number, b FROM sn JOIN ch USING (path)), tot AS (SELECT block_id, count(*) AS total FROM so GROUP BY 1),
        cov AS (SELECT block_id, count(DISTINCT number) AS covered FROM so JOIN (SELECT DISTINCT block_id, b FROM bn) USING (block_id, b) GROUP BY 1), sz AS (SELECT block_id, count(*) AS size FROM bn GROUP BY 1),
        q AS (SELECT block_id, total, coalesce(covered, 0) AS covered, CASE WHEN gaps THEN greatest(least(total - coalesce(covered, 0), total - size), 0) ELSE 0 END AS omitted, CASE WHEN gaps THEN 0 ELSE total - coalesce(covered, 0) END AS missing
          FROM tot LEFT JOIN cov USING (block_id) JOIN sz USING (block_id) JOIN b0 USING (block_id)) SELECT *, covered * 100 / nullif(total - omitted, 0) AS percent FROM q""",
    "s11_merged_runs": f"""WITH {_E}, a AS (SELECT *, sum(CASE WHEN type <> 'user' OR lag(type) OVER w IS DISTINCT FROM type THEN 1 ELSE 0 END) OVER w AS run FROM el WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
        SELECT doc_id, min(pos) AS pos, min(type) AS type, count(*) AS n FROM a GROUP BY doc_id, run""".replace("sum(CASE WHEN type <> 'user' OR lag(type) OVER w IS DISTINCT FROM type THEN 1 ELSE 0 END) OVER w AS run FROM el WINDOW w", "sum(s) OVER w AS run FROM (SELECT *, CASE WHEN type <> 'user' OR lag(type) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM type THEN 1 ELSE 0 END AS s FROM el) WINDOW w"),
    "s11_outline_numbers": f"""WITH {_E}, a AS (SELECT doc_id, pos, level, count(*) FILTER (level < 2) OVER w AS s2, count(*) FILTER (level < 3) OVER w AS s3, count(*) FILTER (level = 1) OVER w AS n1 FROM el WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        b AS (SELECT *, count(*) FILTER (level = 2) OVER (PARTITION BY doc_id, s2 ORDER BY pos) AS n2, count(*) FILTER (level = 3) OVER (PARTITION BY doc_id, s3 ORDER BY pos) AS n3 FROM a)
        SELECT doc_id, pos, concat_ws('.', n1, CASE WHEN level >= 2 THEN n2 END, CASE WHEN level >= 3 THEN n3 END) AS number FROM b""",
    "s11_element_counts": f"WITH {_E} SELECT doc_id, {', '.join(f"count(*) FILTER (type = '{k}') AS {k}" for k in KINDS)} FROM el GROUP BY doc_id",
    "s11_manuscript_size": "SELECT doc_id, len(regexp_replace(text, '\\s', '', 'g')) AS characters, n AS lines, ceil(n / 35)::BIGINT AS pages FROM (SELECT doc_id, text, list_sum(list_transform(string_split(text, chr(10)), lambda p: greatest(ceil(len(p) / 40), 1)))::BIGINT AS n FROM documents WHERE text IS NOT NULL)",
    "s11_upper_median": "SELECT c_nationkey, (list(c_acctbal ORDER BY c_acctbal))[count(*) // 2 + 1] AS median FROM customer GROUP BY 1",
    "s11_completeness": "SELECT CASE WHEN event_id % 3 > 0 THEN 'done' ELSE 'partial' END AS state, count(*) AS n FROM events GROUP BY 1",
    "s13_metadata": f"WITH {REPORTS} SELECT filename, title, date, summary FROM rp",
}
