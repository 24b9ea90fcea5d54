"""Queries of the author mart; the words of an invented title are its authors, its type the translator."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.operators import authors as ops
from galley.plans import standin
from galley.plans.standin import SNAPSHOTS, TOPICS


def _snaps(spark, sf_dir):
    s = standin.snapshots(spark, sf_dir)
    return s.withColumn("author", F.concat("author", F.lit(" 저/"), "publisher", F.lit(" 역")))


def _mart(f):
    return lambda spark, sf_dir: f(ops.author_mart(ops.books(_snaps(spark, sf_dir)), TOPICS))


def _flat(m):
    return m.select("name", F.size("books").cast("long").alias("n_listed"), F.col("books")[0]["title"].alias("best_title"), F.array_join("publishers", "|").alias("publishers"), "n_books", "best_rank", "total_days", F.array_join("topics", "|").alias("topics"))


QUERIES = {
    "s3_books": lambda spark, sf_dir: ops.books(_snaps(spark, sf_dir)),
    "s3_author_mart": _mart(_flat),
    "s3_ordered": _mart(lambda m: standin.in_place(ops.ordered(m).select("name", "n_books"), "n_books")),
    "s3_filtered": _mart(lambda m: ops.filtered(m, "Brand#3", "colour", "blue").select("name", "n_books")),
    "s3_page": _mart(lambda m: ops.page(m, "best_rank", True, 1, 5).select("name", "best_rank")),
    "s3_pool_stats": _mart(ops.pool_stats),
    "s3_relevance": _mart(lambda m: ops.relevance(m, ["colour", "ringtone"])),
}

_TOPIC = ", ".join(f"CASE WHEN {' OR '.join(f'contains(all_titles, {w!r})' for w in words)} THEN '{t}' END" for t, words in TOPICS.items())
_B = f"""{SNAPSHOTS},
b AS (SELECT name, title, min(publisher) AS publisher, min(rank) AS best_rank, count(*) AS appearances, max(date) AS last_date
      FROM (SELECT *, unnest(string_split(author, ',')) AS name FROM snaps) GROUP BY name, title),
m0 AS (SELECT name, string_agg(lower(title), ' ') AS all_titles, arg_min(title, (best_rank, title)) AS best_title, list_sort(list(DISTINCT publisher)) AS publishers,
         count(*) AS n_books, min(best_rank) AS best_rank, sum(appearances)::BIGINT AS total_days, bool_or(contains(lower(title), 'blue')) AS has_blue FROM b GROUP BY name),
m AS (SELECT *, list_filter([{_TOPIC}], lambda x: x IS NOT NULL) AS topics FROM m0)"""

ORACLES = {
    "s3_books": f"WITH {_B} SELECT * FROM b",
    "s3_author_mart": f"WITH {_B} SELECT name, n_books AS n_listed, best_title, array_to_string(publishers, '|') AS publishers, n_books, best_rank, total_days, array_to_string(topics, '|') AS topics FROM m",
    "s3_ordered": f"WITH {_B} SELECT name, n_books, row_number() OVER (PARTITION BY n_books ORDER BY total_days DESC, best_rank, name)::INTEGER AS n FROM m",
    "s3_filtered": f"WITH {_B} SELECT name, n_books FROM m WHERE list_contains(publishers, 'Brand#3') AND list_contains(topics, 'colour') AND (contains(name, 'blue') OR has_blue)",
    "s3_page": f"WITH {_B} SELECT name, best_rank FROM m ORDER BY best_rank, name LIMIT 5 OFFSET 5",
    "s3_pool_stats": f"WITH {_B} SELECT count(*) AS authors, count(*) FILTER (len(topics) > 0) AS with_topics, (SELECT count(DISTINCT t) FROM (SELECT unnest(topics) AS t FROM m)) AS distinct_topics FROM m",
    "s3_relevance": f"WITH {_B} SELECT name, (CASE WHEN list_contains(topics, 'colour') THEN 2 ELSE 0 END + CASE WHEN list_contains(topics, 'ring') THEN 1 ELSE 0 END)::INTEGER AS relevance, n_books FROM m ORDER BY relevance DESC, n_books DESC, name LIMIT 50",
}
