"""Queries of the competition dashboard: parts are titles, suppliers lectures, orders plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.operators import authors, dashboard as ops
from galley.operators.ordinals import ranked
from galley.plans import s3_authors
from galley.plans.standin import TOPICS, in_place
from galley.session import table

CATEGORIES = ("ECONOMY", "MEDIUM", "LARGE", "PROMO", "SMALL", "STANDARD", "SPECIAL")
OWN, RIVALS = ("Brand#1", "Brand#2", "Brand#3"), ("Brand#4", "Brand#5", "Brand#6", "Brand#7")
YEAR = 2026
MONTHS = ("1995년 01월", "1995년 02월", "1995년 03월")


def _pick(n):
    return F.element_at(F.array(*map(F.lit, CATEGORIES)), (n % len(CATEGORIES) + 1).cast("int"))


def titles(spark, sf_dir):
    """category, rank, title, publisher, year: parts by what they sold."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("sold"))
    rows = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    # the stand-in's rank is global; a real table brings its own
    rows = ranked(rows, F.desc("sold"), F.col("p_partkey")).withColumn("rank", F.col("rank").cast("int"))
    # own titles of one category and rivals' of another are left out, so that every status occurs
    rows = rows.filter(~((F.col("p_type") == "PROMO") & F.col("p_brand").isin(*OWN)) & ~((F.col("p_type") == "LARGE") & F.col("p_brand").isin(*RIVALS)))
    return rows.select(F.col("p_type").alias("category"), "rank", F.concat_ws(" ", "p_name", "p_partkey").alias("title"), F.col("p_brand").alias("publisher"), (2000 + F.col("p_size") % 27).cast("int").alias("year"))


def planned(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "기획예정").when(F.col("o_orderstatus") == "O", "집필중").otherwise("출간")
    month = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy'년'MM'월'"))
    return o.select(_pick(F.col("o_custkey")).alias("category"), F.concat(F.lit("plan "), "o_orderkey").alias("title"), F.col("o_orderpriority").alias("team"), month.alias("month"), status.alias("status"))


def lectures(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(_pick(F.col("s_suppkey") + 2).alias("category"), F.col("s_name").alias("title"), F.floor(F.greatest("s_acctbal", F.lit(0.0))).cast("long").alias("popularity"))


def _cats(f):
    def query(spark, sf_dir):
        plans = ops.active(planned(spark, sf_dir), ("1-URGENT", "2-HIGH"))
        return f(ops.categories(titles(spark, sf_dir), plans, lectures(spark, sf_dir), OWN, RIVALS, "STANDARD"))

    return query


QUERIES = {
    "s4_categories": _cats(lambda c: c),
    "s4_status_counts": _cats(ops.status_counts),
    "s4_priority": _cats(lambda c: ops.priority(c, YEAR)),
    "s4_proposals": _cats(ops.proposals),
    "s4_largest_rivals": _cats(lambda c: ops.largest(c, "n_rival")),
    "s4_lectures_without_book": _cats(lambda c: ops.largest(c, "n_lectures", unless="n_own")),
    "s4_insights": _cats(lambda c: ops.insights(c, YEAR)),
    "s4_search": lambda spark, sf_dir: ops.search(_cats(lambda c: c)(spark, sf_dir), titles(spark, sf_dir), "planning", "BLUE anvil 1").select("category", "status"),
    "s4_ordered": _cats(lambda c: in_place(ops.ordered(c).select("category"))),
    "s4_ordered_by_name": _cats(lambda c: in_place(ops.ordered(c, "name").select("category"))),
    "s4_timeline": lambda spark, sf_dir: ops.timeline(planned(spark, sf_dir)),
    "s4_workload": lambda spark, sf_dir: ops.workload(planned(spark, sf_dir), MONTHS, True),
    "s4_matching_authors": lambda spark, sf_dir: ops.matching_authors(authors.author_mart(authors.books(s3_authors._snaps(spark, sf_dir)), TOPICS), "Colour/ring x").select("name"),
}

_PICK = "['ECONOMY', 'MEDIUM', 'LARGE', 'PROMO', 'SMALL', 'STANDARD', 'SPECIAL']"
_OWN, _RIVALS = (", ".join(f"'{b}'" for b in x) for x in (OWN, RIVALS))
_C = f"""ti AS (SELECT p_type AS category, row_number() OVER (ORDER BY sold DESC, p_partkey)::INTEGER AS rank, p_name || ' ' || p_partkey AS title, p_brand AS publisher, 2000 + p_size % 27 AS year
  FROM part JOIN (SELECT l_partkey, sum(l_extendedprice::DECIMAL(18,2)) AS sold FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
t AS (SELECT * FROM ti WHERE NOT (category = 'PROMO' AND publisher IN ({_OWN})) AND NOT (category = 'LARGE' AND publisher IN ({_RIVALS}))),
p AS (SELECT {_PICK}[o_custkey % 7 + 1] AS category, o_orderpriority AS team, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%Y년%m월') END AS month,
        CASE o_orderstatus WHEN 'P' THEN '기획예정' WHEN 'O' THEN '집필중' ELSE '출간' END AS status FROM orders),
l AS (SELECT {_PICK}[(s_suppkey + 2) % 7 + 1] AS category, floor(greatest(s_acctbal, 0))::BIGINT AS popularity FROM supplier),
u AS (SELECT category, CASE WHEN publisher IN ({_OWN}) THEN 'own' ELSE 'rival' END AS side, rank, year, NULL AS status, NULL AS popularity FROM t WHERE publisher IN ({_OWN}, {_RIVALS}) AND category <> 'STANDARD'
  UNION ALL SELECT category, 'planned', NULL, NULL, status, NULL FROM p WHERE status <> '출간' AND team IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT category, 'lecture', NULL, NULL, NULL, popularity FROM l WHERE category <> 'STANDARD'),
c0 AS (SELECT category, count(*) FILTER (side = 'rival') AS n_rival, count(*) FILTER (side = 'own') AS n_own, count(*) FILTER (side = 'planned') AS n_planned, count(*) FILTER (status = '기획예정') AS n_planning,
   count(*) FILTER (side = 'lecture') AS n_lectures, min(rank) FILTER (side = 'rival') AS rival_best, min(rank) FILTER (side = 'own') AS own_best, arg_min(year, rank) FILTER (side = 'rival') AS rival_year,
   coalesce(sum(popularity), 0)::BIGINT AS popularity FROM u GROUP BY category),
c AS (SELECT *, CASE WHEN n_rival = 0 AND n_own = 0 THEN CASE WHEN n_planned > 0 THEN 'plan-only' ELSE 'lecture-only' END WHEN n_own = 0 THEN 'gap' WHEN n_rival = 0 THEN 'leading'
   WHEN own_best * 10 <= rival_best * 13 THEN 'leading' ELSE 'behind' END AS status, CASE WHEN rival_year > 2000 THEN {YEAR} - rival_year END AS age FROM c0)"""
_COLUMNS = "category, n_rival, n_own, n_planned, n_planning, n_lectures, rival_best, own_best, rival_year, popularity, status"
_KINDS = (
    ("gap", "status = 'gap'", "n_rival"), ("behind", "status = 'behind'", "own_best - rival_best"), ("leading", "status = 'leading'", "n_own"),
    ("lectures without book", "n_lectures >= 2 AND n_own = 0", "n_lectures"), ("gap with plan", "status = 'gap' AND n_planned > 0", "n_planned"), ("ageing rival", "n_rival > 0 AND age >= 4", "age"),
)
_RANK = "CASE status WHEN 'gap' THEN 0 WHEN 'behind' THEN 1 WHEN 'leading' THEN 2 ELSE 3 END"

ORACLES = {
    "s4_categories": f"WITH {_C} SELECT {_COLUMNS} FROM c",
    "s4_status_counts": f"WITH {_C} SELECT status, count(*) AS categories, sum(n_planned)::BIGINT AS planned, count(*) FILTER (n_lectures > 0) AS with_lectures FROM c GROUP BY status",
    "s4_priority": f"""WITH {_C} SELECT category, status, (CASE status WHEN 'gap' THEN 40 ELSE 20 END + least(n_rival * 2, 20) + least(n_lectures * 3, 15) + least(popularity // 1000, 10)
        + CASE WHEN age >= 4 THEN 10 ELSE 0 END + CASE WHEN n_planned > 0 THEN 5 ELSE 0 END)::BIGINT AS score FROM c WHERE status IN ('gap', 'behind') ORDER BY score DESC, category LIMIT 5""",
    "s4_proposals": f"WITH {_C} SELECT category, CASE status WHEN 'gap' THEN 40 WHEN 'behind' THEN 20 ELSE 5 END + n_rival * 2 + n_lectures * 3 AS score FROM c ORDER BY score DESC, category LIMIT 8",
    "s4_largest_rivals": f"WITH {_C} SELECT category, n_rival AS value FROM c WHERE n_rival > 0 ORDER BY value DESC, category LIMIT 10",
    "s4_lectures_without_book": f"WITH {_C} SELECT category, n_lectures AS value FROM c WHERE n_lectures > 0 AND n_own = 0 ORDER BY value DESC, category LIMIT 10",
    "s4_insights": f"WITH {_C} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS kind, category, ({v})::BIGINT AS value FROM c WHERE {w} ORDER BY value DESC, category LIMIT 6)" for k, w, v in _KINDS),
    "s4_search": f"WITH {_C} SELECT category, status FROM c WHERE n_planning > 0 AND category IN (SELECT category FROM t WHERE contains(lower(title), 'blue anvil 1'))",
    "s4_ordered": f"WITH {_C} SELECT category, row_number() OVER (ORDER BY {_RANK}, n_rival DESC, category)::INTEGER AS n FROM c",
    "s4_ordered_by_name": f"WITH {_C} SELECT category, row_number() OVER (ORDER BY category)::INTEGER AS n FROM c",
    "s4_timeline": f"WITH {_C} SELECT CASE WHEN month = '' THEN '미정' ELSE replace(month, '년', '년 ') END AS month, count(*) FILTER (status = '기획예정') AS planning, count(*) FILTER (status <> '기획예정') AS publishing FROM p GROUP BY 1",
    "s4_workload": f"""WITH {_C}, x AS (SELECT team, replace(month, '년', '년 ') AS m FROM p WHERE status <> '기획예정'), y AS (SELECT team, {", ".join(f"count(*) FILTER (m = '{m}') AS '{m}'" for m in MONTHS)} FROM x GROUP BY team)
        SELECT *, ({" + ".join(f'("{m}" >= 3)::INTEGER' for m in MONTHS)}) AS overloaded, ({" + ".join(f'("{m}" = 2)::INTEGER' for m in MONTHS)}) AS busy FROM y""",
    "s4_matching_authors": f"WITH {s3_authors._B} SELECT name FROM m WHERE contains(lower(name || ' ' || array_to_string(topics, ' ')), 'colour') OR contains(lower(name || ' ' || array_to_string(topics, ' ')), 'ring')",
}
