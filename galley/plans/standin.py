"""The library's domain tables as derived from the Parquet test tables, in Spark and in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.operators.ordinals import numbered
from galley.session import table

#: Topics of the invented titles; a title may show two.
TOPICS = {"colour": ("blue", "red", "green"), "temperature": ("cold", "hot"), "fastener": ("bolt", "rod"), "ring": ("ring",), "tool": ("gear", "gizmo", "widget")}
NO_TOPIC = "other"
RANKS = 20
OWN = "Brand#1"


def in_place(df: DataFrame, *within: str) -> DataFrame:
    """``df``, a sorted table, with its rows' places n in each group of ``within``, whose groups are small, or in all."""
    if not within:
        return numbered(df).withColumn("n", F.col("n").cast("int"))
    return df.withColumn("_i", F.monotonically_increasing_id()).withColumn("n", F.row_number().over(W.partitionBy(*within).orderBy("_i"))).drop("_i")


def _topics_sql() -> str:
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(title), {w!r})' for w in words)} THEN '{t}' END" for t, words in TOPICS.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, rank, title, publisher, price, author: the ``RANKS`` parts that sold most on each day."""
    lines = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    sold = lines.groupBy("date", "l_partkey").agg(F.sum("price").alias("sold"))
    order = W.partitionBy("date").orderBy(F.desc("sold"), "l_partkey")
    ranked = sold.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= RANKS)
    parts = table(spark, sf_dir, "part")
    rows = ranked.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    title = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    return rows.select("date", "rank", title.alias("title"), F.col("p_brand").alias("publisher"), (F.col("p_retailprice") * 30).alias("price"), F.replace("p_name", F.lit(" "), F.lit(",")).alias("author"))


SNAPSHOTS = f"""
sold AS (SELECT l_shipdate::DATE AS date, l_partkey, sum(l_extendedprice::DECIMAL(18,2)) AS sold FROM lineitem GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY sold DESC, l_partkey) AS rank FROM sold),
snaps AS (SELECT date, rank::INTEGER AS rank, p_name || ' ' || p_partkey AS title, p_brand AS publisher, p_retailprice * 30 AS price, replace(p_name, ' ', ',') AS author
          FROM ranked JOIN part ON l_partkey = p_partkey WHERE rank <= {RANKS}),
days AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS back, count(*) OVER () AS n_dates FROM (SELECT DISTINCT date FROM snaps)),
st AS (SELECT title, count(DISTINCT date) AS days, count(rank) AS n_ranks, sum(rank) AS rank_sum, min(rank) AS best_rank, min(date) AS first_date,
         min(publisher) AS publisher, min(price) AS price, max((back <= 30)::INTEGER) AS in_recent, max((back BETWEEN 31 AND 60 AND n_dates >= 60)::INTEGER) AS in_previous,
         avg(rank) FILTER (back <= 30) AS recent_mean, avg(rank) FILTER (back BETWEEN 31 AND 60 AND n_dates >= 60) AS previous_mean, max(n_dates) AS n_dates, max(back) AS first_back
       FROM snaps JOIN days USING (date) GROUP BY title),
tp AS (SELECT *, unnest(CASE WHEN len(l) > 0 THEN l ELSE ['{NO_TOPIC}'] END) AS topic FROM (SELECT *, {_topics_sql()} AS l FROM st))
"""
