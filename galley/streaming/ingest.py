"""The news archive as a stream: articles arrive in files, each link is taken once, trends follow by week.

Batch queries over the archive stay the reference for trends. The windowed stream drops what comes after its watermark;
the upkeep of weeks revises a week whenever an article of its dates arrives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galley.operators.news import article_id
from galley.operators.snapshots import best_of

ARTICLES = "link string, source string, title string, ts timestamp, keywords array<string>"


def arriving(spark: SparkSession, path: str, schema: str = ARTICLES, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_sightings(articles: DataFrame, delay: str = "7 days") -> DataFrame:
    """Articles with id, each link once as long as it comes within ``delay``; rows without a link go."""
    rows = articles.filter(F.length("link") > 0).withColumn("id", article_id(F.col("link")))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def weekly_keywords(articles: DataFrame, feeds: DataFrame, delay: str = "7 days") -> DataFrame:
    """week_start, keyword, points: weighted counts of weeks from Monday, without the cap of a source."""
    rows = articles.withWatermark("ts", delay).join(feeds.select(F.col("id").alias("source"), "weight"), "source", "left")
    rows = rows.select("ts", F.explode("keywords").alias("keyword"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    # the epoch was a Thursday: weeks that start four days later start on Mondays
    sums = rows.groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("w7"), "keyword").agg(F.sum("w").alias("points"))
    return sums.select(F.col("w7.start").alias("week_start"), "keyword", "points")


def week_points(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """week_start, keyword, points of articles in a batch: the sums of :func:`weekly_keywords`."""
    rows = articles.join(feeds.select(F.col("id").alias("source"), "weight"), "source", "left")
    rows = rows.select(_monday(F.col("ts")).alias("week_start"), F.explode("keywords").alias("keyword"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    return rows.groupBy("week_start", "keyword").agg(F.sum("w").alias("points"))


def _monday(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def _held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def revise_weeks(batch: DataFrame, number: int, feeds: DataFrame, archive: str, weeks: str) -> None:
    """Adds a batch of articles to an archive by week, and counts again the weeks that it touches, and no others.

    Each link is taken once, in its earliest week of the batch. Archive rows carry the number of their batch: a batch that comes again after
    a failure finds its rows there, adds none, and counts the same weeks again, so that it changes nothing, wherever
    the first run broke off. Only the archive's ids and the touched weeks' articles are read; the table of weeks
    replaces those partitions alone, and a late article revises its week however old it is.
    """
    spark = batch.sparkSession
    rows = batch.filter((F.length("link") > 0) & F.col("ts").isNotNull()).withColumn("id", article_id(F.col("link")))
    rows = best_of(rows, ["id"], [F.col("ts"), F.xxhash64("source", "title")], 1, "_n").drop("_n")
    rows = rows.withColumn("batch", F.lit(number).cast("long")).withColumn("week", _monday(F.col("ts")))
    schema = f"{ARTICLES}, id string, batch long, week date"
    new = rows.join(_held(spark, archive, schema).select("id"), "id", "left_anti")
    new.select(*_held(spark, archive, schema).columns).write.mode("append").partitionBy("week").parquet(archive)
    held = _held(spark, archive, schema)
    touched = held.filter(F.col("batch") == number).select("week").distinct()
    # as a list, so that the scan skips the other weeks; a batch touches few
    some = [r[0] for r in touched.collect()]
    if some:
        points = week_points(held.filter(F.col("week").isin(some)), feeds)
        points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_start").parquet(weeks)


def into_weeks(articles: DataFrame, feeds: DataFrame, archive: str, weeks: str, checkpoint: str) -> StreamingQuery:
    """Starts the upkeep of weekly keyword points from a stream of articles, by :func:`revise_weeks`."""
    revise = lambda batch, number: revise_weeks(batch, number, feeds, archive, weeks)
    return articles.writeStream.foreachBatch(revise).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_archive(articles: DataFrame, path: str, checkpoint: str, back: int | None = 400) -> StreamingQuery:
    """Starts the append of new articles to an archive: each link once, so that a batch that runs twice adds nothing.

    Of a batch's rows of one link the earliest stays. Rows without a link go. The archive is partitioned by date; only its
    ids are read, those of the last ``back`` days before the batch's first date, so that the work of a batch doesn't grow with
    the archive; with None, all of them.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.length("link") > 0).withColumn("id", article_id(F.col("link"))).withColumn("date", F.to_date("ts"))
        rows = best_of(rows, ["id"], [F.col("ts"), F.xxhash64("source", "title")], 1, "_n").drop("_n")
        held = _held(spark, path, "id string, date date")
        if back is not None:
            first = rows.agg(F.min("date")).first()[0]
            held = held.filter(F.col("date") >= F.date_sub(F.lit(first), back))
        rows.join(held.select("id"), "id", "left_anti").write.mode("append").partitionBy("date").parquet(path)

    return articles.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
