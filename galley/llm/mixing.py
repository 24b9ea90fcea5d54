"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / size of the source. Laid end to
end in a fixed order, the expected copies are prefix-summed, one random offset is added, and a document
is emitted once for each integer boundary that its interval crosses.

The order within a source is (size class, hash bucket, size, doc_id). Walking through the sizes in order
makes the sample take large and small documents in proportion, so its words come near the target. Of
``DRAWS`` random offsets a source uses the one whose words come nearest (rejective sampling): a few huge
documents then don't spoil a small source.

The prefix sum never gathers a source in one task: rows are counted by (source, class, bucket), these
counts are summed over at most ``90 * digits`` classes and 256 buckets, and only the rows of one
bucket are numbered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.llm.common import Scratch, column, numbered, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
DRAWS = 16
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Target words of each source.

    ``sizes`` has one row a source: source, source_size. Sources in code point order, null last, weigh
    ``weights`` in turn and share the sum of all sizes; a target stops at ``max_repeats`` times the size
    and the excess is shared again by weight. That fixed point is min(cap, level * weight) for one level,
    found here with running sums over the sources ordered by cap / weight. A source of size 0 gets 0.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.hex(F.col("source").cast("binary")))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("w", turn).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.hex(F.col("source").cast("binary")))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum(F.col("source_size")).over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    found = weighed.withColumn("level", level)
    # the first source, in order, that its share doesn't fill sets the level; later ones give lower levels
    found = found.withColumn("water", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(everything))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("w")))
    return found.select("source", "source_size", target.alias("target"))


def _size_class(size: Column) -> Column:
    """The size with all but its first two digits cleared."""
    unit = F.pow(F.lit(10.0), F.length(size.cast("string")) - 2).cast("long")
    return F.when(size < 100, size).otherwise(F.floor(size / unit).cast("long") * unit)


def _offset(draw: Column) -> Column:
    """One of 4096 offsets in [0, 1), exact in binary, from the seed, the source and the draw."""
    name = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    digest = F.md5(F.concat(F.lit(SEED + ":"), draw.cast("string"), F.lit(":"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("double") / 4096


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, draws: int = DRAWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (a long from 0 to ``max_repeats``) for every row.

    Null texts and texts without words have size 0; they are sampled like others and take no words. Null
    sources form one source. Rows that repeat a doc_id count as documents of their own. An empty table
    gives an empty result. Other columns are ignored.
    """
    # the texts are read once; all that follows is on the sizes
    sized = Scratch(docs.sparkSession, "mix").write(docs.select(*_sizes()))
    return _drawn(sized, weights, max_repeats, draws, []).select("doc_id", "source", "size", "source_size", "target", "copies")


def _sizes() -> list[Column]:
    """What sampling reads of a row. The text's hash orders rows that share a doc_id, and deals out those without one."""
    return [F.col("doc_id"), F.col("source"), word_count("text").alias("size"), F.xxhash64("text").alias("text_hash")]


def _drawn(sized: DataFrame, weights: tuple[int, ...], max_repeats: int, draws: int, more: list[str]) -> DataFrame:
    """The rows of ``sized`` with source_size, target and copies; columns ``more`` break the last ties."""
    rows = sized.withColumn("class", _size_class(F.col("size"))).withColumn("bucket", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text_hash").cast("string")).cast("binary")), 1, 2))
    cells = rows.groupBy("source", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("cell_size"))
    classes = rows.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("class_size"))
    sizes = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats).withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeats)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)))
    before_class = F.sum("n").over(W.partitionBy("source").orderBy("class")) - F.col("n")
    classes = classes.select("source", "class", before_class.alias("class_start"))
    classes = classes.alias("k").join(targets.alias("t"), F.expr("k.source <=> t.source")).select("k.source", "class", "class_start", "source_size", "target", "rate")
    before_cell = F.sum("n").over(W.partitionBy("source", "class").orderBy("bucket")) - F.col("n")
    starts = cells.select("source", "class", "bucket", before_cell.alias("cell_start"))
    starts = starts.alias("c").join(classes.alias("k"), F.expr("c.source <=> k.source AND c.class = k.class")).select("c.source", "c.class", "bucket", (F.col("cell_start") + F.col("class_start")).alias("start"), "source_size", "target", "rate")
    placed = rows.alias("r").join(starts.alias("s"), F.expr("r.source <=> s.source AND r.class = s.class AND r.bucket = s.bucket")).select("doc_id", "r.source", "size", "text_hash", *more, "r.class", "r.bucket", "start", "source_size", "target", "rate")
    within = W.partitionBy("source", "class", "bucket").orderBy("size", F.col("doc_id").asc_nulls_last(), "text_hash", *more)
    placed = placed.withColumn("k", F.col("start") + F.row_number().over(within))

    def crossed(u: Column) -> Column:
        jump = F.floor(u + F.col("rate") * F.col("k")) - F.floor(u + F.col("rate") * (F.col("k") - 1))
        return F.least(F.lit(max_repeats).cast("long"), jump.cast("long"))

    tried = [crossed(_offset(F.lit(d))) * F.col("size") for d in range(draws)]
    sums = placed.groupBy("source").agg(*[F.sum(t).alias(f"w{d}") for d, t in enumerate(tried)], F.max("target").alias("target"))
    gaps = F.array(*[F.struct(F.abs(F.col(f"w{d}") - F.col("target")).alias("gap"), F.lit(d).alias("draw")) for d in range(draws)])
    chosen = sums.select("source", F.array_min(gaps)["draw"].alias("draw"))
    chosen = chosen.select("source", _offset(F.col("draw")).alias("offset"))
    # one row a source: broadcast by Spark itself where it is below the session's threshold
    out = placed.alias("p").join(chosen.alias("o"), F.expr("p.source <=> o.source"))
    return out.select("doc_id", "p.source", "size", *more, "source_size", "target", crossed(F.col("offset")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents of the mix, each as many times as it was drawn, with the columns of ``docs``.

    Every row is drawn for itself, at most ``max_repeats`` times, whether its doc_id is null, repeated or its own.
    Null texts and sources are treated as in :func:`copies`. All columns come back, whatever their names and
    types; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    # the hash makes draws repeatable; rows that it can't tell apart are equal but for columns without a hash
    hashed = F.xxhash64(*[column(f.name) for f in docs.schema if _hashable(f.dataType)])
    rows = numbered(docs, scratch, *_sizes(), hashed.alias("row_hash"))
    drawn = _drawn(rows.drop("row"), weights, max_repeats, DRAWS, ["row_hash", "key"]).filter(F.col("copies") > 0).select("key", "copies")
    picked = rows.select("key", "row").join(drawn, "key")
    return picked.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def _hashable(kind) -> bool:
    """Whether Spark hashes values of this type: maps and variants, alone or inside, have no hash."""
    return not any(x in kind.simpleString() for x in ("map<", "variant"))


def query(spark, sf_dir):
    """One row per document of ``documents``: its words, its source and its target, and the words that the mix takes."""
    from galley.session import table

    mixed = copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same sample with one global window a source instead of counted buckets.
SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)] AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
       / sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT max(level) FROM l WHERE level <= cap / w) * w), cap) AS target FROM l),
k AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0.0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY
          CASE WHEN d.size < 100 THEN d.size ELSE (d.size // (10 ** (len(d.size::VARCHAR) - 2))::BIGINT) * (10 ** (len(d.size::VARCHAR) - 2))::BIGINT END,
          substr(md5(d.doc_id::VARCHAR), 1, 2), d.size, d.doc_id) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT source, i AS draw, ('0x' || substr(md5('mix-1:' || i::VARCHAR || ':' || coalesce('s' || source, 'n')), 1, 3))::INTEGER / 4096.0::DOUBLE AS u
      FROM s CROSS JOIN range(16) r(i)),
g AS (SELECT k.source, u.draw, u.u, abs(sum(k.size * least(3, floor(u.u + rate * k) - floor(u.u + rate * (k - 1)))) - max(target)) AS gap
      FROM k JOIN u ON k.source IS NOT DISTINCT FROM u.source GROUP BY ALL),
o AS (SELECT source, arg_min(u, (gap, draw)) AS u FROM g GROUP BY source)
SELECT doc_id, size, source_size, target, (size * least(3, floor(o.u + rate * k) - floor(o.u + rate * (k - 1))))::BIGINT AS taken
FROM k JOIN o ON k.source IS NOT DISTINCT FROM o.source
"""
