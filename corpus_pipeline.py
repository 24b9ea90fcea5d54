"""From raw documents to packed training sequences: each stage calls one operator of ``galley.llm``.

Stages take (spark, docs, sf_dir) and return a DataFrame; the output of one, written as Parquet and read
again, is the ``docs`` of the next. All but the last return the columns of documents. A stage leaves the tables that
its result reads, and deletes none of another stage's; :func:`run` deletes them once it has written the result, and who calls
stages can do so with ``collecting`` and ``discard`` of ``galley.llm.common``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import exact_dedup, mixing, near_dedup, packing, quality
from galley.llm.common import Scratch, collecting, discard
from galley.session import table

#: Documents go only if the classifier is this sure that they are poor.
LEAST_QUALITY = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject, learned from the labels outside the held-out third."""
    labels = table(spark, sf_dir, "labels")
    labels = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return quality.reject_low(docs, quality.fit(docs, labels), LEAST_QUALITY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a document stands as often as it was drawn."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 2048."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. What a stage keeps for itself goes when its result is written, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark, name)
        with collecting() as made:
            docs = scratch.write(stage(spark, docs, sf_dir))
        discard(spark, [*made, *([before.path] if before else [])])
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier can't be written in SQL; tests compare the other stages with brute force.
ORACLE_SQL = None
