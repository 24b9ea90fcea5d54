"""Exact deduplication with counting quotient filters.

Each partition builds a counting quotient filter of its rows' fingerprints. The space of fingerprints is cut in
regions, and a region of a filter is one row: its table has about as many quotients as entries, an entry's
quotient is kept as the length of the quotient's run, its remainder in as few bytes as it needs, and a count
only where it is above one. Filters merge without loss: a region's runs are turned back to sorted
fingerprints, merged in one pass, and their counts added. Fingerprints whose count exceeds one are routed to a
comparison of whole texts; a fingerprint seen once proves its text unique.

The sizes follow the number of rows: fingerprints are ``SPARE_BITS`` longer than that number, so few texts
share one by chance at any size, and there are so many regions that one holds about ``REGION_ROWS``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.common import SPACE, Scratch, numbered, small_broadcast

#: Bits of a fingerprint beyond those that number the rows.
SPARE_BITS = 24
#: Fingerprints that one call merges, about; there are ``2 ** LEAST_REGION_BITS`` regions at least.
REGION_ROWS = 1 << 18
LEAST_REGION_BITS = 6


def normalised(text: str) -> Column:
    """The text with each run of ASCII white space as one space; '' for null."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def filter_sizes(rows: int) -> tuple[int, int]:
    """Bits of fingerprints and of region numbers for so many rows."""
    number = max(1, rows - 1).bit_length()
    return min(64, number + SPARE_BITS), max(LEAST_REGION_BITS, number - (REGION_ROWS.bit_length() - 1))


def pack_run(entries, counts, bits: int) -> tuple[int, bytes, bytes, bytes]:
    """Quotient bits, run lengths, remainders and counts of sorted distinct ``entries`` below 2 ** ``bits``."""
    import numpy as np

    quotient_bits = min(bits, max(0, len(entries) - 1).bit_length())
    rest = bits - quotient_bits
    runs = np.bincount((entries >> np.uint64(rest)).astype(np.int64) if rest < 64 else np.zeros(len(entries), np.int64), minlength=1 << quotient_bits)
    remainders = entries & np.uint64((1 << rest) - 1)
    width = -(-rest // 8)
    many = np.flatnonzero(counts > 1)
    return quotient_bits, runs.astype("<u1" if runs.max(initial=0) < 256 else "<u4").tobytes(), np.ascontiguousarray(remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes(), many.astype("<u4").tobytes() + counts[many].astype("<i8").tobytes()


def unpack_run(quotient_bits: int, runs: bytes, remainders: bytes, many: bytes, bits: int):
    """The sorted entries and their counts that :func:`pack_run` has packed."""
    import numpy as np

    lengths = np.frombuffer(runs, "<u1" if len(runs) == 1 << quotient_bits else "<u4").astype(np.int64)
    rest, n = bits - quotient_bits, int(lengths.sum())
    width = -(-rest // 8)
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = np.frombuffer(remainders, np.uint8).reshape(n, width)
    entries = low.view("<u8").ravel().astype(np.uint64)
    if rest < 64:
        entries |= np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths) << np.uint64(rest)
    counts = np.ones(n, np.int64)
    k = len(many) // 12
    counts[np.frombuffer(many, "<u4", k)] = np.frombuffer(many, "<i8", k, 4 * k)
    return entries, counts


def partition_filters(fingerprints: DataFrame, bits: int, region_bits: int) -> DataFrame:
    """A filter for each partition of ``fingerprints`` (fp long): a row for each region with entries."""
    import numpy as np
    import pyarrow as pa

    inner = bits - region_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for batch in batches]
        if not sum(map(len, parts)):
            return
        entries, counts = np.unique(np.concatenate(parts), return_counts=True)  # 8 bytes a row of the partition
        regions = (entries >> np.uint64(inner)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, regions[1:] != regions[:-1]])
        ends = np.r_[starts[1:], len(entries)]
        mask = np.uint64((1 << inner) - 1)
        for at in range(0, len(starts), 4096):
            rows = [(int(regions[a]), *pack_run(entries[a:b] & mask, counts[a:b], inner)) for a, b in zip(starts[at : at + 4096], ends[at : at + 4096], strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["region", "quotient_bits", "runs", "remainders", "many"])

    return fingerprints.select("fp").mapInArrow(build, "region long, quotient_bits int, runs binary, remainders binary, many binary")


def merged_counts(filters: DataFrame, bits: int, region_bits: int, least: int = 2) -> DataFrame:
    """fp, n of all filters together, for counts of at least ``least``."""
    import pandas as pd

    inner = bits - region_bits

    def merge(region: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        runs = [unpack_run(*r, inner) for r in zip(region["quotient_bits"], region["runs"], region["remainders"], region["many"], strict=True)]
        entries, counts = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
        order = np.argsort(entries, kind="stable")  # runs are sorted already, which a stable sort makes use of
        entries, counts = entries[order], counts[order]
        first = np.flatnonzero(np.r_[True, entries[1:] != entries[:-1]])
        n = np.add.reduceat(counts, first)
        full = entries[first] | np.uint64(int(region["region"].iloc[0]) << inner)
        return pd.DataFrame({"fp": full[n >= least].view(np.int64), "n": n[n >= least]})

    return filters.groupBy("region").applyInPandas(merge, "fp long, n long")


def exact_groups(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when identical with each run of ASCII white space as one space; null counts as
    empty, so null, empty and blank-free empty texts form one group. The smallest doc_id of a group stays
    (a null id only if there is no other). Rows that repeat a doc_id count each in group_size and share
    its fate. An empty table gives an empty result; other columns are ignored. ``bits`` sets the length of
    fingerprints, which otherwise follows the number of rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = docs.select("doc_id", normalised("text").alias("norm"))
    prints = scratch.write(rows.select("doc_id", F.xxhash64("norm").alias("hash"), F.sha2("norm", 256).alias("text_sha256")))
    sized, region_bits = filter_sizes(prints.count())
    bits = bits or sized
    region_bits = min(region_bits, bits)
    short = lambda c: F.shiftrightunsigned(c, 64 - bits)
    repeated = scratch.write(merged_counts(partition_filters(prints.select(short("hash").alias("fp")), bits, region_bits), bits, region_bits).select("fp"))
    routed = rows.withColumn("fp", short(F.xxhash64("norm"))).join(small_broadcast(repeated, repeated.count(), 16), "fp", "left_semi")
    # grouping by the whole text compares bytes; copies meet their kind before the shuffle
    groups = routed.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = scratch.write(groups.filter("group_size > 1").select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    out = prints.join(small_broadcast(groups, groups.count(), 128), "text_sha256", "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: that with the smallest doc_id, nulls last.

    Rows are told apart by themselves, not by doc_id: of rows that repeat wholly one stays, and rows that
    share a doc_id but not a text stay both. All columns come back, whatever their names and types; an
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = numbered(docs, scratch)
    own = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id"), "key")
    kept = exact_groups(rows.select(own.alias("doc_id"), "row.text")).filter("kept").select("doc_id.key")
    return rows.join(kept, "key", "left_semi").select("row.*")


def query(spark, sf_dir):
    """One row per document of ``documents``: which one stays for it, and the digest of its normalised text."""
    from galley.session import table

    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
