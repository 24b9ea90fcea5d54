"""Nearest neighbours by inner product with score-aware (anisotropic) four-bit quantisation.

Directions of vectors are cut into pairs of dimensions, and each pair is named by one of 16 codewords.
Codewords are trained, and codes chosen, under a loss that weighs the residual parallel to the vector
more than the residual across it: only the parallel part biases the inner products that are large
enough to matter. A query turns the codewords into tables of 16 partial scores; two four-bit codes
share a byte, so a scan looks up one of 256 sums for each byte. The scan only chooses what is scored
again, exactly, on the original vectors.

What is scored again has no fixed size: every row whose scanned score plus ``SLACK`` standard errors
reaches the k-th best scanned score. Where thousands of copies are alike to the codes, all of them are
scored exactly.

The codebook is fitted on at most ``MAX_TRAIN`` vectors (those with the smallest hashes of their ids);
every vector is indexed. Index and queries are packed in blocks of bounded size, and each pair of
blocks is one small task's work, so no group grows with the data. Blocks of the index are met in waves, each ``WAVE`` times as many
as all before it, dealt at random. After a wave a query knows the k-th best score that it has seen, and later blocks return
only what reaches it, so a query's candidates grow with the number of waves, not of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.llm.common import Scratch

#: Vectors that train the codebook at most.
MAX_TRAIN = 8192
WORDS = 16
#: Inner products with a unit vector that count as large; the parallel weight follows from it.
THRESHOLD = 0.2
SLACK = 3.0
ROWS_IN_BLOCK = 8192
QUERIES_IN_BLOCK = 16_384
ROUNDS = 8
WAVE = 8


class Codebook:
    """Codewords (pairs, WORDS, 2) of unit vectors, and the standard error of a scanned score."""

    def __init__(self, words, parallel: float, error: float = 0.0) -> None:
        self.words, self.parallel, self.error = words, parallel, error

    def encode(self, unit, sweeps: int = 2):
        """Codes (n, pairs) of unit vectors by coordinate descent on the anisotropic loss."""
        import numpy as np

        n, pairs = len(unit), len(self.words)
        x = unit.reshape(n, pairs, 2)
        # across: squared residual; along: squared part of the residual that is parallel to the vector
        off = x[:, :, None, :] - self.words[None] if n * pairs <= 1 << 18 else None
        codes = np.empty((n, pairs), np.uint8)
        along = np.zeros(n, np.float32)
        here = np.empty((n, pairs), np.float32)
        extra = self.parallel - 1

        def parts(m: int):
            r = off[:, m] if off is not None else x[:, m, None, :] - self.words[m][None]
            return (r * r).sum(-1), (r * x[:, m, None, :]).sum(-1)

        rows = np.arange(n)
        for m in range(pairs):
            across, side = parts(m)
            codes[:, m] = k = across.argmin(1)
            here[:, m] = side[rows, k]
        along = here.sum(1)
        for _ in range(sweeps):
            for m in range(pairs):
                across, side = parts(m)
                rest = along - here[:, m]
                codes[:, m] = k = (across + extra * (rest[:, None] + side) ** 2).argmin(1)
                here[:, m] = side[rows, k]
                along = rest + here[:, m]
        return codes

    def decode(self, codes):
        import numpy as np

        return self.words[np.arange(len(self.words))[None], codes].reshape(len(codes), -1)

    def tables(self, queries):
        """(pairs / 2, 256, n): the partial scores of ``queries`` for each byte of two codes."""
        import numpy as np

        q = queries.reshape(len(queries), len(self.words), 2)
        one = np.einsum("mwd,nmd->mwn", self.words, q)  # pairs, words, n
        return (one[0::2, None, :, :] + one[1::2, :, None, :]).reshape(len(self.words) // 2, WORDS * WORDS, len(queries))


def packed(codes):
    """Two codes a byte: the first in the low four bits."""
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def padded(vectors):
    """Vectors with zeros up to a multiple of four dimensions, for pairs of pairs."""
    import numpy as np

    more = -vectors.shape[1] % 4
    return np.pad(vectors, ((0, 0), (0, more))) if more else vectors


def fit(vectors, threshold: float = THRESHOLD, seed: int = 3) -> Codebook:
    """A codebook of the directions of ``vectors`` by alternating codes and least squares.

    With the codes fixed, the loss is quadratic in all codewords together: each sample adds its squared
    residual and (parallel - 1) times the squared parallel part, so one linear system gives them.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    unit = padded(vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    n, d = unit.shape
    pairs = d // 2
    parallel = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    x = unit.reshape(n, pairs, 2)
    start = rng.choice(n, WORDS, replace=n < WORDS)
    book = Codebook(np.ascontiguousarray(x[start].transpose(1, 0, 2)) + rng.normal(0, 1e-4, (pairs, WORDS, 2)).astype(np.float32), 1.0)
    for step in range(ROUNDS):
        book.parallel = 1.0 if step < ROUNDS // 2 else parallel
        codes = book.encode(unit, sweeps=0 if book.parallel == 1 else 1).astype(np.int64)
        at = (np.arange(pairs)[None, :, None] * WORDS + codes[:, :, None]) * 2 + np.arange(2)[None, None, :]
        at = at.reshape(n, d)
        size = pairs * WORDS * 2
        counts = np.bincount(at.ravel(), minlength=size).astype(float)
        target = np.bincount(at.ravel(), weights=(unit * book.parallel).ravel(), minlength=size)
        left = np.diag(counts + 1e-3)
        if book.parallel > 1:
            marked = np.zeros((n, size), np.float32)
            np.put_along_axis(marked, at, unit, axis=1)
            left += (book.parallel - 1) * (marked.T @ marked)
        book.words = np.linalg.solve(left, target).reshape(pairs, WORDS, 2).astype(np.float32)
    book.parallel = parallel
    some = unit[rng.permutation(n)[:1024]]
    rest = some - book.decode(book.encode(some))
    # the error of q . x over directions q: the residual's share in one dimension, seen on sampled pairs
    seen = (some[rng.permutation(len(some))] * rest).sum(1)
    book.error = float(max(np.sqrt((rest**2).sum(1).mean() / vectors.shape[1]), np.sqrt((seen**2).mean())))
    return book


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``key``, v (array of the column's own type, float or double) of the rows that can take part.

    Null keys take no part, nor do vectors that are null, empty, zero, or hold null or non-finite
    components.
    """
    kind = "float" if vectors.schema[column].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(key, F.col(column).cast(f"array<{kind}>").alias("v")).filter(F.col(key).isNotNull() & (F.size("v") > 0))
    return rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))


def _directions(v):
    import numpy as np

    wide = v.astype(float)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _blocks(rows: DataFrame, n: int, size: int, key: str, d: int, book: Codebook | None) -> tuple[DataFrame, int]:
    """``rows`` dealt evenly over numbered blocks of about ``size`` rows, each packed in one row; their number."""
    import pyarrow as pa

    count = max(1, -(-n // size))
    each = 8 if count > 1024 else 1  # blocks that one task makes
    tasks = -(-count // each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        for i in range(each):
            a, b = table.num_rows * i // each, table.num_rows * (i + 1) // each
            if a == b:
                continue
            ids = table.column(key).slice(a, b - a).combine_chunks()
            v = table.column("v").slice(a, b - a).combine_chunks().flatten().to_numpy().reshape(-1, d)
            codes = b""
            if book is not None:
                codes = packed(book.encode(padded(_directions(v)).astype(np.float32))).tobytes()
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() * each + i], pa.int64()), ids, pa.array([v.tobytes()], pa.binary()), pa.array([codes], pa.binary())], names=["block", "ids", "v", "codes"])

    key_type = rows.schema[key].dataType.simpleString()
    return rows.repartition(tasks).mapInArrow(run, f"block long, ids array<{key_type}>, v binary, codes binary"), tasks * each


def scan(book: Codebook, ids, v, codes, query_ids, q, k: int, bound=None):
    """Positions of queries and rows, and exact scores, of the ``k`` best rows of a block for each query, of those that reach its ``bound``."""
    import numpy as np

    keep = min(len(v), k + 1)  # a query may be among the rows
    rank = np.unique(np.concatenate([ids, query_ids]), return_inverse=True)[1]
    row_rank, query_rank = rank[: len(ids)], rank[len(ids) :]
    norm = np.linalg.norm(v, axis=1).astype(np.float32)
    down, found = np.ascontiguousarray(v.T), []
    for at in range(0, len(q), 128):
        some = q[at : at + 128]
        tables = book.tables(padded(some).astype(np.float32))
        near = np.zeros((len(v), len(some)), np.float32)
        for m in range(len(tables)):
            near += tables[m][codes[:, m]]
        near *= norm[:, None]
        near = np.ascontiguousarray(near.T)
        least = np.partition(near, len(v) - keep, axis=1)[:, len(v) - keep]
        slack = (SLACK * book.error * np.linalg.norm(some, axis=1)).astype(np.float32)
        if bound is not None:  # a score that the query has seen k times, less what single precision may take away
            known = bound[at : at + 128]
            least = np.maximum(least, np.where(np.isfinite(known), known - np.abs(known) * 1e-5, -np.inf).astype(np.float32))
        asks, rows = np.nonzero(near + slack[:, None] * norm[None, :] >= least[:, None])
        other = row_rank[rows] != query_rank[at + asks]
        asks, rows = asks[other], rows[other]
        across, score = np.ascontiguousarray(some.T), np.zeros(len(asks))
        for a in range(0, len(asks), 16384):
            x, y, part = asks[a : a + 16384], rows[a : a + 16384], score[a : a + 16384]
            for j in range(len(down)):  # in order of the dimensions, so that equal vectors tie exactly
                part += across[j][x] * down[j][y]
        if bound is not None:
            reach = score >= known[asks]
            asks, rows, score = asks[reach], rows[reach], score[reach]
        order = np.lexsort((row_rank[rows], -score, asks))
        asks, rows, score = asks[order], rows[order], score[order]
        first = np.searchsorted(asks, asks, side="left")
        best = np.arange(len(asks)) - first < k
        found.append((at + asks[best], rows[best], score[best]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", max_train: int = MAX_TRAIN) -> DataFrame:
    """query_id, rank, ``key``, score: the ``k`` rows of ``vectors`` nearest to each row of ``queries``.

    Both tables have ``key`` and ``column``; :func:`usable` says which rows take part. Vectors of another
    length than the most frequent one (the shorter, on a tie) take no part either. Of rows with one key,
    the smallest vector stays. A row is no neighbour of a query with its own key. score is the inner
    product in double precision, summed in order of the dimensions; ties go to the smaller key. Queries
    with fewer candidates get all of them; empty tables give an empty result; other columns are ignored.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    key_type = vectors.schema[key].dataType.simpleString()
    rows = usable(vectors, key, column)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], f"query_id {key_type}, rank int, {key} {key_type}, score double")
    d = lengths["d"]
    one = lambda t: t.filter(F.size("v") == d).groupBy(key).agg(F.min("v").alias("v"))
    rows = scratch.write(one(rows))
    asked = scratch.write(one(usable(queries, key, column)))
    n, n_asked = rows.count(), asked.count()
    share = int(2**64 * min(1.0, 2 * max_train / n)) - 2**63 - 1  # of the hashes, to sort few of the rows
    sample = rows.filter(F.xxhash64(key) <= share).orderBy(F.xxhash64(key), key).limit(max_train).select("v").collect()
    book = fit(np.array([r[0] for r in sample], float))
    index, blocks = _blocks(rows, n, ROWS_IN_BLOCK, key, d, book)
    sought, asking = _blocks(asked, n_asked, QUERIES_IN_BLOCK, key, d, None)
    index, sought = scratch.write(index), scratch.write(sought)
    scratch.drop(rows, asked)
    # vectors travel as they are stored, four or eight bytes a component, and are made double where they are scored
    row_kind, query_kind = ("<f4" if t.schema["v"].dataType.simpleString() == "array<float>" else "<f8" for t in (rows, asked))
    # a query's place in its block, to bring it its bound
    places = sought.select("block", F.posexplode("ids").alias("place", "query_id"))
    numbers = lambda first, end: F.explode(F.sequence(F.lit(first).cast("long"), F.lit(end - 1).cast("long")))

    def meet(pair: pd.DataFrame) -> pd.DataFrame:
        if len(pair) < 2:
            return pd.DataFrame({"query_id": [], key: [], "score": []})
        r, q = pair[pair["indexed"]].iloc[0], pair[~pair["indexed"]].iloc[0]
        v, asked_v = (np.frombuffer(x["v"], kind).astype(float).reshape(-1, d) for x, kind in ((r, row_kind), (q, query_kind)))
        ids, query_ids = np.asarray(r["ids"]), np.asarray(q["ids"])
        codes = np.frombuffer(r["codes"], np.uint8).reshape(len(v), -1)
        bound = None if q["bounds"] is None else np.asarray(q["bounds"], float)
        x, y, score = scan(book, ids, v, codes, query_ids, asked_v, k, bound)
        return pd.DataFrame({"query_id": query_ids[x], key: ids[y], "score": score})

    best = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    none = F.lit(None).cast("array<double>")
    found, start, stop = None, 0, 1
    while start < blocks:
        stop = min(blocks, stop)
        bounds = None
        if found is not None:
            kth = found.groupBy("query_id").agg(F.count("*").alias("have"), F.min("score").alias("kth")).filter(F.col("have") == k)
            held = places.join(kth, "query_id", "left").select("block", "place", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
            bounds = held.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "kth"))).alias("b")).select(F.col("block").alias("asking"), F.col("b.kth").alias("bounds"))
        # each block of the index meets each block of queries in a call of its own
        left = index.filter((F.col("block") >= start) & (F.col("block") < stop)).select("block", numbers(0, asking).alias("asking"), "ids", "v", "codes", none.alias("bounds"), F.lit(True).alias("indexed"))
        asks = sought.select(F.col("block").alias("asking"), "ids", "v", "codes")
        asks = asks.withColumn("bounds", none) if bounds is None else asks.join(bounds, "asking", "left")
        right = asks.select(numbers(start, stop).alias("block"), "asking", "ids", "v", "codes", "bounds", F.lit(False).alias("indexed"))
        new = left.unionByName(right).groupBy("block", "asking").applyInPandas(meet, f"query_id {key_type}, {key} {key_type}, score double")
        both = new if found is None else found.unionByName(new)
        kept = both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        start, stop = stop, stop + WAVE * stop
        last = start >= blocks
        if last:
            return kept.select("query_id", "rank", key, "score")
        before, found = found, scratch.write(kept.drop("rank"))
        if before is not None:
            scratch.drop(before)
    return spark.createDataFrame([], f"query_id {key_type}, rank int, {key} {key_type}, score double")


def query(spark, sf_dir):
    """The 20 nearest of every twentieth row of ``embeddings``, by inner product."""
    from galley.session import table

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
