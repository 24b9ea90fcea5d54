"""Hard negatives by dual-tree search over anchors and candidates.

Vectors of integers stand in two kinds of ball trees. For a node of anchors (center a, radius r) and a node of
candidates (center c, radius s) all inner products lie in ``a.c +- (r |c| + s |a| + r s)``. A pair of nodes whose
interval misses what every anchor below still looks for is pruned at once, for the whole group of anchors;
pairs of leaves that are left are scored exactly, in integers.

* The upper tree is fitted on a bounded sample and has at most ``MAX_NODES`` leaves. Every row is routed down
  it; counts and radii come from all rows. A leaf's rows are dealt over chunks of about ``ROWS`` rows, so no node
  is too large for a task, whatever number of copies it holds. Each chunk is sorted into a lower tree of its own, whose
  nodes are halves of halves of its rows.
* An anchor looks for the best ``k`` rows of each of its *slots*: a range of scores, among rows of its own label or
  of the others. Positives are one slot without bounds; each positive then makes a slot of its own for negatives.
* Chunks are met in waves, those with the nearest centers first, each wave sixteen times as many as all before
  it. After a wave the ``k``-th best score of a slot becomes its lower bound, so a later chunk only returns what can
  still be among the best, and what is returned grows with the number of waves, not of chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.llm.common import Scratch, column

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between so many hundredths of the positive's.
LEAST, MOST = 50, 95
#: Vectors that fit the upper tree at most, and its leaves at most.
MAX_TRAIN = 8192
MAX_NODES = 512
ROWS = 4096
ANCHORS = 4096
LEAF = 128
ANCHOR_LEAF = 32
#: Leaves of candidates that are scored at a time.
TOGETHER = 8
WAVE = 16

_LONG = 2**63 - 1


def split(v):
    """Positions of the rows of ``v``, the nearer to the first of two far rows first."""
    import numpy as np

    center = v.mean(0)
    one = v[((v - center) ** 2).sum(1).argmax()]
    two = v[((v - one) ** 2).sum(1).argmax()]
    return np.argsort(v @ (two - one), kind="stable")


class Router:
    """The upper tree: a hyperplane in each inner node of a complete binary tree, the sample's center in each leaf."""

    def __init__(self, sample, leaves: int) -> None:
        import numpy as np

        self.depth = max(0, (leaves - 1).bit_length())
        d = sample.shape[1]
        self.directions = np.zeros((2**self.depth, d))
        self.thresholds = np.zeros(2**self.depth)
        self.centers = np.zeros((2**self.depth, d))
        todo = [(1, sample)]  # nodes are numbered like a heap
        while todo:
            node, rows = todo.pop()
            if node >= 2**self.depth:
                self.centers[node - 2**self.depth] = rows.mean(0)
                continue
            order = split(rows)
            first, last = rows[order[0]], rows[order[-1]]
            self.directions[node] = last - first
            along = rows @ self.directions[node]
            self.thresholds[node] = np.median(along)
            below = along < self.thresholds[node]
            # copies are all on one side; an empty side is served by the whole
            todo += [(2 * node, rows[below] if below.any() else rows), (2 * node + 1, rows[~below] if (~below).any() else rows)]

    def __call__(self, v):
        """The leaf of each row, and its distance from the leaf's center."""
        import numpy as np

        node = np.ones(len(v), np.int64)
        for _ in range(self.depth):
            node = 2 * node + ((v * self.directions[node]).sum(1) >= self.thresholds[node])
        node -= 2**self.depth
        return node, np.sqrt(((v - self.centers[node]) ** 2).sum(1))


class Tree:
    """A lower tree over rows in its order: level by level the edges, centers and radii of its nodes."""

    def __init__(self, v, leaf: int) -> None:
        import numpy as np

        self.v = v = v.astype(float)
        depth = max(0, (-(-len(v) // leaf) - 1).bit_length())
        self.edges = [halves(len(v), level) for level in range(depth + 1)]
        self.centers, self.radii = [], []
        for edges in self.edges:
            size = np.diff(edges)
            center = np.add.reduceat(v, edges[:-1], axis=0) / size[:, None]
            off = np.sqrt(((v - np.repeat(center, size, axis=0)) ** 2).sum(1))
            self.centers.append(center)
            self.radii.append(np.maximum.reduceat(off, edges[:-1]))

    @property
    def depth(self) -> int:
        return len(self.edges) - 1


def halves(n: int, level: int):
    """Edges of the parts of ``n`` rows after ``level`` halvings; none is empty if n >= 2**level."""
    import numpy as np

    return np.arange(2**level + 1) * n >> level


def tree_order(v, leaf: int):
    """An order of the rows such that each half of a half ... lies close together."""
    import numpy as np

    v = v.astype(float)
    order = np.arange(len(v))
    depth = max(0, (-(-len(v) // leaf) - 1).bit_length())
    for level in range(depth):
        # halves of a level are told apart by the edges of the next
        edges, inner = halves(len(v), level), halves(len(v), level + 1)
        for i in range(2**level):
            a, m, b = edges[i], inner[2 * i + 1], edges[i + 1]
            part = order[a:b]
            sorted_ = part[split(v[part])]
            order[a:m], order[m:b] = sorted_[: m - a], sorted_[m - a :]
    return order


def intervals(a, r, c, s):
    """Lower and upper bounds of the inner products of two balls, for each pair of rows of the arguments, widened by rounding."""
    import numpy as np

    product = (a * c).sum(-1)
    one, two = np.sqrt((a * a).sum(-1)), np.sqrt((c * c).sum(-1))
    margin = r * two + s * one + r * s
    margin = margin * (1 + 1e-9) + (np.abs(product) + (one + r) * (two + s)) * 1e-9 + 1e-6
    return product - margin, product + margin


def exact_products(a, c):
    """Inner products of integer rows: in double precision where that is exact, else of Python integers, held to 64 bits."""
    import numpy as np

    largest = int(max(1, np.abs(a.astype(float)).max(initial=0))) * int(max(1, np.abs(c.astype(float)).max(initial=0))) * a.shape[1]
    if largest < 2**52:
        return (a.astype(float) @ c.astype(float).T).astype(np.int64)
    full = a.astype(object) @ c.astype(object).T
    return np.clip(full, -_LONG, _LONG).astype(np.int64)


def meet(anchors: dict, rows: dict, k: int, same: bool, seen: list | None = None):
    """Of two chunks (v, ids, labels; anchors also low and high, (n, slots)): anchor position, slot, row position, score.

    For each anchor and slot the best ``k`` rows of the other chunk with low <= score <= high, of the anchor's label if
    ``same``, else of other labels; ties go to the smaller id, and a row is no partner of itself. ``seen`` gets the
    numbers of pairs of rows, and of those that were scored.
    """
    import numpy as np

    a, c = Tree(anchors["v"], ANCHOR_LEAF), Tree(rows["v"], LEAF)
    low, high = anchors["low"].copy(), anchors["high"]
    codes = np.unique(np.concatenate([anchors["labels"], rows["labels"]]), return_inverse=True)[1]
    a_label, c_label = codes[: len(anchors["ids"])], codes[len(anchors["ids"]) :]
    wanted = lambda: (np.where(low <= high, low, _LONG).min(1), np.where(low <= high, high, -_LONG).max(1))
    need, most = wanted()
    x, y, i, j = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    upper = np.zeros(1)
    while True:
        least, upper = intervals(a.centers[i][x], a.radii[i][x], c.centers[j][y], c.radii[j][y])
        edges = a.edges[i][:-1]
        keep = (upper >= np.minimum.reduceat(need, edges)[x]) & (least <= np.maximum.reduceat(most, edges)[x])
        x, y, upper = x[keep], y[keep], upper[keep]
        if i == a.depth and j == c.depth:
            break
        if i < a.depth:
            x, y, i = np.concatenate([2 * x, 2 * x + 1]), np.concatenate([y, y]), i + 1
        if j < c.depth:
            x, y, j = np.concatenate([x, x]), np.concatenate([2 * y, 2 * y + 1]), j + 1
    order = np.lexsort((-upper, x))
    x, y, upper = x[order], y[order], upper[order]
    scored, found = 0, []
    edges, inner = a.edges[-1], c.edges[-1]
    for leaf in np.unique(x):
        begin, end = np.searchsorted(x, [leaf, leaf + 1])
        own = slice(edges[leaf], edges[leaf + 1])
        slots = low.shape[1]
        best = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in range(slots)]
        for at in range(begin, end, TOGETHER):
            if upper[at] < wanted_of(low[own], high[own]):
                break  # nor can any leaf behind it
            some = np.concatenate([np.arange(inner[n], inner[n + 1]) for n in y[at : min(at + TOGETHER, end)]])
            score = exact_products(anchors["v"][own], rows["v"][some])
            scored += score.size
            fits = (a_label[own][:, None] == c_label[some][None, :]) == same
            if same:
                fits &= anchors["ids"][own][:, None] != rows["ids"][some][None, :]
            for slot in range(slots):
                asks, which = np.nonzero(fits & (score >= low[own, slot][:, None]) & (score <= high[own, slot][:, None]))
                if not len(asks):
                    continue
                old = best[slot]
                asks, which, got = (np.concatenate(p) for p in zip(old, (asks, some[which], score[asks, which]), strict=True))
                order = np.lexsort((rows["ids"][which], -got, asks))
                asks, which, got = asks[order], which[order], got[order]
                rank = np.arange(len(asks)) - np.searchsorted(asks, asks, side="left")
                asks, which, got = asks[rank < k], which[rank < k], got[rank < k]
                best[slot] = asks, which, got
                last = np.flatnonzero(rank[rank < k] == k - 1)
                now = low[own, slot]
                now[asks[last]] = np.maximum(now[asks[last]], got[last])
                low[own, slot] = now
        found += [(edges[leaf] + asks, np.full(len(asks), slot), which, got) for slot, (asks, which, got) in enumerate(best)]
    if seen is not None:
        seen += [len(anchors["ids"]) * len(rows["ids"]), scored]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def wanted_of(low, high) -> int:
    """The least score that any open slot still takes."""
    import numpy as np

    return int(np.where(low <= high, low, _LONG).min())


def usable(vectors: DataFrame, key: str, embedding: str, label: str, scale: int = SCALE) -> DataFrame:
    """vec, label and c (array of long, floor(``scale`` * x)) of the rows that take part.

    Rows with a null key or label take no part, nor do those whose vector is null, empty, or holds a null or
    non-finite component, or has another length than most (the shorter, on a tie). Of rows with one key the
    least (label, then vector) stays.
    """
    v = column(embedding).cast("array<double>")
    rows = vectors.select(column(key).cast("long").alias("vec"), column(label).alias("label"), v.alias("v")).filter("vec is not null and label is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.select("vec", "label", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("c"))
    return rows.groupBy("vec").agg(F.min(F.struct("label", "c")).alias("r")).select("vec", "r.label", "r.c")


class _Plan:
    """The upper tree over all rows: for each leaf center, radii, and ranges of chunk numbers."""

    def __init__(self, router: Router, leaves: list) -> None:
        import numpy as np

        n = len(router.centers)
        self.centers = router.centers
        self.radius, self.anchor_radius = np.zeros(n), np.zeros(n)
        rows, anchors = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for leaf in leaves:
            rows[leaf["node"]], anchors[leaf["node"]] = leaf["n"], leaf["n_anchors"]
            self.radius[leaf["node"]], self.anchor_radius[leaf["node"]] = leaf["r"], leaf["r_anchors"] or 0
        self.chunks, self.anchor_chunks = -(-rows // ROWS), -(-anchors // ANCHORS)
        self.first, self.anchor_first = np.cumsum(self.chunks) - self.chunks, np.cumsum(self.anchor_chunks) - self.anchor_chunks

    def waves(self) -> int:
        """So many that each is ``WAVE`` times as large as all before it, and the first is one chunk."""
        total, n, met = int(self.chunks.sum()), 0, 0
        while met < total:
            met += max(1, WAVE * met)
            n += 1
        return n

    def pairs(self, node: int, need: int, most: int, wave: int):
        """Chunks that the anchors of ``node`` meet in a wave, but for those whose interval misses need to most."""
        import numpy as np

        start = sum(((1 + WAVE) ** np.arange(wave - 1)) * WAVE) + 1 if wave else 0
        stop = start + (WAVE * start if wave else 1)
        order = np.argsort(-(self.centers @ self.centers[node]), kind="stable")
        order = order[self.chunks[order] > 0]
        place = np.cumsum(self.chunks[order]) - self.chunks[order]  # of the first chunk of each leaf
        least, upper = intervals(self.centers[node][None, :], self.anchor_radius[node], self.centers[order], self.radius[order])
        out = []
        for leaf, at, a, b in zip(order, place, least, upper, strict=True):
            if b >= need and a <= most:
                out += [int(self.first[leaf]) + i for i in range(max(0, start - at), min(int(self.chunks[leaf]), stop - at))]
        return out


def _packed(rows: DataFrame, by: str, leaf: int, d: int, slots: int) -> DataFrame:
    """One row for each chunk: its rows in the order of a lower tree, as packed integers of the narrowest type."""
    import pandas as pd

    label_type = rows.schema["label"].dataType.simpleString()

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        v = np.array(part["c"].tolist(), np.int64).reshape(len(part), d)
        order = tree_order(v, leaf)
        v, part = v[order], part.iloc[order]
        kind = next(t for t in ("<i2", "<i4", "<i8") if np.abs(v.astype(float)).max(initial=0) < np.iinfo(t).max or t == "<i8")
        one = {by: part[by].iloc[0], "kind": kind, "v": v.astype(kind).tobytes(), "ids": part["vec"].to_numpy(np.int64).tobytes(), "labels": part["label"].tolist()}
        if slots:
            one |= {x: np.array(part[x].tolist(), np.int64).tobytes() for x in ("low", "high")}
        return pd.DataFrame([one])

    more = ", low binary, high binary" if slots else ""
    return rows.groupBy(by).applyInPandas(pack, f"{by} long, kind string, v binary, ids binary, labels array<{label_type}>{more}")


def _unpacked(r: dict, d: int, prefix: str = "") -> dict:
    import numpy as np

    out = {"v": np.frombuffer(r[f"{prefix}v"], r[f"{prefix}kind"]).reshape(-1, d), "ids": np.frombuffer(r[f"{prefix}ids"], np.int64), "labels": np.asarray(r[f"{prefix}labels"])}
    return out | ({x: np.frombuffer(r[x], np.int64).reshape(len(out["ids"]), -1) for x in ("low", "high")} if not prefix else {})


class Search:
    """Anchors and candidates in their trees, ready for several searches."""

    def __init__(self, vectors: DataFrame, anchors: Column, key: str, embedding: str, label: str, scale: int, scratch: Scratch) -> None:
        import numpy as np
        import pyarrow as pa

        self.scratch = scratch
        chosen = vectors.filter(anchors).select(column(key).cast("long").alias("vec")).distinct()
        rows = usable(vectors, key, embedding, label, scale)
        rows = scratch.write(rows.join(chosen.withColumn("anchor", F.lit(True)), "vec", "left").withColumn("anchor", F.coalesce("anchor", F.lit(False))))
        lengths = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), "d").first()
        self.empty = lengths is None
        if self.empty:
            return
        self.d = d = lengths["d"]
        n = lengths["count"]
        rows = rows.filter(F.size("c") == d)
        share = int(2**64 * min(1.0, 2 * MAX_TRAIN / n)) - 2**63 - 1  # of the hashes, to sort few of the rows
        sample = rows.filter(F.xxhash64("vec") <= share).orderBy(F.xxhash64("vec"), "vec").limit(MAX_TRAIN).select("c").collect() or rows.limit(1).select("c").collect()
        sample = np.array([r[0] for r in sample], float)
        router = Router(sample, min(MAX_NODES, -(-n // ROWS), max(1, len(sample) // 16)))

        def route(batches):
            for batch in batches:
                v = batch.column("c").flatten().to_numpy().astype(float).reshape(-1, d)
                node, r = router(v)
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("vec", "label", "c", "anchor")), pa.array(node), pa.array(r)], names=["vec", "label", "c", "anchor", "node", "r"])

        label_type = rows.schema["label"].dataType.simpleString()
        self.rows = scratch.write(rows.select("vec", "label", "c", "anchor").mapInArrow(route, f"vec long, label {label_type}, c array<bigint>, anchor boolean, node long, r double"))
        scratch.drop(rows)
        leaves = self.rows.groupBy("node").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.count_if("anchor").alias("n_anchors"), F.max(F.when(F.col("anchor"), F.col("r"))).alias("r_anchors")).collect()
        self.plan = _Plan(router, leaves)  # of at most MAX_NODES leaves
        chunk = lambda first, count: self._number(first) + F.pmod(F.xxhash64("vec", F.lit(5)), self._number(count))
        self.anchors = scratch.write(self.rows.filter("anchor").select("vec", "label", "c", "node", chunk(self.plan.anchor_first, np.maximum(1, self.plan.anchor_chunks)).alias("asking")))
        self.index = scratch.write(_packed(self.rows.select("vec", "label", "c", chunk(self.plan.first, np.maximum(1, self.plan.chunks)).alias("chunk")), "chunk", LEAF, d, 0))

    @staticmethod
    def _number(values) -> Column:
        """The value of a row's node, from a table of at most ``MAX_NODES`` values."""
        return F.element_at(F.array(*(F.lit(int(x)) for x in values)), (F.col("node") + 1).cast("int")).cast("long")

    def best(self, slots: DataFrame, k: int, same: bool) -> DataFrame:
        """anchor, slot, vec, score: the best ``k`` of each slot (anchor, slot from 0 without gaps, low, high)."""
        found = None
        width = slots.agg(F.max("slot")).first()[0]
        if width is None:
            return slots.select("anchor", "slot", F.col("anchor").alias("vec"), F.col("low").alias("score")).limit(0)
        for wave in range(self.plan.waves()):
            now = slots
            if found is not None:
                bound = found.groupBy("anchor", "slot").agg(F.count("*").alias("have"), F.min("score").alias("kth")).filter(F.col("have") == k)
                now = slots.join(bound.select("anchor", "slot", "kth"), ["anchor", "slot"], "left").withColumn("low", F.greatest("low", F.coalesce("kth", "low")))
            new = self._wave(now, width + 1, k, same, wave)
            both = new if found is None else found.unionByName(new)
            place = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec"))
            old, found = found, self.scratch.write(both.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place"))
            if old is not None:
                self.scratch.drop(old)
        return found

    def _wave(self, slots: DataFrame, width: int, k: int, same: bool, wave: int) -> DataFrame:
        import pandas as pd
        import pyarrow as pa

        plan, d = self.plan, self.d
        # an anchor without some slot has an empty range there
        of = slots.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("low", "high")))).alias("m"))
        ranges = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda s: F.col("m")[s])
        asked = self.anchors.join(of.withColumnRenamed("anchor", "vec"), "vec").withColumn("m", ranges)
        asked = asked.select("vec", "label", "c", "node", "asking", F.transform("m", lambda s: F.coalesce(s["low"], F.lit(1))).alias("low"), F.transform("m", lambda s: F.coalesce(s["high"], F.lit(0))).alias("high"))
        asked = self.scratch.write(asked)
        open_ = F.filter(F.arrays_zip("low", "high"), lambda s: s["low"] <= s["high"])
        need = asked.select("asking", "node", F.array_min(F.transform(open_, lambda s: s["low"])).alias("low"), F.array_max(F.transform(open_, lambda s: s["high"])).alias("high"))
        need = need.groupBy("asking", "node").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <= high")

        def pairs(batches):
            for batch in batches:
                made = [(q, c) for q, node, low, high in zip(*(batch.column(x).to_pylist() for x in ("asking", "node", "low", "high")), strict=True) for c in plan.pairs(node, low, high, wave)]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in made], pa.int64()), pa.array([c for _, c in made], pa.int64())], names=["asking", "chunk"])

        met = self.scratch.write(need.mapInArrow(pairs, "asking long, chunk long"))
        packed = self.scratch.write(_packed(asked.select("vec", "label", "c", "asking", "low", "high"), "asking", ANCHOR_LEAF, d, width))
        index = self.index.select("chunk", *(F.col(x).alias(f"c_{x}") for x in ("kind", "v", "ids", "labels")))
        # each pair is a group of its own, so a worker holds one at a time
        joined = met.join(packed, "asking").join(index, "chunk")

        def score(pair: pd.DataFrame) -> pd.DataFrame:
            import numpy as np

            r = pair.iloc[0]
            anchors, rows = _unpacked(r, d), _unpacked(r, d, "c_")
            x, slot, y, got = meet(anchors, rows, k, same)
            return pd.DataFrame({"anchor": anchors["ids"][x], "slot": slot.astype(np.int32), "vec": rows["ids"][y], "score": got})

        return joined.groupBy("chunk", "asking").applyInPandas(score, "anchor long, slot int, vec long, score long")


def _floor(product: Column) -> Column:
    """A hundredth of a whole decimal, rounded down, as a long."""
    hundred = F.lit(100).cast("decimal(25,0)")
    return ((product - F.pmod(product, hundred)) / hundred).cast("decimal(25,0)").cast("long")


def hard_negatives(
    vectors: DataFrame, anchors: Column, key: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x) and scores are integer inner products, higher first, ties to the smaller key; sums
    beyond 64 bits are held there. Anchors are the rows where ``anchors`` (a condition on ``vectors``) holds, their
    positives the first ``positives`` other rows of their label. For each of them the first ``negatives`` rows of other labels whose
    score lies between ``least`` and ``most`` hundredths of the positive's are returned, ranked from 1, or all if there are
    fewer. A positive without any gives no row; nor does a negative score of a positive, whose range is empty.

    :func:`usable` says which rows take part; keys are whole numbers. Empty tables give an empty result; other columns
    are ignored.
    """
    spark = vectors.sparkSession
    search = Search(vectors, anchors, key, embedding, label, scale, Scratch(spark, "negatives"))
    if search.empty:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    every = search.anchors.select(F.col("vec").alias("anchor"), F.lit(0).alias("slot"), F.lit(-_LONG).alias("low"), F.lit(_LONG).alias("high"))
    found = search.best(every, positives, same=True)
    order = W.partitionBy("anchor").orderBy(F.desc("score"), "vec")
    chosen = search.scratch.write(found.select("anchor", (F.row_number().over(order) - 1).alias("slot"), F.col("vec").alias("positive_id"), F.col("score").alias("positive_score")))
    wide = F.col("positive_score").cast("decimal(20,0)")
    times = lambda n: (wide * F.lit(n).cast("decimal(4,0)")).cast("decimal(25,0)")
    ranges = chosen.select("anchor", "slot", (-_floor(-times(least))).alias("low"), _floor(times(most)).alias("high")).filter("low <= high")
    ranked = search.best(ranges, negatives, same=False)
    rank = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec")).alias("rank")
    ranked = ranked.select("anchor", "slot", rank, F.col("vec").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(ranked, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir):
    """Hard negatives of ``embeddings``: anchors are the rows with a vec_id divisible by 50; every seventh label is shifted."""
    from galley.session import table

    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.c, b.c)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other))::INTEGER AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) <= 3
"""
