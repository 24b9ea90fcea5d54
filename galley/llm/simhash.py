"""SimHash near-duplicate groups, searched with tables of distances to pivots.

A fingerprint bit is set where over half of the XXH64 hashes of a text's word shingles have it. Two
fingerprints link if at most ``RADIUS`` bits differ. Links are looked for among distinct fingerprints:

* ``PIVOTS`` reference fingerprints are fixed by a seed, and the Hamming distances of each fingerprint to all of
  them are computed before any pair is looked at. By the triangle inequality two fingerprints within the
  radius differ by no more than the radius in any of these coordinates, so a pair with a larger difference is
  discarded; survivors are verified on the fingerprints themselves.
* Not all pairs are formed. Bits are cut in ``BANDS`` bands; a pair within the radius agrees in at least
  ``BANDS - RADIUS`` of them, so it meets in a bucket of one of the choices of so many bands. A bucket is
  sorted by its first coordinate, and a fingerprint meets only those within the radius there.

What keeps it bounded:

* A bucket of at most ``BUCKET`` fingerprints is searched at once; it gives a forest of links, at most one row for
  each of its fingerprints.
* Members of a larger bucket first link where all bits agree but those of one window of ``RADIUS`` bits, as all
  fingerprints of such a group lie within the radius of each other: a linear pass joins what is dense. Then
  a bucket inside one component is done. Of another, the largest component and the rest are dealt over blocks
  in order of a coordinate, and pairs of blocks whose ranges are within the radius of each other are searched,
  each by a call of its own, but for those inside the largest component. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.llm.common import Scratch, small_broadcast
from galley.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 3
BANDS = 5
PIVOTS = 24
BUCKET = 1024
#: Bytes of a text that are cut into words at a time.
PART = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACES = b" \t\n\x0b\x0c\r"


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Runs of characters other than ASCII white space, in lists of about ``PART`` bytes."""
    at = 0
    while at < len(data):
        stop = min(at + PART, len(data))
        while stop < len(data) and data[stop] not in _SPACES:
            stop += 1
        yield data[at:stop].split()
        at = stop


@cache
def _bytes():
    """An offset for each of the 8 places of a digest, and the bits of each byte value."""
    import numpy as np

    return np.arange(8)[None, :] * 256, np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned; 0 without words.

    A-Z are in lower case; shingles are ``k`` words joined by a space, each as often as it stands there; a text
    of fewer words is one shingle.
    """
    import numpy as np
    from xxhash import xxh64_digest

    n, ones, held = 0, np.zeros(BITS, np.int64), []
    places, bits = _bytes()

    def add(digests: list[bytes]) -> None:
        nonlocal n, ones
        n += len(digests)
        # how often each byte value stands at each of the 8 places
        values = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
        counts = np.bincount((values + places).ravel(), minlength=2048).reshape(8, 256)
        ones += (counts @ bits).ravel()

    for words in _words((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
        held += words
        if len(held) >= k:
            shifted = [held[i : len(held) - k + 1 + i] for i in range(k)]
            add([xxh64_digest(b" ".join(s), SEED) for s in zip(*shifted, strict=True)])
            held = held[len(held) - k + 1 :] if k > 1 else []
    if n == 0:
        if not held:
            return 0
        add([xxh64_digest(b" ".join(held), SEED)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""
    import pyarrow as pa

    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            found = np.array([fingerprint(t, k) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp long")


def pivots(count: int = PIVOTS, seed: int = 11):
    """The reference fingerprints."""
    import numpy as np

    return np.random.default_rng(seed).integers(0, 2**64, count, dtype=np.uint64)


def distance_table(fp, references):
    """(n, pivots) bytes: the Hamming distances of fingerprints to all references."""
    import numpy as np

    return np.stack([np.bitwise_count(fp ^ r) for r in references], axis=1) if len(references) else np.zeros((len(fp), 0), np.uint8)


def close_pairs(fp, group, references, radius: int = RADIUS, label=None, side=None):
    """Positions (i, j) of the pairs within ``radius`` and in one group, and how many pairs each step left.

    ``group`` is an integer a row. With ``label``, pairs of equal labels are left out; with ``side``
    (booleans), only pairs of unlike sides count. Pairs come from windows of the first coordinate inside a group, are
    discarded by the largest difference of coordinates, and are verified by the fingerprints.
    """
    import numpy as np

    far = distance_table(fp, references)
    first = far[:, 0].astype(np.int64)
    rank = np.unique(group, return_inverse=True)[1]
    place = rank * 128 + first  # distances are at most 64, so groups don't touch
    order = np.argsort(place, kind="stable")
    place, far, own = place[order], far[order], fp[order]
    until = np.searchsorted(place, place + radius, side="right")
    # every row meets the rows behind it up to the end of its window, a bounded number of pairs at a time
    size = until - np.arange(len(fp)) - 1
    total = np.cumsum(size)
    found, left = [], np.zeros(3, np.int64)
    at = 0
    while at < len(fp):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), side="right")))
        n = size[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = stop
        if label is not None:
            keep = label[order[i]] != label[order[j]]
            i, j = i[keep], j[keep]
        if side is not None:
            keep = side[order[i]] != side[order[j]]
            i, j = i[keep], j[keep]
        left[0] += len(i)
        for p in range(1, far.shape[1]):
            if not len(i):
                break
            a, b = far[i, p], far[j, p]
            keep = np.maximum(a, b) - np.minimum(a, b) <= radius
            i, j = i[keep], j[keep]
        left[1] += len(i)
        keep = np.bitwise_count(own[i] ^ own[j]) <= radius
        i, j = i[keep], j[keep]
        left[2] += len(i)
        found.append((order[i], order[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), left
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), left


def forest(n: int, i, j):
    """For each of ``n`` rows the smallest position that it reaches over the pairs (i, j)."""
    import numpy as np

    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _bands(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of each band."""
    edges = [BITS * b // count for b in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def band_masks(radius: int, bands: int = BANDS) -> list[int]:
    """Masks of the bits of each choice of ``bands - radius`` bands: within the radius a pair agrees under one of them."""
    each = [((1 << width) - 1) << first for first, width in _bands(bands)]
    return [_signed(sum(c)) for c in combinations(each, bands - radius)]


def window_masks(radius: int) -> list[int]:
    """Masks that leave out one window of ``radius`` bits each: what agrees under one of them is within the radius."""
    return [_signed((2**64 - 1) & ~(((1 << radius) - 1) << at)) for at in range(0, BITS, radius)] if radius else []


def _masked(rows: DataFrame, masks: list[int]) -> DataFrame:
    """t (number of the mask), key (the fingerprint under it), fp."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(masks)))).alias("m")
    return rows.select("fp", each).select("m.t", "m.key", "fp")


def _searched(buckets: DataFrame, radius: int, count: int) -> DataFrame:
    """Links (u, v) of fingerprints in one bucket (t, key, fp); buckets are small, so a task holds many of them whole."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        references = pivots(count)
        held = None

        def search(t, key, fp):
            turn = np.concatenate([[0], np.cumsum((t[1:] != t[:-1]) | (key[1:] != key[:-1]))])
            i, j, _ = close_pairs(fp.view(np.uint64), turn, references, radius)
            # a group is a bucket, so trees of different buckets stay apart
            root = forest(len(fp), i, j)
            moved = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[root[moved]]), pa.array(fp[moved])], names=["u", "v"])

        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("t", "key", "fp")]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            t, key, _ = held
            open_ = int(np.argmax((t == t[-1]) & (key == key[-1]))) if len(t) else 0  # the last bucket may go on
            if open_:
                yield search(*(x[:open_] for x in held))
                held = [x[open_:] for x in held]
        if held is not None and len(held[0]):
            yield search(*held)

    return buckets.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "u long, v long")


def _distance(seed_reference: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(seed_reference)).cast("long")))


def _blocks(buckets: DataFrame, labels: DataFrame, n_labels: int, radius: int, count: int, size: int, scratch: Scratch) -> DataFrame:
    """Links between different components inside large buckets (t, key, fp)."""
    import pandas as pd

    here = buckets.join(small_broadcast(labels.withColumnRenamed("node", "fp"), n_labels, 32), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    sizes = here.groupBy("t", "key", "label").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("t", "key").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.max("size").alias("n_main"), (F.sum("size") - F.max("size")).alias("n_rest"))
    mixed = scratch.write(mixed.filter("n_rest > 0"))
    half = max(1, size // 2)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / half)).cast("int")
    rows = here.join(small_broadcast(mixed, mixed.count(), 48), ["t", "key"]).withColumn("is_main", F.col("label") == F.col("main"))
    # a block is a range of the first coordinate, cut further by a hash where one distance has many rows
    first = _distance(int(pivots(count)[0]))
    spread = scratch.write(rows.withColumn("far", first))
    counted = spread.groupBy("t", "key", "is_main", "far").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("t", "key", "is_main").orderBy("far").rowsBetween(W.unboundedPreceding, -1))
    counted = scratch.write(counted.withColumn("before", F.coalesce(before, F.lit(0))))
    spread = spread.join(small_broadcast(counted, counted.count(), 40), ["t", "key", "is_main", "far"])
    own = F.floor((F.col("before") + F.pmod(F.xxhash64("fp"), F.col("c"))) / half).cast("int")
    spread = scratch.write(spread.select("t", "key", "fp", "label", "is_main", "far", own.alias("own"), blocks("n_main").alias("blocks_main"), blocks("n_rest").alias("blocks_rest")))
    ranges = spread.groupBy("t", "key", "is_main", "own").agg(F.min("far").alias("least"), F.max("far").alias("most"))
    side = lambda main: ranges.filter(F.col("is_main") == main).groupBy("t", "key").agg(F.collect_list(F.struct("own", "least", "most")).alias("m" if main else "r"))
    ranges = scratch.write(side(True).join(side(False), ["t", "key"]))
    spread = spread.join(small_broadcast(ranges, ranges.count(), 24 * 256), ["t", "key"])
    near = lambda other: (other["own"] >= 0) & (other["least"] <= F.col("far") + radius) & (other["most"] >= F.col("far") - radius)
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    with_rest = F.transform(F.filter("r", near), lambda o: cell("main", F.col("own"), o["own"]))
    with_main = F.transform(F.filter("m", near), lambda o: cell("main", o["own"], F.col("own")))
    among = F.transform(F.filter("r", near), lambda o: cell("rest", F.least(o["own"], F.col("own")), F.greatest(o["own"], F.col("own"))))
    dealt = spread.select("t", "key", "fp", "label", "is_main", "own", F.explode(F.when(F.col("is_main"), with_rest).otherwise(F.concat(with_main, among))).alias("cell"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        fp, label = part["fp"].to_numpy(), part["label"].to_numpy()
        kind, x, y = part["cell"].iloc[0].values() if isinstance(part["cell"].iloc[0], dict) else part["cell"].iloc[0]
        sides = part["is_main"].to_numpy() if kind == "main" else None if x == y else part["own"].to_numpy() == x
        i, j, _ = close_pairs(fp.view(np.uint64), np.zeros(len(fp), np.int64), pivots(count), radius, label, sides)
        root = forest(len(fp), i, j)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"u": fp[root[moved]], "v": fp[moved]})

    return dealt.groupBy("t", "key", "cell").applyInPandas(compare, "u long, v long")


def _relabelled(old: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label over the old labels and further links."""
    edges = links if old is None else links.union(old.select("node", "label"))
    return components(edges.toDF("u", "v"), scratch)


def linked(classes: DataFrame, scratch: Scratch, radius: int = RADIUS, bands: int = BANDS, count: int = PIVOTS, size: int = BUCKET) -> DataFrame | None:
    """node, label of the distinct fingerprints (fp) with a link, the label one of each component; None without links."""
    met = _masked(classes.select("fp"), band_masks(radius, bands))
    sizes = met.groupBy("t", "key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("p1"), F.bit_xor(F.xxhash64("fp", F.lit(2))).alias("p2")).filter("size > 1")
    # of buckets with the same members, one goes on
    sizes = scratch.write(sizes.groupBy("size", "p1", "p2").agg(F.min(F.struct("t", "key")).alias("b")).select("b.t", "b.key", "size"))
    n = sizes.count()
    if not n:
        return None
    met = scratch.write(met.join(small_broadcast(sizes, n, 32), ["t", "key"]))
    links = scratch.write(_searched(met.filter(F.col("size") <= size), radius, count))
    labels = None if links.limit(1).count() == 0 else _relabelled(None, links, scratch)
    large = met.filter(F.col("size") > size).select("t", "key", "fp")
    if sizes.filter(F.col("size") > size).limit(1).count():
        dense = _masked(large.select("fp").distinct(), window_masks(radius))
        star = dense.groupBy("t", "key").agg(F.min("fp").alias("u"), F.count("*").alias("rows")).filter("rows > 1").select("t", "key", "u")
        stars = scratch.write(dense.join(star, ["t", "key"]).filter("u <> fp").select("u", F.col("fp").alias("v")).distinct()) if radius else None
        if stars is not None and stars.limit(1).count():
            labels = _relabelled(labels, stars, scratch)
        known = labels if labels is not None else classes.select(F.col("fp").alias("node"), F.col("fp").alias("label")).limit(0)
        more = scratch.write(_blocks(large, known, known.count(), radius, count, size, scratch))
        if more.limit(1).count():
            labels = _relabelled(labels, more, scratch)
    return labels


def near_groups(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits) and component_id of every row.

    Texts are read whole; null and empty texts, and those of white space, have fingerprint zero, which links
    like any other. component_id is the smallest doc_id reachable over links of at most ``radius`` differing
    bits, the row's own included; rows without a doc_id link others but lend no id, and a component of such rows
    alone has null. Repeated rows stay repeated; an empty table gives an empty result; other columns are
    ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, k))
    classes = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    labels = linked(classes, scratch, radius)
    # only classes of several rows, or of a component of several, say more than a row's own id
    telling = classes.filter("rows > 1").select("fp", F.col("least").alias("component_id"))
    if labels is not None:
        found = scratch.write(labels.withColumnRenamed("node", "fp").join(classes, "fp").select("fp", "label", "least"))
        first = found.groupBy("label").agg(F.min("least").alias("component_id"))
        alone = telling.join(found.select("fp"), "fp", "left_anti")
        telling = alone.unionByName(found.join(first, "label").select("fp", "component_id"))
    telling = scratch.write(telling)
    out = rows.join(small_broadcast(telling, telling.count(), 32), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark, sf_dir):
    """One row per document of ``documents``: fingerprint over 3-word shingles, component at 3 or fewer differing bits."""
    from galley.session import table

    return near_groups(table(spark, sf_dir, "documents"))
