"""Near-duplicate groups by MinHash with tensored banding and exact verification.

A document's set holds 64-bit hashes of its distinct word shingles. Two small collections of ``m`` keys
each, A and B, are computed, a key from ``ROWS`` minhashes. Table (i, j) is keyed by the pair (A_i, B_j):
``m * m`` tables of ``2 * ROWS`` minhashes cost ``2 * m * ROWS`` minhashes in place of ``2 * m * m * ROWS``.
Documents that meet in a table are candidates, and links are confirmed on the full sets.

What keeps it bounded:

* Documents with equal sets form a class; only its smallest doc_id goes on.
* A key of A that one class alone has can't give a table hit, so B is combined only with A keys that
  collide.
* Of buckets with the same members one goes on.
* Only a small bucket yields all its pairs. Members are first compared with one leader, then, where the
  bucket still holds several components, with a few, of its largest component if that has so many. Only
  components matter, so a bucket inside one component is done, as is one whose leaders have been all its
  members but one. The first rounds compare a member with a few leaders only, whatever the number of its buckets, and
  choose them from lists, so that no row is made for each leader of each bucket. Alike texts
  meet in many buckets, so what is left of buckets that share members becomes one bucket, where that leaves fewer rows to
  deal. It is compared in blocks of at most about ``BLOCK`` members, components
  against each other, by an exact count of common shingles in each pair of blocks. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.llm.common import Scratch, numbered, small_broadcast
from galley.llm.components import components

ROWS = 3
#: Chance that a pair exactly at the threshold meets in no key of A (or of B).
MISS = 2e-4
BLOCK = 256
#: Leaders of a bucket, round by round, before blocks are compared; and with how many of all leaders that it meets a member is
#: compared in the first rounds. A later round is for buckets of one member more than leaders, whose pairs it compares all.
LEADERS = (1, 4, 16)
FEW = (1, 4)
SHINGLE = 5
#: Bytes of the longest words whose hash is a polynomial.
LONG = 128
PERCENT = 80

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def collection_size(percent: int) -> int:
    """Keys of each collection for the threshold."""
    p = (percent / 100) ** ROWS
    return 1 if p >= 1 else math.ceil(math.log(MISS) / math.log(1 - p))


class _Tables:
    """Random values of bytes, odd powers by the place in a word, and which bytes are white space."""

    def __init__(self) -> None:
        import numpy as np

        self.value = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.inside = np.ones(256, bool)
        self.inside[[9, 10, 11, 12, 13, 32]] = False
        self.power = self.powers(4096)

    @staticmethod
    def powers(n: int):
        import numpy as np

        p = np.full(n, _ODD[0], np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)


_tables: list[_Tables] = []


def word_hashes(text: str | None):
    """64-bit hashes of the words of a text, in order, A-Z in lower case; all characters at once.

    A word of up to ``LONG`` bytes is a polynomial of random values of its bytes; a longer one goes through XXH3, as patterned
    sequences of a thousand letters meet in any polynomial modulo a power of two. What is left to chance: two
    different words, or shingles, are alike with a chance of about 2 ** -64 a pair.
    """
    import numpy as np

    if not _tables:
        _tables.append(_Tables())
    t = _tables[0]
    chars = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    inside = t.inside[chars]
    if not inside.any():
        return np.empty(0, np.uint64)
    turns = np.empty(len(chars) + 1, bool)
    turns[0], turns[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=turns[1:-1])
    edges = np.flatnonzero(turns)
    size = edges[1::2] - edges[0::2]
    first = np.cumsum(size) - size
    chars = chars[inside]
    place = np.arange(len(chars)) - np.repeat(first, size)
    if (most := int(size.max())) > len(t.power):
        t.power = t.powers(2 * most)
    h = np.add.reduceat(t.value[chars] * t.power[place], first) + size.astype(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(_ODD[1])
    h ^= h >> np.uint64(29)
    if most > LONG:
        import xxhash

        data, last = chars.tobytes(), first + size
        for w in np.flatnonzero(size > LONG):
            h[w] = xxhash.xxh3_64_intdigest(data[first[w] : last[w]], seed=7)
    return h


def shingle_set(text: str | None, k: int):
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; one for a shorter text; none without words."""
    import numpy as np

    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    s = np.full(n, np.uint64(min(len(h), k)))
    for j in range(min(k, len(h))):
        s = (s ^ h[j : j + n]) * np.uint64(_ODD[j % len(_ODD)] + 2 * (j // len(_ODD)))
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def _functions(m: int):
    """Multipliers and addends of linear permutations of 32-bit integers."""
    import numpy as np

    rng = np.random.default_rng(20240229)
    pick = lambda: rng.integers(0, 2**31, size=(2 * m * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return pick(), pick()


def collections_of(s, m: int, functions):
    """The keys of A and B (two int64 arrays of length ``m``) of a non-empty set."""
    import numpy as np

    a, b = functions
    top = (s >> np.uint64(32)).astype(np.uint32)  # half of a hash ranks well enough
    least = np.full(2 * m * ROWS, np.uint32(2**32 - 1))
    held = np.empty((2 * m * ROWS, min(1024, len(top))), np.uint32)
    for at in range(0, len(top), 1024):
        part = top[None, at : at + 1024]
        now = held[:, : part.shape[1]]
        np.multiply(part, a, out=now)
        now += b
        np.minimum(least, now.min(axis=1), out=least)
    key = np.zeros(2 * m, np.uint64)
    for r in range(ROWS):
        key = (key ^ least[r :: ROWS]) * np.uint64(_ODD[r])
        key ^= key >> np.uint64(31)
    return key[:m].view(np.int64), key[m:].view(np.int64)


def signatures(docs: DataFrame, k: int, m: int) -> DataFrame:
    """doc_id, c1, c2 (128-bit digest of the set), n, a, b; digests and keys are null for empty sets."""
    import pyarrow as pa

    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        functions = _functions(m)
        for batch in batches:
            c1, c2, n, a, b = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                if not len(s):
                    for x in (c1, c2, a, b):
                        x.append(None)
                    continue
                digest = xxhash.xxh128_intdigest(s.tobytes())
                c1.append((digest >> 64) - 2**63)
                c2.append((digest & (2**64 - 1)) - 2**63)
                one, two = collections_of(s, m, functions)
                a.append(one)
                b.append(two)
            long, many = pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(c1, long), pa.array(c2, long), pa.array(n, long), pa.array(a, many), pa.array(b, many)], names=["doc_id", "c1", "c2", "n", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, c1 long, c2 long, n long, a array<long>, b array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """rep, n, shingles (packed sorted unsigned 64-bit integers) of each row."""
    import pyarrow as pa

    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, k) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "n", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, f"rep {id_type}, n long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (u, v), those whose sets are similar enough."""
    import pyarrow as pa

    id_type = pairs.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(one) > len(two):
                    one, two = two, one
                at = np.searchsorted(two, one)
                at[at == len(two)] = 0
                common = int((two[at] == one).sum()) if len(two) else 0
                linked.append(common > 0 and 100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(run, f"u {id_type}, v {id_type}")


def _colliding(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` (keys..., rep) whose key more than one class has."""
    many = rows.groupBy(*keys).agg(F.min("rep").alias("_least"), F.max("rep").alias("_most")).filter("_least < _most").select(*keys)
    many = scratch.write(many)  # a table of its own, so that Spark may split a frequent key in the join
    return rows.join(small_broadcast(many, many.count(), 8 * len(keys) + 16), keys)


def _block_count(n: Column | str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """key, main (label of the largest component), n_main, n_rest of the buckets of ``rows`` (key, label)."""
    sizes = rows.groupBy(key, "label").agg(F.count("*").alias("size"))
    return sizes.groupBy(key).agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.max("size").alias("n_main"), (F.sum("size") - F.max("size")).alias("n_rest"))


def _merged(here: DataFrame, mixed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``here`` (key, rep, n, label) and ``mixed`` with buckets that share members as one.

    A bucket goes by the smallest member of any bucket that one of its members is in, and buckets whose such
    members hang together go together; not all that share a member need to. Each set of such buckets is made one only
    if its members then are dealt over blocks in fewer rows than now, bucket by bucket. All pairs of members of a bucket
    stay pairs of a bucket.
    """
    rows_of = F.col("n_main") * _block_count("n_rest") + F.col("n_rest") * (_block_count("n_main") + _block_count("n_rest"))
    bucket, member = W.partitionBy("key"), W.partitionBy("rep")
    rows = here.withColumn("least", F.min("rep").over(bucket)).withColumn("next", F.min("least").over(member))
    rows = scratch.write(rows.withColumn("by", F.min("next").over(bucket)))
    edges = rows.select(F.col("rep").alias("u"), F.col("next").alias("v")).union(rows.select("least", "by")).distinct()
    labels = components(edges, scratch).select(F.col("node").alias("by"), F.col("label").alias("group"))
    keys = scratch.write(rows.select("key", "by").distinct().join(labels, "by", "left").select("key", "by", F.coalesce("group", "by").alias("group")))
    # each set's members, first without the buckets that go by one member, then without those members
    members = scratch.write(rows.select("by", "rep", "n", "label").distinct())
    whole = scratch.write(members.join(keys.select("by", "group").distinct(), "by").select("group", "rep", "n", "label").distinct())
    now = mixed.join(keys, "key").groupBy("group").agg(F.sum(rows_of).alias("now"), F.count("*").alias("buckets"))
    better = _mixed(whole, "group").join(now, "group").filter(F.col("buckets") > 1).filter(rows_of < F.col("now"))
    better = scratch.write(better.select("group", F.xxhash64("group", F.lit("group")).alias("key"), "main", "n_main", "n_rest"))
    n = better.count()
    gone = scratch.write(keys.join(small_broadcast(better.select("group"), n, 24), "group").select("key"))
    gone = small_broadcast(gone, gone.count(), 16)
    apart = rows.join(gone, "key", "left_anti").select("key", "rep", "n", "label")
    joined = whole.join(small_broadcast(better.select("group", "key"), n, 32), "group").select("key", "rep", "n", "label")
    return scratch.write(apart.unionByName(joined)), scratch.write(mixed.join(gone, "key", "left_anti").unionByName(better.drop("group")))


def _blocks(buckets: DataFrame, mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside the buckets of ``mixed`` (key, main, n_main, n_rest).

    The members of the bucket's largest component and the rest are dealt over blocks by a hash. Each
    pair of blocks is compared by one call, except pairs inside the largest component.
    """
    import pandas as pd

    id_type = buckets.schema["rep"].dataType.simpleString()
    rows = buckets.join(mixed, "key").withColumn("is_main", F.col("label") == F.col("main"))
    rows = rows.withColumn("blocks_main", _block_count("n_main")).withColumn("blocks_rest", _block_count("n_rest"))
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.when(F.col("is_main"), F.col("blocks_main")).otherwise(F.col("blocks_rest"))).cast("int")
    rows = rows.withColumn("own", own)
    with_rest = F.transform(F.sequence(F.lit(0), F.col("blocks_rest") - 1), lambda o: F.struct(F.lit(True).alias("main"), F.col("own").alias("x"), o.alias("y")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("blocks_main") - 1), lambda o: F.struct(F.lit(True).alias("main"), o.alias("x"), F.col("own").alias("y")))
    among = F.transform(F.sequence(F.lit(0), F.col("blocks_rest") - 1), lambda o: F.struct(F.lit(False).alias("main"), F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    alone = (F.col("blocks_main") == 1) & (F.col("blocks_rest") == 1)  # one cell holds both, and all pairs
    dealt = rows.select("key", "rep", "label", "is_main", "own", F.explode(F.when(F.col("is_main"), with_rest).when(alone, with_main).otherwise(F.concat(with_main, among))).alias("cell"))
    dealt = dealt.select("key", "rep", "label", "cell", F.when(F.col("cell.main"), F.col("is_main")).otherwise(F.col("own") == F.col("cell.x")).alias("left_side"))
    dealt = dealt.join(sets.select("rep", "n", "shingles"), "rep")

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        held = [np.frombuffer(s, np.uint64) for s in cell["shingles"]]
        n = np.array([len(s) for s in held])
        label = cell["label"].to_numpy()
        rep = cell["rep"].to_numpy()
        _, codes, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(held)), n)
        shared = times[codes] > 1
        codes, owner = codes[shared], owner[shared]
        _, codes = np.unique(codes, return_inverse=True)
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        common = np.zeros((len(held), len(held)), np.float32)
        width = 4096
        for at in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
            a, b = np.searchsorted(codes, [at, at + width])
            has = np.zeros((len(held), width), np.float32)
            has[owner[a:b], codes[a:b] - at] = 1
            common += has @ has.T
        alike = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        u, v = np.nonzero(np.triu(alike & (label[:, None] != label[None, :]), 1))
        links = pd.DataFrame({"u": rep[u], "v": rep[v], "x": label[u], "y": label[v]})
        return links.drop_duplicates(["x", "y"])[["u", "v"]]  # one link joins two components

    return dealt.groupBy("key", "cell").applyInPandas(compare, f"u {id_type}, v {id_type}")


def near_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Words are runs of characters other than ASCII white space, A-Z in lower case. The set holds the
    distinct ``k``-word shingles, or the whole sequence of a shorter text; null and empty texts have an
    empty set and link with nothing. Two documents link if 100 * common >= ``percent`` * union.
    component_id is the smallest doc_id reachable over links, kept whether it is the row's own. Rows that
    share a doc_id are one document. A null doc_id stays alone and kept. An empty table gives an empty
    result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near")
    m = collection_size(percent)
    signed = scratch.write(signatures(docs, k, m))
    sets_of_many = signed.filter("n > 0 and doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    classes = scratch.write(sets_of_many.filter("rows > 1").select("c1", "c2", "rep"))
    classes = small_broadcast(classes, classes.count(), 40)
    member = signed.join(classes, ["c1", "c2"], "left").select("doc_id", "n", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("rep")), "doc_id").alias("rep"), "a", "b")
    member = scratch.write(member)
    scratch.drop(signed)
    reps = member.filter("doc_id = rep and n > 0")
    one = _colliding(reps.select("rep", F.posexplode("a").alias("i", "x")), ["i", "x"], scratch)
    two = one.join(reps.select("rep", "n", "b"), "rep").select("rep", "n", "i", "x", F.posexplode("b").alias("j", "y"))
    tables = scratch.write(two.select("rep", "n", F.xxhash64("i", "x", "j", "y").alias("key")).distinct())
    met = scratch.write(_colliding(tables, ["key"], scratch))
    scratch.drop(tables)
    buckets = scratch.write(_distinct_buckets(met, scratch))
    scratch.drop(met)
    alive = scratch.write(buckets.select("rep").distinct())
    n_alive = alive.count()
    labels = None
    if n_alive:
        texts = docs.select("doc_id", "text").join(small_broadcast(alive.withColumnRenamed("rep", "doc_id"), n_alive, 16), "doc_id", "left_semi")
        sets = scratch.write(shingle_sets(texts, k))
        labels = _link(buckets, sets, alive, n_alive, percent, scratch)
    component = F.col("rep")
    out = member.select("doc_id", "n", "rep")
    if labels is not None:
        out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        component = F.coalesce("label", "rep")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _distinct_buckets(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """One bucket of those with the same members: alike documents meet in many tables."""
    print_of = lambda seed: F.bit_xor(F.xxhash64("rep", F.lit(seed)))
    members = buckets.groupBy("key").agg(print_of(1).alias("p1"), print_of(2).alias("p2"), F.count("*").alias("size"))
    first = scratch.write(members.groupBy("p1", "p2", "size").agg(F.min("key").alias("key")).select("key"))
    return buckets.join(small_broadcast(first, first.count(), 24), "key", "left_semi")


def _link(buckets: DataFrame, sets: DataFrame, alive: DataFrame, n_alive: int, percent: int, scratch: Scratch) -> DataFrame:
    """node, label over the confirmed links of all buckets (key, rep, n).

    Each round first drops the buckets that lie inside one component, or whose members the last round has
    all compared with each other, and only then chooses leaders.
    """
    labels = alive.select(F.col("rep").alias("node"), F.col("rep").alias("label"))
    done = 1  # buckets of so many members have no pair left
    for step in range(len(LEADERS) + 1):
        here = buckets.join(small_broadcast(labels.withColumnRenamed("node", "rep"), n_alive, 32), "rep")
        mixed = scratch.write(_mixed(here, "key").filter(F.col("n_rest") > 0).filter(F.col("n_main") + F.col("n_rest") > done))
        n_mixed = mixed.count()
        if not n_mixed:
            break
        here = scratch.write(here.select("key", "rep", "n", "label").join(small_broadcast(mixed.select("key", "main", (F.col("n_main") + F.col("n_rest")).alias("size")), n_mixed, 40), "key"))
        buckets = here.select("key", "rep", "n")
        if step < len(LEADERS):
            leaders, few = LEADERS[step], FEW[step] if step < len(FEW) else None
            # members of the largest component lead, so that only the rest is compared with them
            rank = [F.col("label") != F.col("main"), F.xxhash64("rep", F.lit(step))] if step else []
            first = F.row_number().over(W.partitionBy("key").orderBy(*rank, "rep"))
            led = here if few else here.filter(F.col("size") <= leaders + 1)
            lead = led.withColumn("_r", first).filter(F.col("_r") <= leaders).groupBy("key").agg(F.collect_list(F.struct("rep", "n", "label")).alias("leaders"))
            lead = scratch.write(lead)
            pairs = _led(led, small_broadcast(lead, n_mixed, 24 + 32 * leaders), few, step, percent)
            if few is None:
                done = leaders + 1
            links = scratch.write(confirm(pairs, sets, percent))
        else:
            links = scratch.write(_blocks(*_merged(here.drop("main", "size"), mixed, scratch), sets, percent))
        if links.limit(1).count() == 0:
            continue
        old = labels
        name = lambda end: old.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        between = links.join(name("u"), "u").join(name("v"), "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
        moved = components(between, scratch).select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = scratch.write(old.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    return labels


def _led(members: DataFrame, lead: DataFrame, few: int | None, step: int, percent: int) -> DataFrame:
    """Pairs (u < v) of ``members`` (key, rep, n, label) and ``lead`` (key, leaders), for each member ``few`` of all its leaders.

    A leader is of another component and of a fitting size. A bucket's leaders are one list, and a member's lists
    become one before any is dealt out, so there are never more rows than members of buckets, or than pairs to compare.
    """
    fits = lambda x: (x["label"] != F.col("label")) & (100 * F.least("n", x["n"]) >= percent * F.greatest("n", x["n"]))
    met = members.join(lead, "key").select(F.col("rep").alias("v"), F.transform(F.filter("leaders", fits), lambda x: x["rep"]).alias("us"))
    met = met.groupBy("v").agg(F.array_distinct(F.flatten(F.collect_list("us"))).alias("us"))
    if few is not None:  # a few leaders a member join most groups
        order = lambda u: F.struct((F.xxhash64(u, F.lit(step)) if step else F.lit(0)).alias("_k"), u.alias("u"))
        met = met.select("v", F.slice(F.array_sort(F.transform("us", order)), 1, few)["u"].alias("us"))
    pairs = met.select("v", F.explode("us").alias("u"))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def deduplicate(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest doc_id, nulls last.

    Rows are told apart by themselves, not by doc_id: of repeated rows, and of similar rows with one
    doc_id or none, one stays. Rows without words all stay, as they link with nothing. All columns come
    back, whatever their names and types; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = numbered(docs, scratch)
    found = near_groups(rows.select(F.col("key").alias("doc_id"), "row.text"), k, percent).select(F.col("doc_id").alias("key"), "component_id")
    found = found.join(rows.select("key", "row.doc_id"), "key")
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")).select("first.key")
    return rows.join(kept, "key", "left_semi").select("row.*")


def query(spark, sf_dir):
    """One row per document of ``documents``: its set of 3-word shingles and its component at a similarity of 0.85."""
    from galley.session import table

    return near_groups(table(spark, sf_dir, "documents"), k=3, percent=85)


#: Exact: all pairs that share a shingle, and the smallest id reachable over links.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, p.y FROM r JOIN p ON r.other = p.x),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
