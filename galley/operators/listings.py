"""Printed code listings against source files.

Blocks are rows (block_id, filename, lines array<string>; a null line is one that the author left out), files
rows (path, filename, content). Lines meet by keys of falling strictness, and only what no key finds is
compared by edit distance, with those lines of the block's file that share a segment with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.operators.snapshots import best_of
from galley.session import settled

FUZZY = 0.9
#: Keys of at most this many bytes in all are broadcast; beyond it their join shuffles.
BROADCAST_BYTES = 8_000_000


def spaced(line: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+", " "))


def bare(line: Column) -> Column:
    """No white space, one kind of quotes."""
    return F.translate(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+", ""), "“”‘’'", "\"\"\"\"\"")


def repaired(line: Column) -> Column:
    """Artefacts of printing undone: notes in the margin, split operators and dunders, string prefixes set apart, ellipses.

    A margin note is Hangul behind the last tab without a sign of code.
    """
    out = F.regexp_replace(F.coalesce(line, F.lit("")), r"\t(?=[^\t]*[가-힣])[^\t{}()\[\];=<>/\\|&^~`@+\-*%!\"'#]*$", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    out = F.regexp_replace(out, r"([=!<>+\-*/])\s+=", "$1=")
    out = F.regexp_replace(F.regexp_replace(out, r"\* \*", "**"), r"([<>]) \1", "$1$1")
    out = F.regexp_replace(out, r"_\s+_(?=\w)|(?<=\w)_\s+_", "__")
    out = F.regexp_replace(F.regexp_replace(out, r"\b([fFrRbB])\s+(?=[\"'])", "$1"), r"^@\s+", "@")
    return F.regexp_replace(F.regexp_replace(out, "…", "..."), r"\.\s\.\s\.", "...")


def repaired_name(name: Column) -> Column:
    """A file name as it was before print set its underscores and dots apart."""
    out = F.regexp_replace(F.regexp_replace(name, "_ _", "__"), r"\s*_\s*", "_")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s*\.\s*", "."), r"\t", ""))


def without_comment(line: Column) -> Column:
    """The line up to a # or // outside quotes; a line that is all comment stays.

    The line is cut in strings, marks and the text between; what stands before the first mark is as long as the
    pieces before it, whatever the length of the line.
    """
    text = F.coalesce(line, F.lit(""))
    masked = F.regexp_replace(text, r"\\.", "__")  # escapes, so that quotes inside strings don't end them
    pieces = F.regexp_extract_all(masked, F.lit(r"\"[^\"]*\"|'[^']*'|#|//|[^\"'#/]+|[\"'/]"), F.lit(0))
    first = F.least(F.nullif(F.array_position(pieces, "#"), F.lit(0)), F.nullif(F.array_position(pieces, "//"), F.lit(0)))
    size = F.aggregate(F.slice(pieces, 1, F.greatest(first - 1, F.lit(0)).cast("int")), F.lit(0), lambda n, x: n + F.length(x))
    before = F.rtrim(F.substring(text, F.lit(1), size))
    return F.when(first.isNull() | (before == ""), F.rtrim(text)).otherwise(before)


def incomplete(line: Column) -> Column:
    """Whether a line opens more brackets than it closes, or ends in an operator, comma, arrow, backslash or a word like 'and'."""
    more = F.lit(0)
    for a, b in ("()", "[]", "{}"):
        more += F.length(F.replace(line, F.lit(b), F.lit(""))) - F.length(F.replace(line, F.lit(a), F.lit("")))
    return (more > 0) | F.rtrim(line).rlike(r"[,\\+\-*/=|&]$|[=\-]>$|\b(?:and|or|not|in|is)$")


def similarity(a: Column, b: Column, least: float = FUZZY) -> Column:
    """1 minus edit distance over the longer length, null under ``least``; the distance stops where it can't reach it."""
    longest = F.greatest(F.length(a), F.length(b))
    allowed = F.floor(longest * round(1 - least, 6) + 1e-9)
    rough = F.abs(F.length(a) - F.length(b)) <= allowed
    distance = F.when(rough, F.levenshtein(a, b))
    return F.when((distance <= allowed) & (longest > 0), 1 - distance / longest)


def _edits(n: Column, least: float) -> Column:
    """The most edits between a string of ``n`` characters and any string that is similar enough, however long that is."""
    return F.floor(n * round((1 - least) / least, 9) + 1e-9).cast("int")


def near_candidates(asked: DataFrame, source: DataFrame, least: float = FUZZY) -> DataFrame:
    """block_id, number, source_number of pairs in one path that may be similar enough: asked (block_id, number, path, spaced), source (path, source_number, spaced).

    A segment index for edit distance. A source line that allows t edits is cut in t + 1 segments of equal length; an edit spoils one
    segment at most, so a line within t edits holds one of them unspoilt, and one such segment i has no more than i edits
    before it, so it stands there at most i places away. Lines therefore meet by equality of path, segment number
    and segment, and no pair is lost; lines too short for an edit have no segment, as they could only be equal.
    """
    if least <= 0.5:
        raise ValueError("the segment index needs least > 0.5, so that each segment has a character")
    size = F.length("spaced")
    cut = lambda n: F.floor(n / (_edits(n, least) + 1)).cast("int")
    rows = source.withColumn("n", size).withColumn("t", _edits(F.col("n"), least)).filter("t > 0").withColumn("s", cut(F.col("n")))
    segments = F.transform(F.sequence(F.lit(0), F.col("t")), lambda i: F.struct(i.alias("i"), F.substring(F.col("spaced"), i * F.col("s") + 1, F.col("s")).alias("part")))
    index = rows.select("path", "source_number", "n", "s", F.inline(segments))
    # lengths that a similar source line may have, and the segments of those lengths
    lengths = F.sequence(F.greatest(F.lit(1), F.col("a") - F.floor(F.col("a") * round(1 - least, 9) + 1e-9)).cast("int"), F.floor(F.col("a") / least + 1e-9).cast("int"))
    shapes = F.array_distinct(F.transform(lengths, lambda n: F.struct(cut(n).alias("s"), _edits(n, least).alias("t"))))
    probes = asked.withColumn("a", size).select("block_id", "number", "path", "spaced", "a", F.inline(shapes)).filter("t > 0")
    probes = probes.groupBy("block_id", "number", "path", "spaced", "a", "s").agg(F.max("t").alias("t"))
    places = F.transform(F.sequence(F.lit(0), F.col("t")), lambda i: F.transform(
        F.sequence(i * F.col("s") - i, i * F.col("s") + i), lambda at: F.when((at >= 0) & (at + F.col("s") <= F.col("a")), F.struct(i.alias("i"), F.substring(F.col("spaced"), at + 1, F.col("s")).alias("part")))))
    places = F.array_distinct(F.filter(F.flatten(places), lambda x: x.isNotNull()))
    probes = probes.select("block_id", "number", "path", "a", "s", F.inline(places))
    met = probes.join(index, ["path", "s", "i", "part"])
    fits = F.abs(F.col("a") - F.col("n")) <= F.floor(F.greatest("a", "n") * round(1 - least, 6) + 1e-9)
    return met.filter(fits).select("block_id", "number", "path", "source_number").distinct()


def near_lines(asked: DataFrame, source: DataFrame, least: float = FUZZY) -> DataFrame:
    """block_id, number, near, score: the most similar line of the path for each asked line that has one, the first on a tie.

    Source lines that read alike are one, at their first place.
    """
    lines = source.join(asked.select("path").distinct(), "path", "left_semi").groupBy("path", "spaced").agg(F.min("source_number").alias("source_number"))
    pairs = near_candidates(asked, lines, least)
    both = pairs.join(lines.withColumnRenamed("spaced", "there"), ["path", "source_number"]).join(asked.select("block_id", "number", "spaced"), ["block_id", "number"])
    scored = both.withColumn("score", similarity(F.col("spaced"), F.col("there"), least)).filter("score is not null")
    return best_of(scored, ["block_id", "number"], [F.desc("score"), F.col("source_number")], 1, "_n").select("block_id", "number", F.col("source_number").alias("near"), "score")


def source_lines(files: DataFrame) -> DataFrame:
    """path, number, line and its keys: spaced, bare, plain (no comment, spaced), plain_bare."""
    rows = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("number", "line"))
    return rows.filter(spaced(F.col("line")) != "").select("path", "number", "line", *_keys(F.col("line")))


def block_lines(blocks: DataFrame) -> DataFrame:
    """block_id, number, line and the keys of printed lines that aren't left out."""
    rows = blocks.select("block_id", F.posexplode("lines").alias("number", "line")).filter(F.col("line").isNotNull())
    rows = rows.withColumn("line", repaired(F.col("line")))
    return rows.filter(spaced(F.col("line")) != "").select("block_id", "number", "line", *_keys(F.col("line")))


def _keys(line: Column) -> list[Column]:
    plain = without_comment(line)
    return [spaced(line).alias("spaced"), bare(line).alias("bare"), spaced(plain).alias("plain"), bare(plain).alias("plain_bare")]


def excluded(path: Column) -> Column:
    """Whether a path lies in a vendored or generated folder."""
    return path.rlike(r"(?:^|/)(?:node_modules|\.git|__pycache__|\.venv|venv|dist|build|\.idea|\.vscode|site-packages)(?:/|$)")


def _few(keys: DataFrame, name: str) -> DataFrame:
    """The distinct values of a text column, broadcast if they are counted to be ``BROADCAST_BYTES`` at most, so that the larger table stays where it is."""
    kept = settled(keys.select(name).distinct())
    size = kept.agg(F.sum(F.octet_length(name) + 40)).first()[0] or 0
    return F.broadcast(kept) if size <= BROADCAST_BYTES else kept


def _most_lines(lines: DataFrame, source: DataFrame, need: DataFrame) -> DataFrame:
    """block_id, path, hits: the file that has most lines of each block, the smaller path on a tie, if ``need`` (block_id, size, need) or more.

    A file with ``need`` of a block's lines lacks at most size - need of them, so it has one of any size - need + 1:
    files are looked for by that many of the block's rarest lines, and counted on all its lines afterwards. Lines that
    most files have are thus no join key of the search, and nothing is left out.
    """
    b = lines.select("block_id", "number", F.col("bare").alias("k")).filter("k <> ''").join(need, "block_id")
    # lines that no block has are no hit of any, so they aren't dealt; they go where they are read if the blocks' lines are few enough to broadcast
    s = settled(source.select("path", F.col("bare").alias("k")).filter("k <> ''").join(_few(b.select("k"), "k"), "k", "left_semi").select("path", "k").distinct())
    often = s.groupBy("k").agg(F.count("*").alias("files"))
    rare = W.partitionBy("block_id").orderBy("files", "k", "number")
    probes = b.join(often, "k", "left").withColumn("files", F.coalesce("files", F.lit(0))).withColumn("place", F.row_number().over(rare))
    probes = probes.filter(F.col("place") <= F.col("size") - F.col("need") + 1).select("block_id", "k")
    met = probes.distinct().join(s, "k").select("block_id", "path").distinct()
    hits = met.join(b, "block_id").join(s, ["path", "k"], "left_semi").groupBy("block_id", "path").agg(F.count("*").alias("hits"), F.min("need").alias("need"))
    return best_of(hits.filter(F.col("hits") >= F.col("need")), ["block_id"], [F.desc("hits"), F.col("path")], 1, "_n").select("block_id", "path", "hits")


def best_files(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """block_id, path, hits: the file that shares most lines with each block, the smaller path on a tie.

    Blocks of up to two lines need all of them, up to five half, longer ones a fifth.
    """
    b = block_lines(blocks)
    size = b.groupBy("block_id").agg(F.count("*").alias("size"))
    need = F.when(F.col("size") <= 2, F.col("size")).when(F.col("size") <= 5, F.ceil(F.col("size") / 2)).otherwise(F.ceil(F.col("size") / 5))
    return _most_lines(b, source_lines(files), size.withColumn("need", need))


def match_blocks(blocks: DataFrame, files: DataFrame, least: float = 0.4) -> DataFrame:
    """block_id, path, how: 'name' where a file name is unique, else 'folder' by the vote of the blocks with
    unique names on the same pages (column ``page``), else 'content'.

    A block of five lines or more that has less than ``least`` of them in its file goes to the file that has most
    of them, if another has more ('again').
    """
    blocks = blocks.withColumn("filename", repaired_name(F.col("filename")))
    named = files.groupBy("filename").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    unique = blocks.join(named.filter("n = 1"), "filename").select("block_id", "page", "path", F.lit("name").alias("how"))
    folder = F.regexp_extract("path", r"^(.*?)[^/]*$", 1)
    near = unique.select(folder.alias("folder"), F.col("page").alias("at")).groupBy("folder", "at").agg(F.count("*").alias("n"))
    votes = near.select("folder", "n", F.explode(F.array(*[F.col("at") + k for k in range(-3, 4)])).alias("page")).groupBy("page", "folder").agg(F.sum("n").alias("n"))
    votes = best_of(votes, ["page"], [F.desc("n"), F.col("folder")], 1, "_n").select("page", "folder")
    rest = blocks.join(unique.select("block_id"), "block_id", "left_anti")
    placed = files.withColumn("folder", folder).select("folder", "filename", "path")
    voted = rest.join(votes, "page").join(placed, ["folder", "filename"]).groupBy("block_id").agg(F.min("path").alias("path"))
    voted = voted.select("block_id", "path", F.lit("folder").alias("how"))
    left = rest.join(voted.select("block_id"), "block_id", "left_anti")
    found = best_files(left, files).select("block_id", "path", F.lit("content").alias("how"))
    first = settled(unique.select("block_id", "path", "how").unionByName(voted).unionByName(found))
    b, s = block_lines(blocks), source_lines(files)
    lines = b.select("block_id", "number", F.col("bare").alias("k")).filter("k <> ''").join(first, "block_id")
    mine = source_lines(_chosen(files, first)).select("path", F.col("bare").alias("k"))
    kept = lines.join(mine, ["path", "k"], "left_semi").groupBy("block_id").agg(F.count("*").alias("hits"))
    rates = first.join(b.groupBy("block_id").agg(F.count("*").alias("size")), "block_id").join(kept, "block_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    poor = rates.filter((F.col("size") >= 5) & (F.col("hits") < least * F.col("size"))).select("block_id", "size", (F.col("hits") + 1).alias("need"))
    better = _most_lines(b, s, settled(poor)).select("block_id", F.col("path").alias("_p"))
    return first.join(better, "block_id", "left").select("block_id", F.coalesce("_p", "path").alias("path"), F.when(F.col("_p").isNotNull(), "again").otherwise(F.col("how")).alias("how"))


def _chosen(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """The files that some block is held against; the others' lines are neither cut nor dealt."""
    return files.join(_few(chosen.select("path"), "path"), "path", "left_semi")


STAGES = (("exact", "spaced"), ("bare", "bare"), ("plain", "plain"), ("plain_bare", "plain_bare"))


def compare_lines(blocks: DataFrame, files: DataFrame, chosen: DataFrame) -> DataFrame:
    """block_id, number, line, stage, source_number: how each printed line is found in the block's file.

    Stages: exact (single spaces), bare, plain (no comment), plain_bare, near (edit distance), diff. All keys of a
    line meet those of the file in one join, and the strictest hit stays.
    """
    lines = block_lines(blocks).join(chosen.select("block_id", "path"), "block_id")
    source = source_lines(_chosen(files, chosen))
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("stage"), F.col(k).alias("k")) for i, (_, k) in enumerate(STAGES)])).alias("x")
    there = source.select("path", F.col("number").alias("source_number"), keys).select("path", "source_number", "x.*").filter("k <> ''")
    there = there.groupBy("path", "stage", "k").agg(F.min("source_number").alias("source_number"))
    asked = lines.select("block_id", "number", "path", keys).select("block_id", "number", "path", "x.*")
    hits = asked.join(there, ["path", "stage", "k"]).groupBy("block_id", "number").agg(F.min(F.struct("stage", "source_number")).alias("hit"))
    rows = lines.join(hits, ["block_id", "number"], "left")
    asked = settled(rows.filter("hit is null").select("block_id", "number", "path", "spaced"))
    close = near_lines(asked, source.select("path", F.col("number").alias("source_number"), "spaced")).drop("score")
    rows = rows.join(close, ["block_id", "number"], "left")
    stage = F.when(F.col("hit").isNotNull(), F.element_at(F.array(*[F.lit(n) for n, _ in STAGES]), F.col("hit.stage") + 1)).when(F.col("near").isNotNull(), "near").otherwise("diff")
    return rows.select("block_id", "number", "line", stage.alias("stage"), F.coalesce("hit.source_number", "near").alias("source_number"))


def coverage(blocks: DataFrame, files: DataFrame, chosen: DataFrame) -> DataFrame:
    """block_id, total, covered, omitted, missing, percent: the source lines that stand in print.

    With lines left out, those that aren't printed count as omitted on purpose, up to the lines in excess of print.
    """
    printed = block_lines(blocks)
    source = source_lines(_chosen(files, chosen)).join(chosen.select("block_id", "path"), "path")
    known = printed.select("block_id", F.explode(F.array("spaced", "bare", "plain", "plain_bare")).alias("k")).filter("k <> ''").distinct()
    keys = source.select("block_id", "number", F.explode(F.array("spaced", "bare", "plain", "plain_bare")).alias("k"))
    hit = keys.join(known, ["block_id", "k"]).select("block_id", "number").distinct().groupBy("block_id").agg(F.count("*").alias("covered"))
    total = source.groupBy("block_id").agg(F.count("*").alias("total"))
    size = printed.groupBy("block_id").agg(F.count("*").alias("size"))
    gaps = blocks.select("block_id", F.exists("lines", lambda x: x.isNull()).alias("gaps"))
    rows = total.join(hit, "block_id", "left").join(size, "block_id").join(gaps, "block_id").withColumn("covered", F.coalesce("covered", F.lit(0)))
    absent = F.col("total") - F.col("covered")
    omitted = F.when(F.col("gaps"), F.greatest(F.least(absent, F.col("total") - F.col("size")), F.lit(0))).otherwise(F.lit(0))
    rows = rows.withColumn("omitted", omitted.cast("long")).withColumn("missing", F.when(F.col("gaps"), F.lit(0)).otherwise(absent).cast("long"))
    return rows.select("block_id", "total", "covered", "omitted", "missing", (F.col("covered") * 100 / F.nullif(F.col("total") - F.col("omitted"), F.lit(0))).alias("percent"))


def totals(lines: DataFrame) -> DataFrame:
    """block_id, lines, same, near, diff, clean."""
    n = lambda *s: F.count_if(F.col("stage").isin(*s))
    sums = lines.groupBy("block_id").agg(F.count("*").alias("lines"), (F.count("*") - n("near", "diff")).alias("same"), n("near").alias("near"), n("diff").alias("diff"))
    return sums.withColumn("clean", (F.col("near") == 0) & (F.col("diff") == 0))


def absent_files(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """File names that blocks refer to and no file has."""
    return blocks.select("filename").distinct().join(files.select("filename").distinct(), "filename", "left_anti")


def segmented(lines: DataFrame) -> DataFrame:
    """Printed lines (doc_id, page, pos, number, text) as blocks: block_id, doc_id, filename, page, lines.

    A block begins at a label of a file name, where the line number falls by more than five, where it falls after a gap
    of three lines or more, or where it starts over (two at most) after any gap. Numbers that skip leave a null line. One pass over each document's lines in order; the running number of breaks
    is a window sum.
    """
    w = W.partitionBy("doc_id").orderBy("page", "pos")
    label = F.nullif(F.regexp_extract("text", r"^\s*(?:\[?파일\]?\s*)?([\w./-]+\.\w{1,5})\s*$", 1), F.lit(""))
    rows = lines.withColumn("label", F.when(F.col("number").isNull(), label)).filter("label is not null or number is not null")
    before = F.lag("number").over(w)
    gap = F.when(F.lag("page").over(w) == F.col("page"), F.col("pos") - F.lag("pos").over(w) - 1).otherwise(1)  # a new page is a gap
    fall = before - F.col("number")
    starts = F.col("label").isNotNull() | before.isNull() | (fall > 5) | ((fall >= 0) & (gap >= 3)) | ((fall >= 0) & (F.col("number") <= 2) & (gap >= 1))
    rows = rows.withColumn("_s", F.when(starts, 1).otherwise(0)).withColumn("_gap", F.coalesce(F.col("number") - before > 1, F.lit(False)))
    rows = rows.withColumn("block", F.sum("_s").over(w)).withColumn("filename", F.last("label", True).over(w))
    item = F.struct("page", "pos", F.when(F.col("_gap") & (F.col("_s") == 0), F.array(F.lit(None).cast("string"), F.col("text"))).otherwise(F.array("text")).alias("t"))
    out = rows.filter("number is not null").groupBy("doc_id", "block", "filename").agg(F.min("page").alias("page"), F.array_sort(F.collect_list(item)).alias("items"))
    return out.select(F.concat_ws(":", "doc_id", "block").alias("block_id"), "doc_id", "filename", "page", F.flatten(F.col("items.t")).alias("lines"))


def filtered(blocks: DataFrame, state: str | None = None, text: str | None = None) -> DataFrame:
    """Blocks (block_id, filename, clean) of a state, 'diff' or 'clean', whose file name contains ``text``."""
    out = blocks if state is None else blocks.filter(F.col("clean") if state == "clean" else ~F.col("clean"))
    return out.filter(F.contains(F.lower("filename"), F.lit(text.lower()))) if text else out
