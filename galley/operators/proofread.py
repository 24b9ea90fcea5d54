"""Proofreading: pages (doc_id, page, text) scanned by rule tables, checks of style and terms, issue tables.

Rules are rows (pattern, type, severity, suggestion) that a caller gives; up to some hundreds are inlined as
expressions, so that one pass over the pages applies them all in the JVM. Issues are rows (doc_id, page,
type, severity, found, suggestion). Each check skips pages shorter than its own least length.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.functions import fixed
from galley.operators.snapshots import best_of

Rule = tuple[str, str, str, str]
SHORTEST = 20
LONGEST_FOUND = 60
SEVERITIES = ("high", "medium", "low")
REPEATED_WORD = r"([가-힣]{3,})[ \t]*\1"
# Sentence ends in Korean texts, and particles of one form that a sentence should not repeat.
SENTENCE_END = r"(?<=[.!?다요죠함됨음임까나지세네군걸])\s+"
PARTICLES = {"은": r"[가-힣]+은(?=\s)", "는": r"[가-힣]+는(?=\s)", "이": r"[가-힣]+이(?=\s)", "가": r"[가-힣]+가(?=\s)", "을": r"[가-힣]+을(?=\s)", "를": r"[가-힣]+를(?=\s)", "에서": r"[가-힣]+에서(?=\s)", "으로": r"[가-힣]+으로(?=\s)"}
# What the colours of a speller's marks mean.
SPELLER_COLOURS = {"red": "맞춤법 오류", "green": "띄어쓰기 오류", "blue": "표준어 의심/대치어", "violet": "통계적 교정"}
# Fixed value: stacked particles.
STACKED = r"에서의|에의|로의|에게의|에게서의|로부터의|과의|와의|로서의|에\s*관해서의|을\s*통해서의|에\s*따라서의|사이에서의"
# Endings of the three styles of Korean prose.
STYLES = {
    "formal": r"(?:합니다|됩니다|습니다|겠습니다|있습니다|됩니까|습니까)[.?!\s]",
    "plain": r"(?:한다|된다|있다|없다|이다|였다|했다|겠다|아니다)[.?!\s]",
    "polite": r"(?:해요|돼요|있어요|없어요|인가요|할까요|하세요|되세요)[.?!\s]",
}


def scan(pages: DataFrame, rules: Sequence[Rule], shortest: int = SHORTEST) -> DataFrame:
    """An issue for every match of every rule, with rule (its number) and place (among the rule's matches of a page).

    Matches of a rule don't overlap, from left to right; found is cut to 60 characters.
    """
    rows = pages.filter(F.length("text") >= shortest)
    hits = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(a).alias("suggestion"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("all")) for i, (p, t, s, a) in enumerate(rules)])
    out = rows.select("doc_id", "page", F.explode(F.filter(hits, lambda h: F.size(h["all"]) > 0)).alias("h"))
    out = out.select("doc_id", "page", "h.rule", "h.type", "h.severity", "h.suggestion", F.posexplode("h.all").alias("place", "found"))
    return out.withColumn("found", F.substring("found", 1, LONGEST_FOUND))


def repeated_words(pages: DataFrame, pattern: str = REPEATED_WORD) -> DataFrame:
    """Words that stand twice in a row."""
    return scan(pages, [(pattern, "repeat", "medium", "")])


def particle_repeats(pages: DataFrame, particles: Mapping[str, str] = PARTICLES, least: int = 3, sentence_end: str = SENTENCE_END, shortest: int = 15) -> DataFrame:
    """doc_id, page, sentence, particle, n: sentences in which one form stands ``least`` times or more."""
    sentences = pages.select("doc_id", "page", F.explode(F.split("text", sentence_end)).alias("sentence")).filter(F.length("sentence") >= shortest)
    counts = F.array(*[F.struct(F.lit(k).alias("particle"), F.regexp_count("sentence", F.lit(p)).alias("n")) for k, p in particles.items()])
    return sentences.select("doc_id", "page", F.substring("sentence", 1, 120).alias("sentence"), F.inline(F.filter(counts, lambda c: c["n"] >= least)))


def stacked_particles(pages: DataFrame, pattern: str = STACKED, least: int = 2, sentence_end: str = SENTENCE_END, shortest: int = 15) -> DataFrame:
    """doc_id, page, sentence, n: sentences with ``least`` stacked particles or more."""
    sentences = pages.select("doc_id", "page", F.explode(F.split("text", sentence_end)).alias("sentence")).filter(F.length("sentence") >= shortest)
    n = F.regexp_count("sentence", F.lit(pattern)).cast("long")
    return sentences.select("doc_id", "page", F.substring("sentence", 1, 120).alias("sentence"), n.alias("n")).filter(F.col("n") >= least)


def style_counts(pages: DataFrame, styles: Mapping[str, str] = STYLES, shortest: int = 50) -> DataFrame:
    """doc_id, page and the number of endings of each style, for pages long enough."""
    return pages.filter(F.length("text") >= shortest).select("doc_id", "page", *[F.regexp_count("text", F.lit(p)).cast("long").alias(k) for k, p in styles.items()])


def mixed_styles(counts: DataFrame, n_pages: DataFrame | None = None, styles: Sequence[str] = tuple(STYLES), least: int = 10, share: float = 0.8) -> DataFrame:
    """doc_id, main, percent of documents whose main style has less than ``share`` of at least ``least`` endings.

    The main style is the commonest, the first named on a tie. The percent is rounded, half up, and compared so.
    """
    sums = counts.groupBy("doc_id").agg(*[F.sum(s).alias(s) for s in styles])
    total = reduce(lambda a, b: a + b, [F.col(s) for s in styles])
    best = F.greatest(*[F.col(s) for s in styles])
    main = F.coalesce(*[F.when(F.col(s) == best, F.lit(s)) for s in styles])
    rows = sums.withColumn("total", total).withColumn("main", main).withColumn("percent", F.floor(best * 100 / total + 0.5))
    return rows.filter((F.col("total") >= least) & (F.col("percent") < round(share * 100))).select("doc_id", "main", "percent", "total")


def outlier_pages(counts: DataFrame, mixed: DataFrame, styles: Sequence[str] = tuple(STYLES), least: int = 3) -> DataFrame:
    """doc_id, page, dominant of pages of mixed documents where the main style has under 40 percent of the endings."""
    total = reduce(lambda a, b: a + b, [F.col(s) for s in styles])
    best = F.greatest(*[F.col(s) for s in styles])
    dominant = F.coalesce(*[F.when(F.col(s) == best, F.lit(s)) for s in styles])
    rows = counts.join(mixed.select("doc_id", "main"), "doc_id")
    of_main = F.coalesce(*[F.when(F.col("main") == s, F.col(s)) for s in styles])
    return rows.filter((total >= least) & (dominant != F.col("main")) & (of_main * 10 < total * 4)).select("doc_id", "page", dominant.alias("dominant"))


def both_counts(pages: DataFrame, first: str, second: str, least: int = 5) -> DataFrame:
    """doc_id, first, second of documents in which both patterns stand ``least`` times or more (persons)."""
    rows = pages.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(first))).alias("first"), F.sum(F.regexp_count("text", F.lit(second))).alias("second"))
    return rows.filter((F.col("first") >= least) & (F.col("second") >= least))


def term_variants(pages: DataFrame, common: Sequence[str] = (), token: str = r"[A-Za-z][A-Za-z0-9]+", least: int = 4) -> DataFrame:
    """doc_id, variant, n, canonical: spellings of a term that differ only in case and are far rarer than another.

    A term counts with both an upper- and a lower-case first letter among its variants and ``least`` uses in all. The
    canonical spelling is the commonest (the smaller on a tie); a variant is listed where the canonical one has at
    least twice its uses.
    """
    words = pages.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(token), F.lit(0))).alias("variant"))
    if common:
        words = words.filter(~F.lower("variant").isin(*common))
    # a term follows from its spelling, so it needn't be dealt along with it
    counts = words.groupBy("doc_id", "variant").agg(F.count("*").alias("n"))
    # the spellings of one term in one document are few, so they come along in a list, from which all else follows
    group = counts.groupBy("doc_id", F.lower("variant").alias("term")).agg(F.collect_list(F.struct("variant", "n")).alias("all")).filter(F.size("all") > 1)
    upper = lambda x: F.substring(x["variant"], 1, 1) != F.lower(F.substring(x["variant"], 1, 1))
    total = F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    group = group.filter(F.exists("all", upper) & F.exists("all", lambda x: ~upper(x)) & (total >= least))
    best = F.array_min(F.transform("all", lambda x: F.named_struct(F.lit("less"), -x["n"], F.lit("variant"), x["variant"])))
    group = group.select("doc_id", best.alias("best"), F.inline("all"))
    rows = group.filter((F.col("variant") != F.col("best.variant")) & (-F.col("best.less") >= 2 * F.col("n")))
    return rows.select("doc_id", "variant", "n", F.col("best.variant").alias("canonical"))


def repeating_lines(pages: DataFrame, share: float = 0.6, shortest: int = 2, longest: int = 80, least_pages: int = 3) -> DataFrame:
    """doc_id, line, n: first and last lines that stand on ``share`` of a document's pages or more."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.select("doc_id", "page", lines.alias("lines"))
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    ends = rows.filter(F.size("lines") > 0).select("doc_id", F.explode(F.array_distinct(F.array(F.element_at("lines", 1), F.element_at("lines", -1)))).alias("line"))
    counts = ends.filter(F.length("line").between(shortest, longest)).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    return counts.join(sizes, "doc_id").filter(F.col("n") >= F.floor(F.col("pages") * share)).select("doc_id", "line", "n")


def without_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """``pages`` without the repeating lines of their documents. The lines of a document are few by construction."""
    held = lines.groupBy("doc_id").agg(F.collect_set("line").alias("_drop"))
    rows = pages.join(held, "doc_id", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_drop", F.trim(x))), "\n")
    return rows.withColumn("text", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(kept)).drop("_drop")


def repeating_regions(lines: DataFrame, band: float = 0.12, share: float = 0.6, least_pages: int = 4, shortest: int = 2, longest: int = 120) -> DataFrame:
    """doc_id, side ('top' or 'bottom'), region, n: the text of a page's upper or lower band, where most pages have it.

    ``lines`` has doc_id, page, y (growing upwards) and text. A band is that share of the page's height between its
    first and last line; its lines, from above, are joined by bars. A region counts from ``share`` of a document's
    pages, ``least_pages`` at least, rounded down.
    """
    w = W.partitionBy("doc_id", "page")
    top, low = F.max("y").over(w), F.min("y").over(w)
    rows = lines.withColumn("_edge", F.when(top > low, top - low).otherwise(F.lit(1)) * band).withColumn("_top", top).withColumn("_low", low)
    sides = F.array_compact(F.array(F.when(F.col("y") > F.col("_top") - F.col("_edge"), "top"), F.when(F.col("y") < F.col("_low") + F.col("_edge"), "bottom")))
    rows = rows.select("doc_id", "page", "y", F.trim("text").alias("text"), F.explode(sides).alias("side")).filter("text <> ''")
    bands = rows.groupBy("doc_id", "page", "side").agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "text"))).alias("x"))
    bands = bands.select("doc_id", "side", F.array_join("x.text", "|").alias("region")).filter(F.length("region").between(shortest, longest))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= least_pages)
    counts = bands.groupBy("doc_id", "side", "region").agg(F.count("*").alias("n"))
    return counts.join(pages, "doc_id").filter(F.col("n") >= F.floor(F.col("pages") * share)).select("doc_id", "side", "region", "n")


def without_regions(pages: DataFrame, regions: DataFrame, reach: int = 3) -> DataFrame:
    """``pages`` (doc_id, page, text) without the lines of repeating regions among the first or last ``reach`` lines.

    The regions of a document are few by construction: each stands on most of its pages.
    """
    of = lambda side: F.flatten(F.collect_list(F.when(F.col("side") == side, F.split("region", r"\|"))))
    held = regions.groupBy("doc_id").agg(of("top").alias("_first"), of("bottom").alias("_last"))
    rows = pages.join(held, "doc_id", "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~((F.array_contains("_first", F.trim(x)) & (i < reach)) | (F.array_contains("_last", F.trim(x)) & (i >= F.size(lines) - reach))))
    return rows.withColumn("text", F.when(F.col("_first").isNull(), F.col("text")).otherwise(F.trim(F.array_join(kept, "\n")))).drop("_first", "_last")


def dictionary_hits(pages: DataFrame, wrong: Mapping[str, str], longest_tail: int = 1) -> DataFrame:
    """doc_id, page, found, suggestion: wrong forms in the text, once a form and page.

    No Hangul may stand before a form, and at most ``longest_tail`` syllables after it (one more for forms of five and
    up). Thousands of forms are one automaton that each Python worker builds once.
    """
    import pyarrow as pa

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("doc_id", "page")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for form in wrong:
            machine.add_word(form, form)
        if wrong:
            machine.make_automaton()
        hangul = lambda c: "가" <= c <= "힣"
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                seen: dict[str, None] = {}
                for end, form in machine.iter(text or "") if wrong else ():
                    start, tail = end - len(form) + 1, 0
                    while tail < 3 and end + 1 + tail < len(text) and hangul(text[end + 1 + tail]):
                        tail += 1
                    if not (start and hangul(text[start - 1])) and tail <= longest_tail + (len(form) >= 5):
                        seen.setdefault(form)
                at += [i] * len(seen)
                found += seen
            rows = batch.select(["doc_id", "page"]).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string()), pa.array([wrong[f] for f in found], pa.string())], names=["doc_id", "page", "found", "suggestion"])

    return pages.select("doc_id", "page", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, found string, suggestion string")


def context(text: Column, found: Column) -> Column:
    """struct<before, target, after>: 15, 30 or 50 characters around the first match, more for longer ones."""
    at, size = F.instr(text, found), F.length(found)
    wide = F.when(size <= 10, 50).when(size <= 30, 30).otherwise(15)
    start = F.greatest(at - wide, F.lit(1))
    return F.when(at > 0, F.struct(F.substring(text, start, at - start).alias("before"), found.alias("target"), F.substring(text, at + size, wide).alias("after")))


def cross_deduplicated(surface: DataFrame, model: DataFrame, types: Sequence[str]) -> DataFrame:
    """Both issue tables together; of the crossing ``types``, a surface issue that the model's has too goes."""
    key = [F.col("page"), F.trim("found")]
    known = model.filter(F.col("type").isin(*types)).select("doc_id", key[0].alias("_p"), key[1].alias("_f")).distinct()
    crossing = surface.withColumns({"_p": key[0], "_f": F.when(F.col("type").isin(*types), key[1])})
    return crossing.join(known, ["doc_id", "_p", "_f"], "left_anti").drop("_p", "_f").unionByName(model, allowMissingColumns=True)


def severity_rank() -> Column:
    return F.coalesce(*[F.when(F.col("severity") == s, i) for i, s in enumerate(SEVERITIES)], F.lit(9))


def in_order(issues: DataFrame) -> DataFrame:
    """By document, page, severity (high first) and finding."""
    return issues.orderBy("doc_id", "page", severity_rank(), "type", "found")


def filtered(issues: DataFrame, severity: str | None = None, types: Sequence[str] | None = None, text: str | None = None, resolved: bool | None = None) -> DataFrame:
    """Issues of a severity, and of ``types``; a text search holds only where no types are given.

    ``resolved`` takes those that a column of that name says are (null: not), or aren't.
    """
    out = issues if severity is None else issues.filter(F.col("severity") == severity)
    if resolved is not None:
        out = out.filter(F.coalesce("resolved", F.lit(False)) == resolved)
    if types is not None:
        return out.filter(F.col("type").isin(*types))
    return out.filter(F.contains(F.lower(F.concat_ws(" ", "found", "suggestion")), F.lit(text.lower()))) if text else out


def corrected(texts: DataFrame, corrections: DataFrame, before: str = "", after: str = "") -> DataFrame:
    """``texts`` (doc_id, text) with each document's corrections (doc_id, found, suggestion), the longest first."""
    longest = F.array_sort(F.collect_list(F.struct((-F.length("found")).alias("n"), "found", "suggestion")))
    held = corrections.filter(F.length("found") > 0).groupBy("doc_id").agg(longest.alias("_c"))
    rows = texts.join(held, "doc_id", "left")
    put = F.aggregate("_c", F.col("text"), lambda t, c: F.replace(t, c["found"], F.concat(F.lit(before), c["suggestion"], F.lit(after))))
    return rows.withColumn("text", F.coalesce(put, F.col("text"))).drop("_c")


def same_suggestion(found: Column, suggestion: Column) -> Column:
    """Whether a suggestion says what the finding says, white space, quotes and marks aside, in any case.

    They are equal; or one holds the other and is at most 15 percent longer; or their edit distance is at most a
    tenth of the longer; texts of over 200 characters are compared by trigrams, of which they share nine tenths.
    An empty one says nothing, so it is never the same.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s\u00A0.,!?·…。、()\[\]「」『』“”‘’\"']", ""))
    a, b = bare(found), bare(suggestion)
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    inside = (F.contains(a, b) | F.contains(b, a)) & (longer * 100 <= shorter * 115)
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    common = F.size(F.array_intersect(grams(a), grams(b)))
    alike = F.when(longer > 200, common * 10 >= F.greatest(F.size(grams(a)), F.size(grams(b))) * 9).otherwise(F.levenshtein(a, b) * 10 <= longer)
    return F.coalesce((a != "") & (b != "") & ((a == b) | inside | alike), F.lit(False))


def valid_findings(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """``issues`` whose finding stands in its page (doc_id, page, text) and whose suggestion says something else."""
    texts = pages.select("doc_id", "page", F.col("text").alias("_text"))
    rows = issues.join(texts, ["doc_id", "page"]).filter((F.length("found") > 0) & F.contains("_text", F.col("found")))
    return rows.filter(~same_suggestion(F.col("found"), F.coalesce("suggestion", F.lit("")))).drop("_text")


def passive_alternatives(found: Column) -> Column:
    """struct<passive, active> of what may stand for a double passive, null for other texts. The first form in it decides."""
    ways = [F.when(found.rlike(p), F.struct(F.regexp_replace(found, p, one).alias("passive"), F.regexp_replace(found, p, two).alias("active"))) for p, one, two in fixed.PASSIVES]
    return F.coalesce(*ways)


def clean_suggestion(type_: Column, found: Column, suggestion: Column) -> Column:
    """What can be put in the place of a finding, '' where a suggestion only says what to do.

    In order: the text in quotes behind an arrow; the word that all are to be made; nothing for deletions and short
    directions; the word before a bracket; a short word as it is; else the suggestion without its mark of an error, for
    missing content and wrong facts cut to the first sentence where it is over three times as long as the finding.
    """
    s = F.trim(F.coalesce(suggestion, F.lit("")))
    part = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    before = F.trim(part(r"^([^(（]+?)\s*[(（]"))
    plain = F.regexp_replace(s, r"(?i)^\[오류\]\s*", "")
    most = F.greatest(F.length(F.coalesce(found, F.lit(""))) * 3, F.lit(100))
    sentence = F.nullif(F.regexp_extract(plain, r"^(.{20,}?[.다])\s", 1), F.lit(""))
    long = F.coalesce(type_.isin("내용보완필요", "사실오류"), F.lit(False)) & (F.length(plain) > most)
    return (
        F.when(s == "", "")
        .when(part(r'^→\s*"([^"]+)"').isNotNull(), part(r'^→\s*"([^"]+)"'))
        .when(part(r"^'([^']+)'으로 통일").isNotNull(), part(r"^'([^']+)'으로 통일"))
        .when(s.rlike(r"삭제\s*(?:또는|혹은)") | (s.rlike("시키세요|하세요|필요|확인") & (F.length(s) < 30)) | s.rlike("^다중조사"), "")
        .when(before.isNotNull() & (F.length(before) < 20), before)
        .when((F.length(s) <= 10) & ~s.rlike("[.!?,;]"), s)
        .when(long, F.coalesce(sentence, F.substring(plain, F.lit(1), most)))
        .otherwise(plain)
    )


def estimated_tokens(text: Column) -> Column:
    """Hangul by 1.5, ASCII by 4, others by 2 characters a token, rounded up."""
    hangul, plain = F.regexp_count(text, F.lit(r"[가-힣]")), F.regexp_count(text, F.lit(r"[\x00-\x7F]"))
    return F.ceil(hangul / 1.5 + plain / 4 + (F.length(text) - hangul - plain) / 2)


def compressed(text: Column) -> Column:
    """Tabs and wide spaces as spaces, runs of spaces and of blank lines cut, rules of signs shortened."""
    out = F.regexp_replace(F.regexp_replace(text, r"[\t　]", " "), r" {2,}", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"([-=_*])\1{3,}", "$1$1$1"), r"\n{3,}", "\n\n"))


def sampled(pages: DataFrame, parts: int = 8, words: int = 80, shortest: int = 50) -> DataFrame:
    """doc_id, page, words: every n-th long enough page of a document, n its pages over ``parts``, cut to 80 words."""
    rows = pages.filter(F.length("text") >= shortest)
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy("doc_id").orderBy("page"))).withColumn("_n", F.count("*").over(W.partitionBy("doc_id")))
    step = F.greatest(F.floor(F.col("_n") / parts), F.lit(1))
    return rows.filter((F.col("_k") - 1) % step == 0).select("doc_id", "page", F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, words), " ").alias("words"))


def batches(pages: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, batch, page, text, before: pages in batches, the first of each with the page before it."""
    w = W.partitionBy("doc_id").orderBy("page")
    rows = pages.withColumn("_k", F.row_number().over(w) - 1).withColumn("_b", F.lag("text").over(w))
    return rows.select("doc_id", F.floor(F.col("_k") / size).alias("batch"), "page", "text", F.when(F.col("_k") % size == 0, F.col("_b")).alias("before"))


def picked_evenly(pages: DataFrame) -> DataFrame:
    """The first two, middle two and last two pages of each document."""
    rows = pages.withColumn("_k", F.row_number().over(W.partitionBy("doc_id").orderBy("page")) - 1).withColumn("_n", F.count("*").over(W.partitionBy("doc_id")))
    middle = F.floor(F.col("_n") / 2)
    return rows.filter((F.col("_k") < 2) | (F.col("_k") == middle) | (F.col("_k") == middle - 1) | (F.col("_k") >= F.col("_n") - 2)).drop("_k", "_n")


def rule_chunks(markdown: DataFrame) -> DataFrame:
    """doc_id, chunk, heading, body of a rules text cut at headings of levels two and three."""
    parts = F.split(F.concat(F.lit("\n"), F.col("text")), r"\n(?=#{2,3} )")
    rows = markdown.select("doc_id", F.posexplode(parts).alias("chunk", "raw")).filter(F.col("raw").rlike(r"^#{2,3} "))
    return rows.select("doc_id", "chunk", F.trim(F.regexp_extract("raw", r"^#{2,3} +([^\n]*)", 1)).alias("heading"), F.regexp_replace(F.regexp_replace("raw", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))


def relevant_chunks(chunks: DataFrame, texts: DataFrame, always: Sequence[str] = (), top: int = 8) -> DataFrame:
    """batch, heading, score: the rule chunks for each text (batch, text), the best ``top`` and those of ``always``.

    A word of the heading in the text scores two, a table cell of the body one. Words of chunks meet words of texts by
    equality, so no chunk is compared with every text.
    """
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))))
    cells = F.array_join(F.regexp_extract_all("body", F.lit(r"\|([^|\n]+)"), F.lit(1)), " ")
    keys = chunks.select("heading", F.lit(2).alias("points"), words(F.col("heading")).alias("word")).unionByName(chunks.select("heading", F.lit(1).alias("points"), words(cells).alias("word")))
    keys = keys.groupBy("heading", "word").agg(F.max("points").alias("points"))
    scored = texts.select("batch", words(F.col("text")).alias("word")).join(keys, "word").groupBy("batch", "heading").agg(F.sum("points").alias("score"))
    best = best_of(scored, ["batch"], [F.desc("score"), F.col("heading")], top, "_n").drop("_n")
    if not always:
        return best
    fixed = chunks.filter(F.col("heading").isin(*always)).select("heading").distinct()
    every = texts.select("batch").distinct().select("batch", F.explode(F.array(*map(F.lit, dict.fromkeys(always)))).alias("heading")).join(fixed, "heading", "left_semi")
    every = every.select("batch", "heading", F.lit(0).cast("long").alias("score"))
    return best.unionByName(every.join(best, ["batch", "heading"], "left_anti"))


def confusion(expected: DataFrame, issues: DataFrame) -> DataFrame:
    """detected, missed, false_positives, clean of fixtures (doc_id, type, found; null type: none expected)."""
    hit = issues.select("doc_id", F.col("type").alias("_t"), F.col("found").alias("_f"))
    rows = expected.join(hit, "doc_id", "left")
    good = F.coalesce((F.col("_t") == F.col("type")) & F.contains("_f", F.col("found")), F.lit(False))
    one = rows.groupBy("doc_id", "type").agg(F.bool_or(good).alias("good"), F.count("_t").alias("n"))
    wanted = F.col("type").isNotNull()
    return one.agg(F.count_if(wanted & F.col("good")).alias("detected"), F.count_if(wanted & ~F.col("good")).alias("missed"), F.count_if(~wanted & (F.col("n") > 0)).alias("false_positives"), F.count_if(~wanted & (F.col("n") == 0)).alias("clean"))


def speller_pairs(answers: DataFrame) -> DataFrame:
    """``answers`` (key columns, origin_html, html) as rows with found, suggestion and info, pair by pair.

    Underlined spans of the original meet the marked words of the answer in order; the colour of a mark says what
    was wrong, and what one side has too many goes.
    """
    read = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    origins = F.regexp_extract_all("origin_html", F.lit(r"(?s)<span class='result_underline'>(.*?)</span>"), F.lit(1))
    mark = r"(?s)<em class='([a-z]+)_text'>(.*?)</em>"
    colours, fixes = (F.regexp_extract_all("html", F.lit(mark), F.lit(k)) for k in (1, 2))
    n = F.least(F.size(origins), F.size(fixes))
    zipped = F.arrays_zip(F.slice(origins, 1, n).alias("found"), F.slice(fixes, 1, n).alias("suggestion"), F.slice(colours, 1, n).alias("colour"))
    rows = answers.filter("origin_html is not null and html is not null").withColumn("x", F.explode(zipped)).drop("origin_html", "html")
    info = F.create_map(*[F.lit(v) for pair in SPELLER_COLOURS.items() for v in pair])
    keys = [c for c in rows.columns if c != "x"]
    return rows.select(*keys, read(F.col("x.found")).alias("found"), read(F.col("x.suggestion")).alias("suggestion"), F.coalesce(F.try_element_at(info, F.col("x.colour")), F.lit("")).alias("info"))


def manuscript_sample(texts: DataFrame, most: int = 20_000, front: int = 8_000, contents: int = 50, lead: int = 500, skip: int = 7_500) -> DataFrame:
    """doc_id, sample: whole texts (doc_id, text) of up to ``most`` characters, of longer ones what a reader sees first.

    That is the front, the first ``contents`` lines that look like headings, and the first ``lead`` characters of each
    chapter that begins behind ``skip``, numbered, as long as there is room. Lines are numbered and placed by window
    sums over their lengths, so a long text is no longer an array than its lines.
    """
    short = texts.filter(F.coalesce(F.length("text"), F.lit(0)) <= most).select("doc_id", F.col("text").alias("sample"))
    long = texts.filter(F.length("text") > most).select("doc_id", "text")
    w = W.partitionBy("doc_id").orderBy("line")
    lines = long.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    lines = lines.withColumn("at", F.coalesce(F.sum(F.length("x") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    heads = lines.filter(F.trim("x").rlike(r"^(?:제?\s*\d+\s*[장부편]|CHAPTER\s*\d+|Chapter\s*\d+|\d+\.\d+\s)") & (F.length(F.trim("x")) > 2))
    heads = best_of(heads, ["doc_id"], [F.col("line")], contents, "_n").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "x"))).alias("h"))
    toc = F.concat(F.lit("[--- 목차 ---]\n"), F.array_join("h.x", "\n"))
    rows = long.join(heads.select("doc_id", toc.alias("toc")), "doc_id", "left")
    rows = rows.withColumn("toc", F.substring("toc", 1, most - front)).withColumn("used", front + F.coalesce(F.length("toc"), F.lit(0)))
    chapters = lines.filter(F.col("x").rlike(r"^(?:제?\s*\d+\s*[장부편]|CHAPTER\s+\d+|Chapter\s+\d+)") & (F.col("line") > 0) & (F.col("at") >= skip))
    chapters = chapters.select("doc_id", "line", "at", F.row_number().over(w).alias("k"))
    parts = chapters.join(rows, "doc_id").select("doc_id", "line", "used", F.concat(F.lit("[--- "), F.col("k").cast("string"), F.lit("장 도입부 ---]\n"), F.substring("text", F.col("at") + 1, F.lit(lead))).alias("part"))
    parts = parts.withColumn("before", F.col("used") + F.coalesce(F.sum(F.length("part")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.filter(F.col("before") < most - 200).withColumn("part", F.substring("part", F.lit(1), most - F.col("before")))
    leads = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "part"))).alias("p"))
    sample = F.array_join(F.concat(F.array_compact(F.array(F.substring("text", 1, front), F.col("toc"))), F.coalesce("p.part", F.array().cast("array<string>"))), "\n\n")
    return short.unionByName(rows.join(leads, "doc_id", "left").select("doc_id", sample.alias("sample")))
