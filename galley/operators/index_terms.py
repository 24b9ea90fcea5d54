"""Book index terms: signals of candidate terms on pages, a value score, pairs of Korean and English names.

Pages are rows (doc_id, page, text, code boolean). A candidate's signals are summed over all pages in one
grouping; nothing is kept but one row a term.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import fixed
from galley.operators.snapshots import best_of

# Shapes of candidates.
CAPITALISED = r"(?<![A-Za-z0-9])[A-Z][A-Za-z0-9]{2,}(?![A-Za-z0-9])"
BILINGUAL = r"([가-힣][가-힣 ]{1,20})\(([A-Za-z][A-Za-z0-9 .\-]{1,30})\)"
LEAST_SCORE = 7


def term_key(term: Column) -> Column:
    """What spellings of one term have in common: lower case without spaces, hyphens and underscores."""
    return F.lower(F.regexp_replace(term, r"[\s\-_]+", ""))


def candidates(pages: DataFrame, pattern: str = CAPITALISED) -> DataFrame:
    """doc_id, page, term, code: every candidate on every page, as often as it stands there."""
    return pages.select("doc_id", "page", "code", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("term"))


def signals(pages: DataFrame, pattern: str = CAPITALISED, definition: str = r"(?:이란|란|는|은) ", action: str = r"(?:을|를) (?:사용|이용|실행|호출)", modified: Sequence[str] = fixed.MODIFIED) -> DataFrame:
    """One row a document and term: freq, pages, body_pages, code_pages, defined, with_english, acted, header_only, modifier_only.

    A term is defined where ``definition`` follows it, acted on where ``action`` does, and has an English name where a
    bracket does. It is header-only where four fifths of its pages have it in their first line and in no other,
    modifier-only where it isn't defined and each of its two uses at most goes before a word of ``modified``. Each
    test walks over a page once, whatever the number of its terms.
    """
    term = f"(?>{pattern})"
    found = lambda regex, text="text": F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    head = F.substring_index("text", "\n", 1)
    rest = F.substring("text", F.length(head) + 1, F.length("text"))
    tests = {
        "t": found(pattern), "n": found(f"(?<![A-Za-z0-9]){term}(?![A-Za-z0-9])"), "d": found(f"{term}(?={definition})"), "a": found(f"{term}(?={action})"),
        "e": found(rf"{term}(?=\s?\()"), "h": found(pattern, head), "r": found(pattern, rest),
        "m": found(rf"{term}(?=\s{{0,9}}(?:{'|'.join(modified)}))"),
    }
    tag = lambda x, k: F.transform(x, lambda t: F.struct(F.lit(k).alias("test"), t.alias("term")))
    hits = F.concat(*[tag(x, k) for k, x in tests.items()])
    rows = pages.select("doc_id", "page", "code", F.monotonically_increasing_id().alias("row"), hits.alias("hits")).select("doc_id", "page", "code", "row", F.inline("hits"))
    is_ = lambda k: F.col("test") == k
    rows = rows.groupBy("row", "doc_id", "page", "code", "term").agg(F.count_if(is_("n")).alias("n"), F.count_if(is_("t")).alias("uses"), F.count_if(is_("m")).alias("m"), *[F.bool_or(is_(k)).alias(k) for k in "tdaehr"]).filter("t")
    out = rows.groupBy("doc_id", "term").agg(
        F.sum("n").alias("freq"), F.array_sort(F.collect_set("page")).alias("pages"), F.count_if(~F.col("code")).alias("body_pages"), F.count_if("code").alias("code_pages"),
        F.bool_or("d").alias("defined"), F.bool_or("e").alias("with_english"), F.bool_or("a").alias("acted"), (F.count_if(F.col("h") & ~F.col("r")) * 5 >= F.count("*") * 4).alias("header_only"),
        (~F.bool_or("d") & (F.sum("uses") <= 2) & (F.sum("m") >= F.sum("uses"))).alias("modifier_only"),
    )
    return out


def score() -> Column:
    """0 to 10: 5 for a mention, more for definitions, frequency and use, less for headers, modifiers and code only."""
    points = (
        F.lit(5)
        + F.when(F.col("defined") & F.col("with_english"), 5).when(F.col("defined"), 4).otherwise(0)
        + F.when(F.col("freq") >= 3, 3).otherwise(0)
        + F.when(F.col("acted"), 2).otherwise(0)
        - F.when(F.col("header_only"), 3).otherwise(0)
        - F.when(F.col("modifier_only"), 2).otherwise(0)
        - F.when((F.col("code_pages") > 0) & (F.col("body_pages") == 0), 5).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(10), points))


def valued(terms: DataFrame, least: int = LEAST_SCORE) -> DataFrame:
    """Terms that score ``least`` or more, best first, in Korean order. Without a column modifier_only none is one."""
    if "modifier_only" not in terms.columns:
        terms = terms.withColumn("modifier_only", F.lit(False))
    return terms.withColumn("score", score()).filter(F.col("score") >= least).orderBy(F.desc("score"), F.collate("term", "ko"), "doc_id")


def bilingual_pairs(pages: DataFrame) -> DataFrame:
    """doc_id, korean, english, n of names with the other in brackets, the commonest English a Korean name."""
    both = F.explode(F.regexp_extract_all("text", F.lit(BILINGUAL), F.lit(0))).alias("x")
    rows = pages.select("doc_id", both).select("doc_id", F.trim(F.regexp_extract("x", BILINGUAL, 1)).alias("korean"), F.trim(F.regexp_extract("x", BILINGUAL, 2)).alias("english"))
    counts = rows.groupBy("doc_id", "korean", "english").agg(F.count("*").alias("n"))
    return best_of(counts, ["doc_id", "korean"], [F.desc("n"), F.col("english")], 1, "_n").drop("_n")


def one_language(terms: DataFrame, pairs: DataFrame, translations: Mapping[str, str] = fixed.TRANSLATIONS) -> DataFrame:
    """Terms without English ones whose Korean partner, by ``pairs`` or ``translations``, is listed too; PascalCase names stay."""
    there = terms.select("doc_id", term_key(F.col("term")).alias("k")).distinct()
    named = pairs.select("doc_id", term_key(F.col("korean")).alias("k"), term_key(F.col("english")).alias("key"))
    same = F.create_map(*[F.lit(x) for pair in translations.items() for x in pair])
    named = named.unionByName(there.select("doc_id", "k", F.try_element_at(same, F.col("k")).alias("key")).filter("key is not null"))
    known = named.join(there, ["doc_id", "k"], "left_semi").select("doc_id", "key").distinct()
    pascal = F.col("term").rlike(r"^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+$")
    rows = terms.withColumn("key", F.when(~pascal, term_key(F.col("term"))))
    return rows.join(known, ["doc_id", "key"], "left_anti").drop("key")


def mostly(rows: DataFrame, test: Column, share: float) -> DataFrame:
    """doc_id, term of (doc_id, term, text) rows of which ``share`` or more pass the test (labels, data fields)."""
    return rows.groupBy("doc_id", "term").agg(F.count_if(test).alias("_y"), F.count("*").alias("_n")).filter(F.col("_y") >= F.col("_n") * share).select("doc_id", "term")


def label_terms(pages: DataFrame, terms: DataFrame, share: float = 0.8) -> DataFrame:
    """doc_id, term of the terms (doc_id, page, term) that stand in square brackets on ``share`` of their pages: labels of menus."""
    quoted = F.concat(F.lit("["), "term", F.lit("]"))
    rows = terms.select("doc_id", "page", "term").distinct().join(pages.select("doc_id", "page", "text"), ["doc_id", "page"])
    return mostly(rows, F.contains("text", quoted), share)


def field_terms(pages: DataFrame, terms: DataFrame, share: float = 0.7) -> DataFrame:
    """doc_id, term of the terms that name fields of data: by their last word, or by ``share`` of their pages.

    Such a page has the term before a colon and a Latin letter, or between commas or middle dots.
    """
    literal = F.concat(F.lit("\\Q"), "term", F.lit("\\E"))
    rows = terms.select("doc_id", "page", "term").distinct().join(pages.select("doc_id", "page", "text"), ["doc_id", "page"])
    field = F.regexp_like("text", F.concat(F.lit("(?i)"), literal, F.lit(r"\s*:\s*[A-Z]"))) | F.regexp_like("text", F.concat(F.lit(r"[·,]\s*"), literal, F.lit(r"\s*[·,]")))
    named = F.col("term").rlike(r"(?:필드|값|컬럼|열|행|키|속성)\s*$")
    return mostly(rows, field | named, share)


def divider_page(text: Column, font: Column, cues: Sequence[str] = fixed.CHAPTER_CUES) -> Column:
    """Whether a page opens a chapter: a part or chapter in type of 20 points or more, or two cues of its aims."""
    low = F.lower(F.coalesce(text, F.lit("")))
    titled = (F.coalesce(font, F.lit(0)) >= 20) & low.rlike(r"\b(?:part|chapter)\b|chapter|\d+\s*장(?![가-힣])")
    return titled | (sum((F.contains(low, F.lit(c)).cast("int") for c in cues), F.lit(0)) >= 2)


def filtered(terms: DataFrame, category: str | None = None, text: str | None = None) -> DataFrame:
    """Terms of a category (column ``cat``) that contain ``text`` in any case."""
    out = terms if category is None else terms.filter(F.col("cat") == category)
    return out.filter(F.contains(F.lower("term"), F.lit(text.lower()))) if text else out


def score_distribution(terms: DataFrame) -> DataFrame:
    """n, excellent (9 and up), good (8), fair, mean (to one decimal) of the scores, and the percents of the three, rounded."""
    percent = lambda c: F.coalesce(F.floor(F.col(c) * 100 / F.nullif(F.col("n"), F.lit(0)) + 0.5), F.lit(0)).alias(f"{c}_percent")
    sums = terms.agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 9).alias("excellent"), F.count_if((F.col("score") >= 8) & (F.col("score") < 9)).alias("good"), F.count_if(F.col("score") < 8).alias("fair"), F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("mean"))
    return sums.select("*", percent("excellent"), percent("good"), percent("fair"))


def compounds(pages: DataFrame, endings: Sequence[str], shortest: int = 4, longest: int = 20) -> DataFrame:
    """doc_id, page, term: two or three words in a row that end in one of ``endings`` (엔진, 패턴 ...)."""
    hits = F.regexp_extract_all("text", F.lit(r"[가-힣A-Za-z]{2,}\s[가-힣A-Za-z]{2,}(?:\s[가-힣A-Za-z]{2,})?"), F.lit(0))
    rows = pages.select("doc_id", "page", F.explode(hits).alias("term")).withColumn("term", F.trim("term"))
    return rows.filter(F.length("term").between(shortest, longest) & F.col("term").rlike(f"(?:{'|'.join(endings)})$"))


def initial_group(term: Column) -> Column:
    """The initial consonant of a Hangul term, the upper-case letter of an ASCII one, '#' for others."""
    code = F.ascii(term)
    consonants = F.array(*map(F.lit, "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"))
    return F.when(code.between(44032, 55203), F.element_at(consonants, (F.floor((code - 44032) / 588) + 1).cast("int"))).when(term.rlike("^[A-Za-z]"), F.upper(F.substring(term, 1, 1))).otherwise("#")


def final_consonant(char: Column) -> Column:
    """Whether a Hangul syllable ends in a consonant; null for others."""
    code = F.ascii(char)
    return F.when(code.between(44032, 55203), (code - 44032) % 28 != 0)


def with_particle(word: Column, after_consonant: str, after_vowel: str) -> Column:
    """The word with the form of a particle that its last syllable asks for."""
    return F.concat(word, F.when(F.coalesce(final_consonant(F.substring(word, -1, 1)), F.lit(False)), F.lit(after_consonant)).otherwise(F.lit(after_vowel)))
