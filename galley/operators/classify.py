"""Categories of book and lecture titles: a dictionary of subjects, with two rules that come before it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions import fixed
from galley.functions.dictionary import first_mentioned, mentions

Rules = Sequence[tuple[Sequence[str], str]]


def category(title: Column, subjects: Mapping[str, Sequence[str]], otherwise: str = fixed.NO_TOPIC, vibe_words: Sequence[str] = fixed.VIBE_WORDS, tools: Rules = fixed.VIBE_TOOLS, ai_words: Sequence[str] = fixed.AI_TOOL_WORDS, first: Rules = fixed.SUBJECTS_BEFORE_TOOLS) -> Column:
    """The category of a title, ``otherwise`` for null and empty ones and those that no rule knows.

    The lower-cased title is read between two spaces, so that words with a space around them match at its ends. A
    title on vibe coding that names a tool belongs to the tool; one that names an AI tool beside a subject of
    ``first`` belongs to the subject; all others to the first of ``subjects`` with a word in the title. A title is
    searched once for the words of a table, whatever its size.
    """
    low = F.concat(F.lit(" "), F.lower(title), F.lit(" "))
    found = F.coalesce(
        F.when(mentions(low, vibe_words), first_mentioned(low, tools)),
        F.when(mentions(low, ai_words), first_mentioned(low, first)),
        first_mentioned(low, [(words, name) for name, words in subjects.items()]),
    )
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit(otherwise)).otherwise(F.coalesce(found, F.lit(otherwise)))


def lecture_category(title: Column, narrow: Column, wide: Column, subjects: Mapping[str, Sequence[str]], shelves: Mapping[str, str] = fixed.LECTURE_SHELVES, otherwise: str = fixed.NO_TOPIC) -> Column:
    """The category of a lecture: of its title, else of its narrow shelf, else of its wide one, else ``otherwise``."""
    shelf = F.create_map(*[F.lit(x) for pair in shelves.items() for x in pair])
    by_title = F.nullif(category(title, subjects, otherwise), F.lit(otherwise))
    return F.coalesce(by_title, F.try_element_at(shelf, F.coalesce(narrow, F.lit(""))), F.try_element_at(shelf, F.coalesce(wide, F.lit(""))), F.lit(otherwise))
