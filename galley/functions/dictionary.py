"""Dictionaries as column expressions: a test of every row against a fixed list of words.

A list of up to some hundreds of words becomes one expression inside whole-stage codegen; a join with the
list would be a nested loop of rows times words.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def mentions(text: Column, words: Sequence[str]) -> Column:
    """Whether ``text`` contains any of ``words`` as they stand; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), F.lit(False))


def _trie(words: Sequence[str]) -> str:
    """A pattern for the longest of ``words`` at a place, which looks at each of its characters once."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = [(c if c.isalnum() else "\\" + c) + pattern(below) for c, below in node.items() if c]
        if not parts:
            return ""
        joined = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return joined + "?" * ("" in node)

    return pattern(root)


def first_mentioned(text: Column, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The name of the first rule (words, name) with a word in ``text`` as it stands; null without one, or for null.

    One pass of one pattern, however many rules there are: at each place of the text a trie of all words finds the longest one
    that begins there. Words that begin another are found with it, so a word stands for the first rule of itself and of
    all words that it begins with. Words without a character are left out.
    """
    first: dict[str, int] = {}
    for i, (words, _) in enumerate(rules):
        for word in words:
            if word:
                first.setdefault(word, i)
    if not first:
        return F.lit(None).cast("string")
    least = {w: min(first[w[:n]] for n in range(1, len(w) + 1) if w[:n] in first) for w in first}
    places = F.from_json(F.lit(json.dumps(least)), "map<string, int>")  # one literal, whatever its size
    names = F.from_json(F.lit(json.dumps([name for _, name in rules])), "array<string>")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_trie(sorted(first))}))"), F.lit(1)))
    return F.get(names, F.array_min(F.transform(found, lambda w: F.try_element_at(places, w))))


def all_labels(text: Column, table: Mapping[str, Sequence[str]], otherwise: str | None = None) -> Column:
    """Labels whose words the lower-cased text mentions, in the table's order; [otherwise] (or []) if none."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.when(mentions(low, words), F.lit(label)) for label, words in table.items()]), lambda x: x.isNotNull())
    return found if otherwise is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(otherwise)))


def first_label(text: Column, table: Mapping[str, Sequence[str]], otherwise: str) -> Column:
    """The first label, in the table's order, whose words the lower-cased text mentions."""
    low = F.lower(text)
    return F.coalesce(*[F.when(mentions(low, words), F.lit(label)) for label, words in table.items()], F.lit(otherwise))


def keyword_labels(text: Column, table: Mapping[str, str], boundary: bool = False) -> Column:
    """Sorted distinct labels of the parts that the lower-cased text contains.

    ``boundary`` asks for whole words, so that a part doesn't match inside a longer word.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    if boundary:
        low = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    wrap = (lambda part: f" {part} ") if boundary else (lambda part: part)
    found = F.array(*[F.when(F.contains(low, F.lit(wrap(part))), F.lit(label)) for part, label in table.items()])
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def has_signal(title: Column, strong: Sequence[str], weak: Sequence[str], contexts: Sequence[str]) -> Column:
    """A strong phrase, or a weak one beside a context, in the lower-cased title between spaces."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(title, F.lit(""))), F.lit(" "))
    return mentions(low, strong) | (mentions(low, weak) & mentions(low, contexts))


def ladder(value: Column, steps: Sequence[tuple[float, float]], otherwise: float) -> Column:
    """The result of the first step (bound, result) whose bound ``value`` reaches."""
    (bound, result), *rest = steps
    out = F.when(value >= bound, F.lit(result))
    for bound, result in rest:
        out = out.when(value >= bound, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def half_up(value: Column) -> Column:
    """Rounded to an integer, halves towards plus infinity."""
    return F.floor(value + 0.5)
