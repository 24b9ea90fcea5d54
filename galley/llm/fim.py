"""Fill-in-the-middle examples: a text cut at two random token boundaries, its parts reordered behind marks.

Tokens are what the ``Split`` pre-tokenizer of the tokenizers library isolates with a pattern; nothing is
trained. It gives the offsets of all tokens in code points: the length of that array is the number of
tokens, and the offset of a given rank is where a part ends, so parts are slices of the text.

The cuts and the form depend on nothing but the document's id and a salt, so reruns agree.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 documents with a usable text, so many stay as they are; of 100 others, so many have the suffix first.
PLAIN = 10
SUFFIX_FIRST = 20
#: Code points that are cut into tokens at a time; a part goes on to the end of its run of letters. The library keeps a
#: table of a part's bytes, which is fastest where it stays in the processor's nearest memory.
CHUNK = 256

_NOT_LETTER = re.compile("[^A-Za-z]")


class Cutter:
    """Offsets of the tokens of a text, by the tokenizers library."""

    def __init__(self, chunk: int = CHUNK) -> None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(UNIT), behavior="isolated")
        self.chunk = chunk

    def ends(self, text: str):
        """The ends of all tokens in code points, an integer array. Between a letter and another letter no part is cut."""
        import numpy as np

        ends, at, cut = array("q"), 0, self.split.pre_tokenize_str
        while at < len(text):
            stop = min(at + self.chunk, len(text))
            if stop < len(text):
                following = _NOT_LETTER.search(text, stop)
                stop = following.start() if following else len(text)
            ends.extend([at + end for _, (_, end) in cut(text[at:stop])])
            at = stop
        return np.frombuffer(ends, np.int64)


def draws(doc_id, salt: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers: the first hexadecimal digits of the SHA-256 of the salt, a colon and the id (none for null)."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def example(cutter: Cutter, doc_id, text: str | None, salt: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """n, form, characters of prefix and of middle (None if plain), output."""
    text = text or ""
    ends = cutter.ends(text)
    n = len(ends)
    one, two, three, four = draws(doc_id, salt)
    if not text or three % 100 >= 100 - plain or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = sorted((one % (n + 1), two % (n + 1)))
    x, y = (int(ends[k - 1]) if k else 0 for k in (a, b))
    head, middle, tail = text[:x], text[x:y], text[y:]
    if four % 100 < suffix_first:
        return n, "spm", x, y - x, SUFFIX + tail + PREFIX + head + MIDDLE + middle
    return n, "psm", x, y - x, PREFIX + head + SUFFIX + tail + MIDDLE + middle


def fill_in_middle(docs: DataFrame, salt: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of each row's whole text.

    ``n`` counts tokens. The prefix ends after a random number of them, the middle after a number as large
    or larger; either part, or the suffix, may be empty. A text that is null, empty or holds one of the marks
    stays plain, as do ``plain`` of 100 others; then both lengths are null and output is the text. Of 100 of
    the rest, ``suffix_first`` put the suffix first (spm), the others the prefix (psm). A null doc_id draws
    as an empty id. Rows are formatted one by one, repeated ones too; an empty table gives an empty result;
    other columns are ignored. One pass over the scan, nothing is shuffled.
    """
    import pyarrow as pa

    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = [example(cutter, i, t, salt, plain, suffix_first) for i, t in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True)]
                made = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                made[-1] = made[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *made], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, exactly; null where either is null.

    An output that isn't plain holds each mark once as a mark, and its text holds none, so splitting at the
    marks gives back the parts.
    """
    parts = F.split(output, "|".join(MARKS), 4)  # the first is empty
    part = lambda *places: F.concat(*(F.get(parts, F.lit(p)) for p in places))
    return F.when(form == "psm", part(1, 3, 2)).when(form == "spm", part(2, 3, 1)).when(form == "plain", output)


def query(spark, sf_dir):
    """One row per document of ``documents``: the contract's digests of the formatted and of the restored text."""
    from galley.session import table

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
         ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (
  SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS head, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS tail FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid
                        ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""
