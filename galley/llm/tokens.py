"""Token ids of whole texts, with overlap resynchronisation for huge ones.

A byte-level BPE splits a text into pre-tokens by a pattern that never looks behind, and encodes each
alone. So two encodings that share one pre-token boundary agree from there on. Three things follow:

* A text may be cut before any single space that stands between two other characters; the pieces are
  encoded once each and kept in a cache.
* Overlapping chunks of a huge text may be spliced at the first pre-token boundary that both have, if
  the left chunk's boundary is final: more than ``MARGIN`` characters before its end, so that neither a
  longer run, a contraction nor a special string can still change it.
* Where no such boundary lies in the overlap, the overlap is doubled to both sides, at worst until the
  chunk begins at the last splice point, which is proven.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Texts with more characters than this are encoded in overlapping chunks of that many.
CHUNK = 65_536
OVERLAP = 256
#: Longer than a contraction, a multi-part lookahead or a special string (13 characters).
MARGIN = 24
#: Pieces that a Python worker keeps, twice: those in use and those before them.
CACHE = 300_000

_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A space next to other white space, or to the separators that libraries class differently.
_ODD_SPACE = re.compile(r"\s | \s")
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ODD_CHAR = re.compile("[^\x00-ɏ]|[\x1c-\x1f\x85\xa0]")
#: A line break whose run of white space goes on, so that it is no pre-token of its own.
_JOINED_BREAK = re.compile(r"\n\s(?:\s|\Z)|\s\n\s")


class Encoder:
    """Ids of texts as packed little-endian unsigned 32-bit integers, without added special tokens.

    Pieces of Latin letters and ASCII are encoded by tiktoken over the same vocabulary as ranks, five
    times faster; all others by the tokenizers library itself. Tests hold both against each other.
    """

    def __init__(self, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.specials = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.split_specials = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.quick = None
        if ranks is not None:
            import tiktoken

            with open(public_tokenizers.path(ranks), "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.chunk, self.overlap = chunk, overlap
        self.spaced = _Cache(self, " ")
        self.plain = _Cache(self, "")

    def piece(self, text: str) -> bytes:
        if self.quick is not None and len(text) < 1000:
            if "\n" in text and all(lines := text.split("\n")) and not _JOINED_BREAK.search(text) and not any(s in text for s in self.specials):
                # white space gives its last sign to what follows, so a line break is a pre-token of its own
                # where it is that last one, or where it stands first and just one white space follows
                head = self.spaced[lines[0][1:]] if text[0] == " " and len(lines[0]) > 1 else self.plain[lines[0]]
                return head + b"".join(self.plain["\n"] + self.plain[x] for x in lines[1:])
            end = text.rstrip(_SIGNS)
            if end.removeprefix(" ").isalpha() and (end.isascii() or not _ODD_CHAR.search(end)):
                # letters are one pre-token, and the signs behind them another
                if len(end) < len(text):
                    head = self.spaced[end[1:]] if end[0] == " " else self.plain[end]
                    return head + self.plain[text[len(end) :]]
                return array("I", self.quick._core_bpe.encode_single_piece(end.encode())).tobytes()
        if self.quick is not None and len(text) < 1000 and not _ODD_CHAR.search(text) and not any(s in text for s in self.specials):
            ids = self.quick.encode_ordinary(text)
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) > self.chunk:
            return self.huge(text)
        return self.whole(text)

    def whole(self, text: str) -> bytes:
        parts = _INNER_SPACE.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        head = self.plain[parts[0]] if parts[0] else b""
        if len(parts) < 3:
            return head + self.spaced[parts[1]] if len(parts) == 2 else head
        return head + b"".join(itemgetter(*parts[1:])(self.spaced))

    def boundaries(self, text: str, start: int, end: int) -> tuple[list[int], list[bytes]]:
        """Ends, in ``text``, of the pre-tokens of text[start:end], and the ids of each."""
        ends, ids, at = [], [], start
        segments = self.split_specials.split(text[start:end]) if self.split_specials else [text[start:end]]
        for k, segment in enumerate(segments):
            if k % 2:
                ends.append(at + len(segment))
                ids.append(self.plain[segment])
            elif segment:
                for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(segment):
                    ends.append(at + b)
                    ids.append(self.plain[segment[a:b]])
            at += len(segment)
        return ends, ids

    def huge(self, text: str) -> bytes:
        out: list[bytes] = []
        proven, size = 0, len(text)  # the text before ``proven`` is in ``out``
        stop = min(size, self.chunk)
        ends, ids = self.boundaries(text, 0, stop)
        while stop < size:
            overlap = self.overlap
            while True:
                begin = max(proven, stop - overlap)
                further = min(size, stop + max(self.chunk, overlap))
                next_ends, next_ids = self.boundaries(text, begin, further)
                final = [e for e in ends if begin < e <= stop - MARGIN] + ([proven] if begin == proven else [])
                shared = set(final) & (set(next_ends) | ({begin} if begin == proven else set()))
                if shared:
                    break
                overlap *= 2
            splice = min(shared)
            out += [i for e, i in zip(ends, ids, strict=True) if e <= splice]
            kept = [(e, i) for e, i in zip(next_ends, next_ids, strict=True) if e > splice]
            ends, ids = [e for e, _ in kept], [i for _, i in kept]
            proven, stop = splice, further
        return b"".join(out + ids)


class _Cache(dict):
    """Ids of pieces with what stands before them. A full one becomes the older one, from which pieces still in use come back."""

    def __init__(self, encoder: Encoder, before: str) -> None:
        super().__init__()
        self.encoder, self.before = encoder, before
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            quick = self.encoder.quick
            if quick is not None and piece.isascii() and piece.isalpha() and len(piece) < 1000:
                ids = array("I", quick._core_bpe.encode_single_piece((self.before + piece).encode())).tobytes()
            else:
                ids = self.encoder.piece(self.before + piece)
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_encoders: dict[tuple, Encoder] = {}


def encoder(*args) -> Encoder:
    """One encoder a Python worker."""
    if args not in _encoders:
        _encoders[args] = Encoder(*args)
    return _encoders[args]


def token_counts(docs: DataFrame, limit: int = 1024, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row's whole text.

    Null and empty texts have 0 bytes and tokens. Rows are counted one by one, repeated ones too; an empty
    table gives an empty result; other columns are ignored. One pass over the scan, nothing is shuffled.
    """
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            n = [len(encode(t)) // 4 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir):
    """One row per document of ``documents``: its bytes and tokens."""
    from galley.session import table

    return token_counts(table(spark, sf_dir, "documents"))
