import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from galley.llm import tokens

LIBRARY = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
PIECES = [" ", "  ", "\n", "\t", "\r\n", "a", "word", "Word's", "'ll", "123", "4567890", "é", "ß", "한글", "日本語", "🙂", "👩‍👩‍👧", "<|endoftext|>", "<|endof", "!!", "...", " ", " ", "\x1c", "\x85", "ǅ", "़", "Ω", "x" * 70, "​", "İ", "-", "_"]


def texts(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, size))) for _ in range(n)]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def unpack(b):
    return [int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)]


def test_ids_are_the_librarys():
    encode = tokens.Encoder()
    for text in texts(400, 40, 1):
        assert unpack(encode(text)) == ids(text), repr(text)


@pytest.mark.parametrize("chunk", [64, 200])
def test_chunks_splice_exactly(chunk):
    encode = tokens.Encoder(chunk=chunk, overlap=32)
    for text in [*texts(120, 200, chunk), "a" * 1000, " " * 700, "x" * 300 + "<|endoftext|>" * 20, "é" * 500, "\n" * 400 + "z"]:
        assert unpack(encode(text)) == ids(text), repr(text)[:200]


def test_line_breaks_inside_a_run_of_white_space():
    encode = tokens.Encoder()
    for text in ["foo\n\xa0\xa0bar", "foo\n\xa0 bar", "foo \n\xa0bar", "foo\n\xa0", "foo\n\xa0<|endoftext|>", "foo\n\xa0bar", "foo\n bar", "foo\r\nbar"]:
        assert unpack(encode(text)) == ids(text), repr(text)


def test_counts(docs):
    rows = [(1, None), (2, ""), (3, "hello <|endoftext|> é"), (3, "hello"), (4, "tok " * 2000), (5, "word" * 40_000)]
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs(rows)).collect())
    want = sorted((i, len((t or "").encode()), len(ids(t or "")), len(ids(t or "")) > 1024) for i, t in rows)
    assert got == want
    assert tokens.token_counts(docs([])).collect() == []
