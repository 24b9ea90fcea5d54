"""Instruction data for packing: windows of conversations with a mask of the tokens that bear loss.

Windows are those of :mod:`galley.llm.chat`, whose spans of loss are the assistant's texts. A byte-level vocabulary says how many
bytes each token stands for, so the spans are carried to tokens by adding up lengths, without a second tokenisation. A
token bears loss if its first byte lies in a span; the end token doesn't.

:func:`pack_conversations` packs them by the dot product of demands and what is left, under limits on tokens, segments and
loss-bearing tokens: here the limits pull in different directions, as questions are long and answers short or the
other way round.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm import chat, packing, tokens

MAX_TOKENS = 2048
MAX_SEGMENTS = 8
MAX_LOSS = 768


def byte_lengths(encoder: tokens.Encoder):
    """How many bytes each id of the vocabulary stands for."""
    import numpy as np

    vocabulary = encoder.library.get_vocab(with_added_tokens=True)
    added = encoder.library.get_added_tokens_decoder()
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for piece, i in vocabulary.items():
        # in this kind of vocabulary each byte is written as one character; added tokens are texts
        out[i] = len(added[i].content.encode()) if i in added else len(piece)
    return out


def loss_flags(lengths, ids, text: str, spans: list[tuple[int, int]]):
    """For each id of ``text``, and for the end token behind them, whether it begins in one of the spans of code points."""
    import numpy as np

    starts = np.cumsum(lengths[ids]) - lengths[ids]
    flags = np.zeros(len(ids) + 1, bool)
    point, byte = 0, 0
    for a, b in spans:
        byte += len(text[point:a].encode())
        first, byte = byte, byte + len(text[a:b].encode())
        point = b
        flags[np.searchsorted(starts, first) : np.searchsorted(starts, byte)] = True
    return flags


def instruction_rows(turns: DataFrame, budget: int = chat.BUDGET, history: int = chat.HISTORY) -> DataFrame:
    """doc_id ('conversation:part:window', 'null' for a null conversation), text, loss_mask of the windows of conversations.

    :func:`galley.llm.chat.windows` says what it does with nulls, ties and repeated rows; an empty table gives an empty result.
    """
    import pyarrow as pa

    made = chat.windows(turns, budget, history)
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), "part", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = tokens.encoder(tokens.TOKENIZER, tokens.RANKS)
        lengths = byte_lengths(encode)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                masks = []
                for text, loss in zip(some.column("text").to_pylist(), some.column("loss").to_pylist(), strict=True):
                    ids = np.frombuffer(encode(text), "<u4")
                    masks.append(loss_flags(lengths, ids, text, [(s["start"], s["end"]) for s in loss]))
                ends = np.cumsum([0, *map(len, masks)], dtype=np.int32)
                flags = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(masks)))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text"), flags], names=["doc_id", "text", "loss_mask"])

    return made.select(name.alias("doc_id"), F.col("formatted").alias("text"), "loss").mapInArrow(run, "doc_id string, text string, loss_mask array<boolean>")


def pack_conversations(turns: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS) -> DataFrame:
    """The pieces of :func:`galley.llm.packing.pack` for the windows of conversations, uncut unless one exceeds a limit by itself.

    No sequence holds more than ``max_tokens`` tokens, ``max_segments`` windows or ``max_loss`` loss-bearing tokens.
    """
    return packing.pack(instruction_rows(turns), max_tokens, max_segments, max_loss, cut=False)


def query(spark, sf_dir):
    """``conversations`` packed for instruction tuning: a row a piece, with its place and its loss-bearing tokens."""
    from galley.session import table

    pieces = pack_conversations(table(spark, sf_dir, "conversations"))
    return pieces.select("doc_id", "start", "length", "loss_tokens", "doc_tokens", "sequence_id", "offset")
