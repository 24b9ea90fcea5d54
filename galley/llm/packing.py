"""Vector bin packing of token sequences by the dot-product heuristic.

An example asks for tokens, one segment and loss-bearing tokens; a sequence offers ``max_tokens``,
``max_segments`` and ``max_loss``. A sequence under construction takes, of the examples that fit, the one
whose demand has the largest dot product with what is left, both as shares of the limits. Examples longer
than a sequence are first cut into full ones and a rest. When nothing that fits is left in the pool, the
gap may be closed by cutting the example at hand (``cut``).

Each task packs its own rows, in pools of ``POOL`` examples, so nothing is shuffled and memory is bounded by
one document's ids and by a pool, whose examples are shorter than a sequence: full sequences of a document leave
at once with their ids. What stays open at the end of a task's rows is laid down as sequences
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm import tokens

MAX_TOKENS = 2048
#: Segments that one attention mask of a sequence may hold.
MAX_SEGMENTS = 256
EOS = 1
POOL = 8192


class Packer:
    """Places (key, start, tokens, loss) pieces; ``place`` gets them with a sequence number and an offset."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool) -> None:
        import numpy as np

        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=float)
        self.cut = cut
        self.next_sequence = 0
        self.open: list[tuple] = []  # pieces of the sequence under construction
        self.left = self.limits.copy()

    def pack(self, pieces: list[tuple], last: bool) -> Iterator[tuple]:
        """pieces: (key, start, tokens, loss flags or None). Yields (key, start, length, sequence, offset)."""
        import numpy as np

        if all(p[3] is None for p in pieces):
            yield from self._pack_plain(pieces)
            if last:
                yield from self.finish()
            return
        kinds: dict[tuple[int, int], list[tuple]] = {}
        for p in sorted(pieces, key=lambda p: p[:3], reverse=True):
            kinds.setdefault((p[2], self.loss_of(p)), []).append(p)
        names = list(kinds)
        demand = np.array([[t, 1, loss] for t, loss in names], dtype=float).reshape(-1, 3)
        share = demand / self.limits**2
        there = np.ones(len(names), dtype=bool)
        while there.any():
            fits = there & (demand <= self.left).all(axis=1)
            if fits.any():
                score = np.where(fits, share @ self.left, -1.0)
                k = int(score.argmax())
                p = kinds[names[k]].pop()
                there[k] = bool(kinds[names[k]])
                self.put(p)
                continue
            if self.cut and self.left[0] > 0 and self.left[1] >= 1 and self.left[2] >= self.left[0]:
                k = int(np.where(there, demand[:, 0], -1).argmax())  # the longest loses least by a cut
                p = kinds[names[k]].pop()
                there[k] = bool(kinds[names[k]])
                size = int(self.left[0])
                self.put((p[0], p[1], size, None if p[3] is None else p[3][:size]))
                yield from self.close()
                rest = (p[0], p[1] + size, p[2] - size, None if p[3] is None else p[3][size:])
                kind = (rest[2], self.loss_of(rest))
                if kind in kinds:
                    k = names.index(kind)
                else:
                    kinds[kind], k = [], len(names)
                    names.append(kind)
                    demand = np.vstack([demand, [rest[2], 1, kind[1]]])
                    share = demand / self.limits**2
                    there = np.append(there, True)
                kinds[kind].append(rest)
                there[k] = True
                continue
            yield from self.close()
        if last:
            yield from self.finish()

    def _pack_plain(self, pieces: list[tuple]) -> Iterator[tuple]:
        """Where all tokens bear loss, the dot product grows with the length: the longest that fits has the largest."""
        stacks: dict[int, list[tuple]] = {}
        for p in sorted(pieces, key=lambda p: p[:2], reverse=True):
            stacks.setdefault(p[2], []).append(p)
        lengths = sorted(stacks)

        def take(i: int) -> tuple:
            size = lengths[i]
            p = stacks[size].pop()
            if not stacks[size]:
                del stacks[size], lengths[i]
            return p

        while lengths:
            room, places, loss = map(int, self.left)
            i = bisect_right(lengths, min(room, loss)) - 1 if places else -1
            if i >= 0:
                self.put(take(i))
            elif self.cut and places and loss >= room > 0:
                key, start, size, _ = take(len(lengths) - 1)  # the longest loses least by a cut
                self.put((key, start, room, None))
                yield from self.close()
                if size - room not in stacks:
                    insort(lengths, size - room)
                stacks.setdefault(size - room, []).append((key, start + room, size - room, None))
            else:
                yield from self.close()

    @staticmethod
    def loss_of(p: tuple) -> int:
        return p[2] if p[3] is None else int(sum(p[3]))

    def put(self, p: tuple) -> None:
        self.open.append(p)
        loss = self.loss_of(p)
        self.left[0] -= p[2]
        self.left[1] -= 1
        self.left[2] -= loss

    def close(self) -> Iterator[tuple]:
        at = 0
        for key, start, size, _ in self.open:
            yield key, start, size, self.next_sequence, at
            at += size
        if self.open:
            self.next_sequence += 1
        self.open, self.left = [], self.limits.copy()

    def finish(self) -> Iterator[tuple]:
        """The open pieces in sequences of the powers of two that make up their length, largest first; in one where nothing may be cut."""
        if not self.cut:
            yield from self.close()
            return
        todo = self.open[::-1]
        total = sum(p[2] for p in todo)
        while total:
            size = 1 << (total.bit_length() - 1)
            at = 0
            while at < size:
                key, start, n, mask = todo.pop()
                take = min(n, size - at)
                yield key, start, take, self.next_sequence, at
                if take < n:
                    todo.append((key, start + take, n - take, mask))
                at += take
            self.next_sequence += 1
            total -= size
        self.open, self.left = [], self.limits.copy()


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, cut: bool = True, tokenizer: str = tokens.TOKENIZER, ranks: str | None = tokens.RANKS) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, loss_tokens (of the piece), sequence_id, offset of every piece.

    A row's ids are those of its whole text, without special tokens, then EOS; null and empty texts give
    EOS alone. ``ids`` are packed little-endian unsigned 32-bit integers. Each id lies in one piece, and a
    sequence's pieces lie from offset 0 on without gaps. Rows that repeat a doc_id, or all of a row, are
    packed once each. A column ``loss_mask`` (array<boolean>, one flag a token, EOS included), where there
    is one, says which tokens bear loss; a null mask, or one of another length, means all, and a column of that name
    and another type is ignored. Without ``cut`` an example is parted only where it exceeds a limit by itself. An empty table
    gives an empty result; other columns are ignored. sequence_id is unique over all tasks.
    """
    import numpy as np
    import pyarrow as pa

    loss_limit = max_tokens if max_loss is None else max_loss
    masked = "loss_mask" in docs.columns and docs.schema["loss_mask"].dataType.simpleString() == "array<boolean>"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "text"] + ["loss_mask"] * masked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokens.encoder(tokenizer, ranks)
        base = TaskContext.get().partitionId() << 40
        packer = Packer(max_tokens, max_segments, loss_limit, cut)
        held: dict[int, tuple] = {}  # row number -> doc_id, ids still in the pool, where they start, number of tokens, ids not placed yet, mask
        pool: list[tuple] = []
        kind = pa.int64()
        row = 0

        def read(batch: pa.RecordBatch) -> Iterator[tuple]:
            # a byte a flag, and some rows at a time: a list of a flag's objects takes eight
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                held_flags = some.column("loss_mask") if masked else [None] * some.num_rows
                for doc, text, row_flags in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), held_flags, strict=True):
                    there = masked and row_flags.is_valid
                    yield doc, text, row_flags.values.fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes() if there else None

        def emit(placed: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            rows = []
            for key, start, size, sequence, at in placed:
                doc, ids, first, n, left, mask = held[key]
                loss = size if mask is None else sum(mask[start : start + size])
                rows.append((doc, start, size, ids[4 * (start - first) : 4 * (start + size - first)], n, loss, base + sequence, at))
                if left == size:
                    del held[key]
                else:
                    held[key] = (doc, ids, first, n, left - size, mask)
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, size, ids, n, loss, sequence, at = map(list, zip(*rows, strict=True))
            long = pa.int64()
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, kind), pa.array(start, long), pa.array(size, long), pa.array(ids, pa.binary()), pa.array(n, long), pa.array(loss, long), pa.array(sequence, long), pa.array(at, long)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            kind = batch.column("doc_id").type
            for doc, text, flags in read(batch):
                ids = encode(text) + np.array([EOS], dtype="<u4").tobytes()
                n = len(ids) // 4
                mask = flags if flags is not None and len(flags) == n else None
                held[row] = (doc, ids, 0, n, n, mask)
                full = [] if mask is not None and loss_limit < max_tokens else list(range(0, n - max_tokens + 1, max_tokens))
                if full:
                    whole = []
                    for start in full:
                        whole.append((row, start, max_tokens, packer.next_sequence, 0))
                        packer.next_sequence += 1
                    yield from emit(iter(whole))
                at = len(full) * max_tokens
                if full and at < n:
                    held[row] = (doc, ids[4 * at :], at, n, n - at, mask)  # the placed ids go
                while at < n:  # a piece's loss-bearing tokens must fit in an empty sequence
                    size = min(max_tokens, n - at)
                    if mask is not None or loss_limit < max_tokens:
                        sums = np.cumsum(np.frombuffer(mask, np.uint8, size, at) if mask is not None else np.ones(size, np.uint8), dtype=np.int64)
                        size = max(1, int(np.searchsorted(sums, loss_limit, side="right")))
                    pool.append((row, at, size, mask[at : at + size] if mask is not None else None))
                    at += size
                row += 1
                if len(pool) >= POOL:
                    full_pool, pool = pool, []
                    yield from emit(packer.pack(full_pool, last=False))
        yield from emit(packer.pack(pool, last=True))

    schema = f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
    return docs.select(*columns).mapInArrow(run, schema)


def query(spark, sf_dir):
    """One row per piece of ``documents`` in sequences of at most 2048 tokens, with a checksum of its ids."""
    from galley.session import table

    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
