"""Chat formatting in budgeted windows.

Each turn is rendered between control strings that name its role, with control strings inside texts
escaped, so that formatted windows read back to the turns exactly. Turns are counted in tokens, and
prefix sums of the counts choose spans of whole turns that fit a window's budget beside the system turn
and a limited history. The system turn opens every window; the turns before a span are repeated up
to ``history`` tokens; the loss mask covers the texts of assistant turns in the window where they are
new, and never where they are repeated.

A conversation is cut in parts of ``PART`` rows, by their position in it: all rows are sorted by ranges of
(conversation, turn, role, text), numbered range by range, and the counts of earlier ranges are added. Spans
are chosen part by part, and a part gets the history before it from as many parts as that reaches back, so
that a conversation with a third of all rows is the work of many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.llm import tokens
from galley.llm.common import Scratch

BUDGET = 2048
HISTORY = 512
PART = 256
#: Signs of a text that ranges are cut by; equal rows up to that length may fall in several ranges.
LEADING = 256
#: Control strings of the template (fixed values).
OPEN, CLOSE = "<s>", "</s>"
USER, USER_END = "[INST]", "[/INST]"
SYSTEM, SYSTEM_END = "<<SYS>>", "<</SYS>>"
ROLE, ROLE_END = "[ROLE=", "]"
_FIRST = r"<(?=/?s>|</?SYS>>)|\[(?=/?INST\]|ROLE=)"
_TURN = re.compile(r"<s>(?:\[INST\](.*?)\[/INST\]|<<SYS>>(.*?)<</SYS>>|\[ROLE=(.*?)\n\](.*?)|(.*?))</s>", re.S)
#: Code points that the template puts before an assistant's text.
LEAD = len(OPEN)


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put behind the first sign of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _FIRST, "$0\\\\")


def unescape(text: str) -> str:
    """The text that :func:`escape` has made: each backslash goes, but for one behind another."""
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def rendered(role: Column, text: Column) -> Column:
    """A turn as it stands in a window. Roles other than user, assistant and system are written out, their end marks escaped."""
    t = escape(F.coalesce(text, F.lit("")))
    inner = (
        F.when(role == "user", F.concat(F.lit(USER), t, F.lit(USER_END)))
        .when(role == "system", F.concat(F.lit(SYSTEM), t, F.lit(SYSTEM_END)))
        .when(role == "assistant", t)
        .otherwise(F.concat(F.lit(ROLE), F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n" + ROLE_END), F.lit("\n\\" + ROLE_END)), F.lit("\n" + ROLE_END), t))
    )
    return F.concat(F.lit(OPEN), inner, F.lit(CLOSE))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """role, text of the turns in a window."""
    turns = []
    for user, system, role, other, assistant in (m.groups() for m in _TURN.finditer(formatted)):
        if user is not None:
            turns.append(("user", unescape(user)))
        elif system is not None:
            turns.append(("system", unescape(system)))
        elif role is not None:
            turns.append((unescape(role), unescape(other)))
        else:
            turns.append(("assistant", unescape(assistant)))
    return turns


def spans(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """Spans of turns, in order, whose sizes fit in ``room``; a larger turn has a span of its own."""
    import numpy as np

    ends, at, out = np.cumsum(sizes), 0, []
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + room, side="right")))
        out.append((at, end))
        at = end
    return out


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = tokens.TOKENIZER, ranks: str | None = tokens.RANKS) -> DataFrame:
    """conv_id, part, window, formatted, loss (array of start, end in code points), n_tokens, n_repeated.

    ``turns`` has conv_id, turn, role, text. Rows of a conversation follow turn, then role, then text, nulls
    last; repeated rows are turns of their own. Null texts count as empty; null conv_ids form one
    conversation. Its first row, if a system turn, opens all its windows. (part, window) orders the
    windows of a conversation; the first ``n_repeated`` turns of a window have been in an earlier one. A turn that
    alone exceeds the room is kept whole in a window of its own, over the budget. Empty tables give an empty
    result; other columns are ignored.
    """
    import pyarrow as pa

    spark = turns.sparkSession
    scratch = Scratch(spark, "chat")
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, ranks)
        for batch in batches:
            n = pa.array([len(encode(t)) // 4 for t in batch.column("shown").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=[*batch.schema.names, "n"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, now, k = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            numbers = []
            for conv in batch.column("conv_id").to_pylist():
                if now != (conv,):
                    now, k = (conv,), 0
                numbers.append(k)
                k += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([chunk] * batch.num_rows, pa.int32()), pa.array(numbers, pa.int64())], names=[*batch.schema.names, "chunk", "k"])

    shown = rendered(F.col("role"), F.col("text")).alias("shown")
    counts = turns.select("conv_id", "turn", "role", F.col("text"), shown).mapInArrow(counted, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, text string, shown string, n long")
    counts = scratch.write(counts.select("conv_id", "turn", "role", "text", "n", F.monotonically_increasing_id().alias("salt")))
    order = [F.col("conv_id"), F.col("turn").isNull(), F.col("turn"), F.col("role").isNull(), F.col("role"), F.col("text").isNull()]
    # a text that is all in the range's key is followed by the salt, one that isn't comes after those
    salt = F.when(F.coalesce(F.length("text"), F.lit(0)) <= LEADING, F.col("salt")).otherwise(F.lit(2**63 - 1))
    ranged = counts.repartitionByRange(*order, F.substring("text", 1, LEADING), salt).sortWithinPartitions(*order, "text", "salt")
    ranged = ranged.select("conv_id", "role", shown, "n").mapInArrow(numbered, f"conv_id {kinds['conv_id']}, role {kinds['role']}, shown string, n long, chunk int, k long")
    ranged = scratch.write(ranged)
    scratch.drop(counts)
    # only the first and last conversation of a range go on in another one: at most two rows a range
    cells = ranged.groupBy("conv_id", "chunk").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("conv_id").orderBy("chunk")) - F.col("c")
    cells = cells.select(F.col("conv_id").alias("conv"), F.col("chunk").alias("in"), before.alias("before")).filter("before > 0")
    same = F.col("conv_id").eqNullSafe(F.col("conv"))
    rows = ranged.join(F.broadcast(cells), same & (F.col("chunk") == F.col("in")), "left")
    rows = rows.select("conv_id", "role", "shown", "n", (F.col("k") + F.coalesce("before", F.lit(0))).alias("pos"))
    rows = rows.withColumn("part", F.floor(F.col("pos") / PART).cast("long"))
    system = rows.filter("pos = 0 AND role = 'system'").select(F.col("conv_id").alias("conv"), "role", "shown", "n")
    parts = rows.groupBy("conv_id", "part").agg(F.sum("n").alias("size"))
    opening = parts.filter("part > 0").join(system, same).select("conv_id", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), "role", "shown", "n")
    # each turn has a token at least, so history reaches back over so many parts at most
    far = 1 + history // PART
    later = parts.withColumn("sizes", F.collect_list("size").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(1, far)))
    later = later.filter(F.size("sizes") > 0).select(F.col("conv_id").alias("conv"), F.col("part").alias("this"), "sizes", F.explode(F.sequence(F.lit(1), F.size("sizes"))).alias("step"))
    gap = F.aggregate(F.slice("sizes", 1, F.col("step") - 1), F.lit(0).cast("long"), lambda a, x: a + x)
    later = later.select("conv", "this", (F.col("this") + F.col("step")).alias("to"), gap.alias("gap")).filter(F.col("gap") < history)
    behind = F.sum("n").over(W.partitionBy("conv_id", "part").orderBy(F.desc("pos")))
    late = rows.withColumn("behind", behind).filter(F.col("behind") <= history)
    late = late.join(later, same & (F.col("part") == F.col("this"))).filter(F.col("behind") + F.col("gap") <= history)
    late = late.select("conv_id", F.col("to").alias("part"), F.lit(1).alias("kind"), "pos", "role", "shown", "n")
    own = rows.select("conv_id", "part", F.lit(2).alias("kind"), "pos", "role", "shown", "n")

    def fill(group: pa.Table) -> pa.Table:
        t = group.to_pylist()
        t.sort(key=lambda r: (r["kind"], r["pos"]))
        new = [r for r in t if r["kind"] == 2]
        head = [r for r in t if r["kind"] == 0]
        past = [r for r in t if r["kind"] == 1]
        starts_here = new[0]["pos"] == 0 and new[0]["role"] == "system"
        system = head or (new[:1] if starts_here else [])
        if past and head and past[0]["pos"] == 0:
            past = past[1:]  # the system turn opens the window anyway
        held = sum(r["n"] for r in system)
        out = []
        todo = new[1:] if starts_here and len(new) > 1 else new
        opened = todo is not new
        for k, (a, b) in enumerate(spans([r["n"] for r in todo], max(1, budget - history - held))):
            before, room = [], history
            for r in reversed(past + todo[:a]):
                room -= r["n"]
                if room < 0:
                    break
                before.insert(0, r)
            first = k == 0 and opened
            lead = system if not (starts_here and not opened) else []
            turns_here = lead + before + todo[a:b]
            repeated = 0 if first else len(lead) + len(before)
            at, loss, text = 0, [], []
            for i, r in enumerate(turns_here):
                if i >= repeated and r["role"] == "assistant":
                    loss.append({"start": at + LEAD, "end": at + len(r["shown"]) - len(CLOSE)})
                at += len(r["shown"])
                text.append(r["shown"])
            out.append({"conv_id": new[0]["conv_id"], "part": new[0]["part"], "window": k, "formatted": "".join(text), "loss": loss, "n_tokens": sum(r["n"] for r in turns_here), "n_repeated": repeated})
        return pa.Table.from_pylist(out, schema=shape)

    shape = pa.schema([("conv_id", _arrow(turns, "conv_id")), ("part", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_tokens", pa.int64()), ("n_repeated", pa.int32())])
    return own.unionByName(opening).unionByName(late).groupBy("conv_id", "part").applyInArrow(fill, f"conv_id {kinds['conv_id']}, part long, window int, formatted string, loss array<struct<start:int,end:int>>, n_tokens long, n_repeated int")


def _arrow(df: DataFrame, column: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from windows.

    The windows of a conversation stream by in order; a task holds one of them at a time. Null conv_ids are
    one conversation, as in :func:`windows`. No windows give an empty table.
    """
    import pyarrow as pa

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType.simpleString()
    conv_arrow = _arrow(formatted, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, state = None, None

        def close() -> None:
            done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            types = [conv_arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if now != (r["conv_id"],):
                        if now is not None:
                            close()
                        now, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, text in read_back(r["formatted"])[r["n_repeated"] :]:
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    for span in r["loss"]:
                        text = unescape(r["formatted"][span["start"] : span["end"]])
                        state[2] += len(text)
                        state[3].update(text.encode("utf-8", "surrogatepass"))
                    state[4] += len(r["formatted"])
                if len(done) >= 4096:
                    yield flush()
        if now is not None:
            close()
        if done:
            yield flush()

    ordered = formatted.select("conv_id", "part", "window", "formatted", "loss", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "part", "window")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark, sf_dir):
    """``conversations`` and the added conversation -1, formatted and read back: a row a conversation, of what its windows say. A real conversation -1 is one with it."""
    from galley.session import table

    hard = f"{CLOSE}{USER} ok {USER_END}"
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digests(windows(convs.unionByName(extra)))
