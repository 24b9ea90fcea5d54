"""Toxicity scores of texts that a noisy channel restores first.

Writers hide words by leetspeak (1d10t), by separators (i d i o t, i.d.i.o.t) and by repetition
(idiooot). Each suspicious span becomes a lattice: a leet sign may be itself or a letter it stands
for, a separator may be a space or nothing, a run of one letter may be one or two. A character trigram
model of the whole corpus scores the paths, Viterbi search takes the best, and the restored text is
scored by a logistic model of word and word-start features.

Everything the language model knows is counted over all documents. Labels are learned from at most
``MAX_TRAIN`` labelled rows (those with the smallest hashes of their ids).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.common import Scratch

MAX_TRAIN = 8000
N_FEATURES = 1024
#: Symbols of the language model: boundary, a-z, other letter, digit, sign.
SYMBOLS = 30
OTHER, DIGIT, SIGN = 27, 28, 29
#: Letters that a sign may stand for (fixed values).
LEET = {
    "4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "€": "e", "6": "g", "9": "g", "1": "il", "!": "i", "|": "il",
    "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z", "*": "abcdefghijklmnopqrstuvwxyz",
}
#: Stars that may hide letters in one span; in a span with more, a star is a star.
STARS = 4
#: Costs, in nats, of the channel's steps.
LEET_COST, ANY_COST, DROP_COST, REPEAT_COST = 0.7, 2.0, 0.4, 0.2

_SIGNS = re.escape("".join(LEET))
_HAS_SIGN = re.compile(f"[{_SIGNS}]")
_LEET_WORD = re.compile(rf"(?<!\S)\S*?[A-Za-z]\S*")
_RUN = re.compile(r"([A-Za-z])\1\1")
_RUN_WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]*([A-Za-z])\1\1[^\W\d_]*")
_SPACED = re.compile(rf"(?<![^\s])[A-Za-z{_SIGNS}](?:[ ._\-/][A-Za-z{_SIGNS}]){{2,}}(?![\w])")
_EDGE = ".,;:?\"')]}>…»”’"
_STRIP = ".,;:!?\"'()[]{}<>*%&#$@|~^=+-_/\\…«»“”’"


def _symbol_table():
    import numpy as np

    table = np.full(65536, SIGN, np.uint8)
    for code in range(65536):
        c = chr(code)
        if c.isspace() or c in ".,;:?!\"'()[]{}-_/":
            table[code] = 0
        elif c.isdigit():
            table[code] = DIGIT
        elif c.isalpha():
            low = c.lower()
            table[code] = ord(low) - 96 if len(low) == 1 and "a" <= low <= "z" else OTHER
    return table


def trigram_counts(docs: DataFrame) -> DataFrame:
    """gram, n: counts of symbol trigrams over all texts, at most SYMBOLS ** 3 rows."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = _symbol_table()
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for at in range(0, len(text or ""), 1 << 18):
                    piece = text[max(0, at - 2) : at + (1 << 18)]
                    codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
                    s = table[np.minimum(codes, 65535)].astype(np.int64)
                    if at == 0:
                        s = np.concatenate([[0, 0], s])
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int32()), pa.array(total[grams], pa.int64())], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def log_model(counts: DataFrame) -> list[float]:
    """Natural logs of P(c | a, b) for a, b, c in order, interpolated with shorter contexts."""
    import numpy as np

    rows = counts.collect()  # at most SYMBOLS ** 3
    n = np.zeros(SYMBOLS**3)
    for gram, count in rows:
        n[gram] = count
    n3 = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
    p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
    p3 = (n3 + 5 * p2[None]) / (n3.sum(2, keepdims=True) + 5)
    return np.log(p3).ravel().tolist()


class Restorer:
    """Viterbi decoding of suspicious spans under a character model."""

    def __init__(self, model: list[float]) -> None:
        self.model = model
        self.table = _symbol_table()
        self.known: dict[tuple[str, bool], str] = {}

    def symbol(self, c: str) -> int:
        return int(self.table[min(ord(c), 65535)])

    def lattice(self, span: str, spaced: bool) -> list[list[tuple[str, int, float]]]:
        """For each character the (output, symbol, cost) it may stand for; '' is nothing."""
        out, run = [], 0
        masks = span.count("*") <= STARS
        for k, c in enumerate(span):
            run = run + 1 if k and span[k - 1] == c else 0
            ways = [(c, self.symbol(c), 0.0)]
            if c in LEET and (masks or c != "*"):
                cost = ANY_COST if len(LEET[c]) > 2 else LEET_COST
                ways += [(x, ord(x) - 96, cost) for x in LEET[c]]
            elif spaced and c in " ._-/":
                ways.append(("", -1, DROP_COST))
            elif c.isalpha() and run >= 1 and (run >= 2 or span[k + 1 : k + 2] == c):
                ways = [("", -1, REPEAT_COST)] + (ways if run == 1 else [])
            out.append(ways)
        return out

    def decode(self, span: str, spaced: bool) -> str:
        found = self.known.get((span, spaced))
        if found is not None:
            return found
        model = self.model
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for ways in [*self.lattice(span.lower(), spaced), [(" ", 0, 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in best.items():
                for text, symbol, price in ways:
                    if symbol < 0:
                        state, total, way = (a, b), cost + price, path
                    else:
                        state, total, way = (b, symbol), cost + price - model[(a * SYMBOLS + b) * SYMBOLS + symbol], (path, text)
                    if state not in after or total < after[state][0]:
                        after[state] = (total, way)
            best = after
        path, out = min(best.values(), key=lambda x: x[0])[1], []
        while path:
            path, text = path
            out.append(text)
        result = "".join(out[:0:-1])
        if len(span) <= 40:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[(span, spaced)] = result
        return result

    def _word(self, match: re.Match) -> str:
        word = match.group()
        if not _HAS_SIGN.search(word):
            return word
        core = word.rstrip(_EDGE)
        tail = word[len(core) :]
        trimmed = core.rstrip("!*%&#$|+")  # signs at the end are emphasis, one of them at most a letter
        extra = core[len(trimmed) :]
        if len(extra) == 1 and extra in "$!":
            trimmed, extra = core, ""
        if not _HAS_SIGN.search(trimmed):
            return word
        return self.decode(trimmed, False) + extra + tail

    def __call__(self, text: str) -> str:
        """The text with each suspicious span as decoded, in lower case."""
        if _SPACED.search(text):
            text = _SPACED.sub(lambda m: self.decode(m.group(), True), text)
        if _HAS_SIGN.search(text):
            text = _LEET_WORD.sub(self._word, text)
        if _RUN.search(text):
            text = _RUN_WORD.sub(lambda m: self.decode(m.group(), False), text)
        return text


def features(text: str) -> set[str]:
    """Words and word starts of a restored text."""
    found = {w.strip(_STRIP) for w in set(text.lower().split())}
    return found | {f"{w[:4]}~" for w in found if len(w) > 4} | {f"{w[:5]}~" for w in found if len(w) > 5}


class Scorer:
    """Logistic score of restored texts; with no features it is the prior."""

    def __init__(self, model: list[float], weights: dict[str, float], bias: float) -> None:
        self.restore = Restorer(model)
        self.weights, self.bias = weights, bias
        self.names = set(weights)

    def __call__(self, text: str | None) -> float:
        z = self.bias
        if text and self.names:
            z += sum(sorted(self.weights[f] for f in self.names & features(self.restore(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(rows: list[tuple[int, list[int]]], width: int) -> tuple[list[float], float]:
    """L2-regularised logistic regression by gradient steps with momentum.

    A feature's step is one over a bound of its curvature, so that rare words learn as fast as common ones.
    """
    import numpy as np

    y = np.array([r[0] for r in rows], np.float32)
    x = np.zeros((len(rows), width + 1), np.float32)
    x[:, -1] = 1
    for k, (_, hits) in enumerate(rows):
        x[k, hits] = 1
    penalty = np.full(width + 1, 2e-5, np.float32)
    penalty[-1] = 0
    bound = 0.25 * (x.T @ x.sum(1)) / len(y) + penalty + 1e-9
    w, v = np.zeros(width + 1, np.float32), np.zeros(width + 1, np.float32)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = 0.9 * v - (x.T @ (p - y) / len(y) + penalty * w) / bound
        w = w + v
    return w[:-1].tolist(), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, n_features: int = N_FEATURES) -> Scorer:
    """A scorer from ``labels`` (doc_id, toxic), learned from at most ``max_train`` rows.

    Labels that are null, or whose doc_id has no document, teach nothing. Of rows that share a labelled
    doc_id one teaches, that with the smallest hash and text, so no more rows than ids reach the driver. A
    feature needs three uses at least; of those the ``n_features`` most telling are kept. Without both labels
    the score is the smoothed share of label 1 for every text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxic")
    model = log_model(trigram_counts(docs))
    chosen = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = labelled.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t"))
    sample = scratch.write(one.select((F.col("toxic") > 0).cast("int").alias("y"), "t.text"))
    shares = sample.agg(F.count("*"), F.sum("y")).first()
    n, positive = shares[0], shares[1] or 0
    if not 0 < positive < n:
        return Scorer(model, {}, math.log((positive + 0.5) / (n - positive + 0.5)))

    def seen(batches):
        import pandas as pd

        restore = Restorer(model)
        for batch in batches:
            pos: dict[str, list[int]] = {}
            for y, text in zip(batch["y"], batch["text"], strict=True):
                for f in features(restore(text or "")):
                    pos.setdefault(f, [0, 0])[y] += 1
            yield pd.DataFrame({"feature": list(pos), "n0": [v[0] for v in pos.values()], "n1": [v[1] for v in pos.values()]})

    counts = sample.mapInPandas(seen, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    expected = (F.col("n0") + F.col("n1")) * (positive / n)
    counts = counts.filter((F.col("n0") + F.col("n1") >= 3) & (F.length("feature") > 1))
    gain = (F.col("n1") - expected) * F.abs(F.col("n1") - expected) / (expected + 0.5)
    names = [r[0] for r in counts.orderBy(gain.desc(), "feature").limit(n_features).collect()]
    place = {f: k for k, f in enumerate(names)}

    def marked(batches):
        import pandas as pd

        restore = Restorer(model)
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "hits": [sorted(place[f] for f in features(restore(t or "")) & place.keys()) for t in batch["text"]]})

    rows = [(r[0], list(r[1])) for r in sample.mapInPandas(marked, "y int, hits array<int>").collect()]  # at most max_train
    rows.sort()
    scratch.drop(sample)
    weights, bias = _fit(rows, len(names))
    return Scorer(model, dict(zip(names, weights, strict=True)), bias)


def scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score of each row's whole text; null and empty texts score as a text without features.

    Rows that repeat are scored one by one. An empty table gives an empty result; other columns, labels,
    lang and source among them, are ignored.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([scorer(t) for t in batch.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double")


def restored(docs: DataFrame, model: list[float]) -> DataFrame:
    """doc_id, restored: the texts as the scorer reads them."""
    import pandas as pd

    def run(batches):
        restore = Restorer(model)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "restored": [None if t is None else restore(t) for t in batch["text"]]})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, restored string")


def query(spark, sf_dir):
    """One row per document of ``documents``: its score, learned from the labels outside the held-out fifth."""
    from galley.session import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    found = scores(docs, fit(docs, labels.filter(part != 0)))
    return found.select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
