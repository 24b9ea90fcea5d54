"""Quality scores by a sparse rule ensemble.

Boosted shallow trees are fitted to statistics of labelled texts. Each path from a root to a node is a
conjunctive rule; lasso logistic regression keeps few of them with a weight. The kept rules become
Spark column expressions over statistics that are column expressions too, so scoring is one
projection in the JVM without Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.common import column, words

#: Labelled rows that a fit collects at most (those with the smallest hashes of their ids).
MAX_TRAIN = 12_000
TREES, DEPTH, BINS = 40, 3, 32
RATE = 0.3
#: Weight of the lasso's penalty, as a share of the smallest that clears every rule.
PENALTY = 0.01

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KINDS = {"upper": _UPPER, "digit": "0123456789", "sign": "#$%&*+=@^~`\\<>", "mark": "!?", "table": "|{}[]_/\t", "stop": ".,;:", "line": "\n"}


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and one double column a statistic of ``text``, prefixed ``s_``; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, text.alias("_t"), words(text).alias("_w"))
    base = base.select(*keep, "_t", "_w", F.length("_t").alias("_n"), F.size("_w").alias("_k"), F.size(F.array_distinct("_w")).alias("_d"))
    n, k = F.greatest(F.col("_n"), F.lit(1)), F.greatest(F.col("_k"), F.lit(1))
    columns = {f"s_{name}": (F.col("_n") - F.length(F.translate("_t", chars, ""))) / n for name, chars in _KINDS.items()}
    lines = F.filter(F.split("_t", "\n"), lambda x: x != "")
    columns |= {
        "s_chars": F.col("_n").cast("double"),
        "s_words": F.col("_k").cast("double"),
        "s_word_length": F.col("_n") / k,
        "s_distinct": F.col("_d") / k,
        "s_distinct_scaled": F.col("_d") / F.pow(k.cast("double"), F.lit(0.8)),
        "s_line_copies": 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "s_line_length": F.col("_n") / F.greatest(F.size(lines), F.lit(1)),
        "s_again": F.size(F.filter(F.zip_with(F.col("_w"), F.slice("_w", 2, 1 << 30), lambda a, b: a == b), lambda same: same)) / k,
    }
    return base.select(*keep, *[c.cast("double").alias(name) for name, c in columns.items()])


def _best_split(codes, residual, rows, features):
    import numpy as np

    best = (1e-9, None, None)
    r = residual[rows]
    whole = r.sum() ** 2 / len(rows)
    for f in features:
        c = codes[rows, f]
        n = np.bincount(c, minlength=BINS).cumsum()[:-1]
        s = np.bincount(c, weights=r, minlength=BINS).cumsum()[:-1]
        ok = (n >= 5) & (len(rows) - n >= 5)
        if not ok.any():
            continue
        gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - whole, -1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    return best[1:]


def tree_rules(x, y, seed: int = 5) -> list[tuple[tuple[int, bool, float], ...]]:
    """The paths of boosted trees as tuples of (feature, above, threshold)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z = np.full(len(y), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    rules: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        residual = y - p
        features = rng.permutation(x.shape[1])[: max(2, x.shape[1] * 2 // 3)]
        nodes = [((), np.arange(len(y)))]
        for _ in range(DEPTH):
            grown = []
            for path, rows in nodes:
                f, k = _best_split(codes, residual, rows, features) if len(rows) >= 10 else (None, None)
                if f is None or k >= len(edges[f]):
                    grown.append((path, rows))
                    continue
                for above in (False, True):
                    child = (*path, (int(f), above, float(edges[f][k])))
                    rules.setdefault(tuple(sorted(child)))
                    grown.append((child, rows[(codes[rows, f] > k) == above]))
            nodes = grown
        for _, rows in nodes:
            if len(rows):
                z[rows] += RATE * residual[rows].sum() / max(1e-3, (p[rows] * (1 - p[rows])).sum() + 1)
    return list(rules)


def _holds(x, rule):
    import numpy as np

    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) == above
    return out


def lasso(x, y, penalty: float, steps: int = 600):
    """Weights and bias of L1-regularised logistic regression by accelerated proximal steps."""
    import numpy as np

    mean = x.mean(0)
    centred = x - mean
    rate = 1 / (0.25 * max(1e-6, np.linalg.norm(centred, 2) ** 2 / len(y)) + 0.25)
    strongest = np.abs(centred.T @ (y - y.mean()) / len(y)).max(initial=0)
    limit = penalty * strongest * rate
    w, b, v, c, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(centred @ v + c, -30, 30))) - y
        new = v - rate * (centred.T @ g) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - limit, 0)
        new_b, new_t = c - rate * g.mean(), (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return w, float(b - mean @ w)


class RuleModel:
    """Weighted conjunctive rules over named statistics."""

    def __init__(self, names: list[str], rules: list[tuple], weights: list[float], bias: float) -> None:
        self.names, self.rules, self.weights, self.bias = names, rules, weights, bias

    def score(self) -> Column:
        """The score as a column over the statistics' columns."""
        z = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for f, above, t in rule:
                test &= (F.col(self.names[f]) > t) if above else (F.col(self.names[f]) <= t)
            z += F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))

    def __str__(self) -> str:
        say = lambda rule: " and ".join(f"{self.names[f][2:]} {'>' if above else '<='} {t:.4g}" for f, above, t in rule)
        return "\n".join(f"{w:+.3f} if {say(r)}" for r, w in zip(self.rules, self.weights, strict=True))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> RuleModel:
    """A model from ``labels`` (doc_id, quality), learned from at most ``max_train`` rows.

    Null labels and labels without a document teach nothing. Of rows that share a labelled doc_id one
    teaches, that with the smallest statistics, so no more rows than ids reach the driver. Without both
    labels there are no rules and the score is the smoothed share of label 1.
    """
    import numpy as np

    chosen = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    stats = with_statistics(sample, "doc_id", "quality")
    names = [c for c in stats.columns if c.startswith("s_")]
    one = stats.groupBy("doc_id", "quality").agg(F.min(F.struct(*names)).alias("s"))
    rows = one.select("doc_id", "quality", "s.*").toPandas()  # at most max_train rows of numbers
    rows = rows.sort_values(["doc_id", *names])
    x, y = rows[names].to_numpy(float), (rows["quality"].to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return RuleModel(names, [], [], math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    rules = tree_rules(x, y)
    marks = np.stack([_holds(x, r) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    weights, bias = lasso(marks, y, PENALTY)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel(names, [rules[k] for k in kept], weights[kept].tolist(), bias)


def scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, score of each row's whole text; null texts score as empty ones.

    Rows that repeat are scored one by one. An empty table gives an empty result; other columns are
    ignored.
    """
    return with_statistics(docs, "doc_id").select("doc_id", model.score().alias("score"))


def reject_low(docs: DataFrame, model: RuleModel, least: float = 0.5) -> DataFrame:
    """``docs`` with a score of at least ``least``, in one projection over the scan.

    Null texts score as empty ones; repeated rows are judged one by one. All columns come back, whatever
    their names and types; an empty table gives an empty result.
    """
    packed = docs.select("text", F.struct(*map(column, docs.columns)).alias("_row"))
    kept = with_statistics(packed, "_row").filter(model.score() >= least)
    return kept.select("_row.*")


def query(spark, sf_dir):
    """One row per document of ``documents``: its score, learned from the labels outside the held-out third."""
    from galley.session import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    found = scores(docs, fit(docs, labels.filter(part != 1)))
    return found.select("doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
