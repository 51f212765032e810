"""A text quality score: a sparse ensemble of rules over text statistics.

Statistics of the whole text are Spark column expressions.  Small trees are
boosted over them; every path from a root to a node is a conjunctive rule;
lasso logistic regression weighs the rules, and most weights become zero.
What is left is compiled into one column expression, so scoring is a narrow
projection without Python.

The model is fitted on the driver from at most ``sample`` labelled rows, those
with the least hash of their id; everything else covers all rows.

Defined results: a null or empty text has zero statistics and gets a score
like any other; rows are scored one by one; labels that are null or name no
document are left out, and of labels that share an id the largest counts;
without labels the score is 0.5, with labels of one kind only it is near that
kind; labels, languages, sources and ids are no input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 12_000


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, each a whole-text Spark expression."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    per = lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    share = lambda pattern: per(F.length(F.regexp_replace(t, pattern, "")).cast("double"))
    lines = F.split(t, "\n")
    words = F.filter(F.split(t, "[ \\t\\n\\r]+"), lambda w: w != "")
    n_words = F.size(words)
    return {
        "chars": F.log1p(n.cast("double")),
        "upper": share("[^\\p{Lu}]+"),
        "symbols": share("[\\p{L}\\p{N}\\s]+"),
        "digits": share("[^0-9]+"),
        "blanks": share("[^\\s]+"),
        "word_length": F.when(n_words > 0, n.cast("double") / n_words).otherwise(F.lit(0.0)),
        "distinct_words": F.when(n_words > 0, F.size(F.array_distinct(words)).cast("double") / n_words).otherwise(F.lit(0.0)),
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double") / F.size(lines),
    }


def with_statistics(docs: DataFrame, text_col: str, prefix: str) -> DataFrame:
    return docs.withColumns({prefix + k: v for k, v in statistics(docs[text_col]).items()})


Condition = tuple[int, bool, float]  # feature, above, cut


@dataclass(frozen=True)
class Model:
    """Rules with weights; the score is the logistic function of their sum."""

    features: tuple[str, ...]
    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, prefix: str = "") -> Column:
        total = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            holds = None
            for k, above, cut in conditions:
                c = F.col(f"`{prefix}{self.features[k]}`")
                one = c > F.lit(float(cut)) if above else c <= F.lit(float(cut))
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _split(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray):
    """The best cut of the rows by gain, or None."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None, None)
    for k, edges in enumerate(cuts):
        if not len(edges):
            continue
        bins = np.searchsorted(edges, x[rows, k], side="left")
        left_g = np.cumsum(np.bincount(bins, g[rows], len(edges) + 1))[:-1]
        left_h = np.cumsum(np.bincount(bins, h[rows], len(edges) + 1))[:-1]
        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
        gain[(left_h < 0.5) | (total_h - left_h < 0.5)] = 0
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (float(gain[i]), k, float(edges[i]))
    return best[1:] if best[1] is not None else None


def tree_paths(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 64) -> list[tuple[Condition, ...]]:
    """Paths to all nodes of boosted trees, as conjunctions; each only once."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    raw = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    paths: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        todo = [((), np.arange(len(y)), 0)]
        while todo:
            path, rows, level = todo.pop()
            cut = _split(x, cuts, g, h, rows) if level < depth and len(rows) >= 20 else None
            if path:
                paths.setdefault(tuple(sorted(path)))
            if cut is None:
                raw[rows] += 0.3 * g[rows].sum() / (h[rows].sum() + 1)
                continue
            k, edge = cut
            above = x[rows, k] > edge
            todo.append(((*path, (k, True, edge)), rows[above], level + 1))
            todo.append(((*path, (k, False, edge)), rows[~above], level + 1))
    return list(paths)


def holds(x: np.ndarray, paths) -> np.ndarray:
    """One column a rule: 1 where it holds."""
    out = np.ones((len(x), len(paths)))
    for j, path in enumerate(paths):
        for k, above, cut in path:
            out[:, j] *= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient steps."""
    n, k = r.shape
    step = 4.0 / max(1e-9, np.linalg.norm(np.hstack([np.ones((n, 1)), r]), 2) ** 2 / n)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(r @ v + c)))
        d = (p - y) / n
        new = v - step * (r.T @ d)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * d.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, features: list[str], penalty: float = 5e-4) -> Model:
    """The rule ensemble for statistics ``x`` and labels ``y`` (0 or 1)."""
    if not len(y):
        return Model(tuple(features), 0.0, ())
    if y.min() == y.max():
        return Model(tuple(features), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    paths = tree_paths(x, y)
    bias, weights = lasso_logistic(holds(x, paths), y, penalty)
    return Model(tuple(features), bias, tuple((p, float(w)) for p, w in zip(paths, weights) if abs(w) > 1e-4))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` of the labelled ids, those of least hash, a row each."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    # at most ``sample`` short rows are broadcast
    rows = with_statistics(texts.join(F.broadcast(chosen), "id"), "t", "s_").withColumn("h", F.xxhash64("t")).drop("t")
    names = list(statistics(F.lit("")))
    # of rows that share an id the one with the least hash of its text: what is learnt does not depend on their order
    one = rows.groupBy("id").agg(F.min(F.struct("h", "y", *(f"s_{k}" for k in names))).alias("r"))
    found = one.select(F.col("id").cast("string").alias("id"), "r.*").toPandas().sort_values("id")
    return fit_rules(found[[f"s_{k}" for k in names]].to_numpy(float), found["y"].to_numpy(float), names)


def scored(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "_stat_", score: str = "score") -> DataFrame:
    """The documents with their statistics (``prefix``) and a score from 0 to 1.

    A column that has the name of the score already is replaced.
    """
    return with_statistics(docs, text_col, prefix).withColumn(score, model.score(prefix))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents with at least that score, their columns unchanged."""
    # Spark would move the filter below the statistics and so compute them anew for
    # every rule; next to a column that is not deterministic it leaves them be
    prefix = "_stat_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    rows = with_statistics(docs, text_col, prefix).withColumn(f"{prefix}row", F.monotonically_increasing_id())
    kept = rows.filter((model.score(prefix) >= threshold) & (F.col(f"{prefix}row") >= 0))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
