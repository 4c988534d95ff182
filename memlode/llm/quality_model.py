"""Quality classifier: a sparse rule ensemble compiled to column expressions.

Shallow boosted trees over text statistics are cut into their paths; every path is a conjunctive rule.
An L1-penalised logistic regression weighs the rules and drops most of them.  What is left becomes one
Spark column, so scoring is a map over the documents without Python.

Only the fit sees labels, and only a bounded sample of them (``sample`` labelled documents, chosen by
a hash of the id): the driver gets that many rows of a dozen numbers, however large the tables are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlode.llm.common import crc_bucket, documents, words
from memlode.session import table

SAMPLE = 20_000
TREES, DEPTH, BINS = 40, 3, 48
RATE, L1 = 0.3, 0.0015
SEED = 5

Rule = tuple[tuple[int, bool, float], ...]  #: (feature, is above, threshold), all of which must hold


def features(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; all 0 for null or wordless text.  Expects the words in column ``q_words``."""
    def per(pattern: str, of: Column) -> Column:
        return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)) / F.greatest(of, F.lit(1))

    n, chars = F.size("q_words"), F.coalesce(F.length(text), F.lit(0))
    distinct = F.size(F.array_distinct("q_words"))
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return {
        "q_len": F.log1p(chars.cast("double")),
        "q_word_len": F.length(F.array_join("q_words", "")) / F.greatest(n, F.lit(1)),
        "q_symbol": per("[#*$%&|<>=_~^{}\\[\\]\\\\]", chars),
        "q_upper": per("\\p{Lu}", chars),
        "q_shout": per("[!?]", chars),
        "q_stop": per("[.,;:]", n),
        "q_digit": per("[0-9]", chars),
        "q_unique": distinct / F.greatest(n, F.lit(1)),
        "q_guiraud": distinct / F.sqrt(F.greatest(n, F.lit(1)).cast("double")),
        "q_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "q_line_len": n / F.size(lines),
    }


NAMES = ["q_len", "q_word_len", "q_symbol", "q_upper", "q_shout", "q_stop", "q_digit", "q_unique", "q_guiraud", "q_lines", "q_line_len"]


def with_features(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (in struct ``q_row``) and the features.

    The features pass through a one-element explode: no optimizer rule moves a condition on the score
    below it, which would compute every feature anew in every rule.
    """
    own = docs.select(F.struct("*").alias("q_row"), words(docs["text"]).alias("q_words"))
    row = F.struct(*[c.alias(k) for k, c in features(F.col("q_row.text")).items()])
    return own.select("q_row", F.explode(F.array(row)).alias("q_f")).select("q_row", "q_f.*")


@dataclass
class RuleModel:
    """Rules with weights and a bias; score() is the probability of label 1."""

    bias: float
    rules: list[tuple[Rule, float]]

    def column(self, f: list[Column]) -> Column:
        z = F.lit(self.bias)
        for rule, w in self.rules:
            cond = F.lit(True)
            for k, above, t in rule:
                cond = cond & (f[k] > t if above else f[k] <= t)
            z = z + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in self.rules:
            z += w * holds(rule, x)
        return 1 / (1 + np.exp(-z))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in rule:
        out &= x[:, k] > t if above else x[:, k] <= t
    return out


def _grow(binned: np.ndarray, cuts: list[np.ndarray], r: np.ndarray, rows: np.ndarray, feats: np.ndarray, depth: int, path: Rule, out: list) -> list[tuple[np.ndarray, float]]:
    """Least-squares tree on residuals; adds each node's path to ``out`` and returns the leaves (rows, mean)."""
    best = (1e-9, None)
    total, n = r[rows].sum(), len(rows)
    for k in feats if depth and n >= 20 else ():
        s = np.bincount(binned[rows, k], r[rows], BINS + 1).cumsum()[: len(cuts[k])]
        c = np.bincount(binned[rows, k], minlength=BINS + 1).cumsum()[: len(cuts[k])]
        ok = (c >= 5) & (n - c >= 5)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1) - total**2 / n, 0)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], (k, j))
    if best[1] is None:
        return [(rows, total / max(n, 1))]
    k, j = best[1]
    left = binned[rows, k] <= j
    leaves = []
    for above, part in ((False, rows[left]), (True, rows[~left])):
        own = (*path, (int(k), above, float(cuts[k][j])))
        out.append(own)
        leaves += _grow(binned, cuts, r, part, feats, depth - 1, own, out)
    return leaves


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, l1: float = L1, seed: int = SEED) -> RuleModel:
    """Fits rules and weights; without both classes the score is constant (no rows: 0.5)."""
    n = len(y)
    if not n or y.min() == y.max():
        p = (y.sum() + 1) / (n + 2)
        return RuleModel(float(np.log(p / (1 - p))), [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    z = np.full(n, np.log(y.mean() / (1 - y.mean())))
    paths: list[Rule] = []
    for _ in range(trees):
        r = y - 1 / (1 + np.exp(-z))
        rows = rng.permutation(n)[: max(min(n, 40), n // 2)]
        feats = rng.permutation(x.shape[1])[: max(3, 2 * x.shape[1] // 3)]
        grown: list[Rule] = []
        _grow(binned, cuts, r, rows, feats, depth, (), grown)
        paths += grown
        for rule in grown:
            if len(rule) == depth or not any(g[: len(rule)] == rule and len(g) > len(rule) for g in grown):
                at = holds(rule, x)
                if at.any():
                    p = 1 / (1 + np.exp(-z[at]))
                    z[at] += RATE * np.clip((y[at] - p).sum() / max((p * (1 - p)).sum(), 1e-3), -4, 4)
    rules = sorted({tuple(sorted(p)) for p in paths})
    seen, cols, kept = set(), [], []
    for rule in rules:
        h = holds(rule, x)
        mark = h.tobytes() if h[0] else (~h).tobytes()
        if 0.002 * n <= h.sum() <= 0.998 * n and hash(mark) not in seen:
            seen.add(hash(mark)), cols.append(h), kept.append(rule)
    if not cols:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), [])
    bias, w = lasso_logistic(np.stack(cols, axis=1).astype(np.float32), y, l1)
    return RuleModel(bias, [(rule, float(v)) for rule, v in zip(kept, w) if abs(v) > 1e-4])


def lasso_logistic(h: np.ndarray, y: np.ndarray, l1: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for mean logistic loss + l1 * |w|; the bias is free."""
    n, m = h.shape
    step = 4 / (float(np.linalg.norm(h.astype(np.float64).T @ h / n, 2)) + 1)
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(h @ vw + vb))) - y
        nw = vw - step * (h.T @ g / n)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nb = vb - step * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b), w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Learns from labelled documents outside the held-out third (crc32(doc_id) mod 3 = 1).

    Repeated or contradicting labels of a document count as their mean, rounded up at a half.
    """
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), 3) != 1))
    own = own.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("q_label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(own.withColumnRenamed("doc_id", "q_id")), F.col("doc_id") == F.col("q_id"))
    rows = with_features(joined).groupBy("q_row.doc_id").agg(F.first("q_row.q_label").alias("y"), *[F.max(c).alias(c) for c in NAMES])
    got = rows.select("y", *NAMES).toPandas().to_numpy(float)
    got = got[np.lexsort(got.T[::-1])]  # at most ``sample`` rows: the driver orders them, no shuffle
    return fit(got[:, 1:], got[:, 0]) if len(got) else fit(np.zeros((0, len(NAMES))), np.zeros(0))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` (as struct q_row) with score and predicted; every row is scored, null text as empty."""
    # inside a lambda the rules are walked as a tree: generated as one method they exceed what the JVM compiles
    row = F.array(F.struct(*NAMES))
    value = F.element_at(F.transform(row, lambda f: model.column([f[c] for c in NAMES])), 1)
    out = with_features(docs).select("q_row", value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    return score(docs, train(docs, labels)).where("predicted = 1").select("q_row.*")


def op3_quality_classifier(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("q_row.doc_id", (crc_bucket(F.col("q_row.doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
