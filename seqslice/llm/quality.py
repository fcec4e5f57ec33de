"""Operator 10, quality classifier: a sparse rule ensemble over text statistics.

Small boosted trees are grown on a bounded sample of labelled documents (``sample_rows``, those with the smallest hashes of
doc_id); every path to a node becomes a conjunctive rule, a lasso logistic regression weighs the rules, and those with a
weight are compiled into one Spark Column expression, which scores every document without Python on the executors.

Inputs are statistics of the whole text and nothing else. Nulls: a null text counts as empty; empty texts get the score of
their statistics. doc_ids that are null count as held out with no label. Ties between splits go to the first statistic and
threshold. With no labels, or one class only, the score is the prior. Repeated rows get equal scores; extra columns are
kept by keep_good(), and ignored otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

THRESHOLD = 0.3


def statistics(docs: DataFrame, **more: Column) -> DataFrame:
    """x0, x1, ..., one per name of STATISTICS, and the columns of more; no other columns of docs."""
    d = docs.select(*[c.alias(k) for k, c in more.items()], F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.split(F.trim(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", " ")), " "))
    d = d.withColumn("_lines", F.split("_t", "\n"))
    for k, c in enumerate(_columns()):
        d = d.withColumn(f"x{k}", c.cast("double"))
    return d.drop("_t", "_w", "_lines")


def _share(pattern: str) -> Column:
    return F.regexp_count(F.col("_t"), F.lit(pattern)) / F.greatest(F.length("_t"), F.lit(1))


#: The statistics that scores are made of, in the order of _columns().
STATISTICS = ["characters", "words", "characters_per_word", "upper_share", "digit_share", "symbol_share", "bar_share", "exclamation_share", "stop_share", "distinct_words", "repeated_next", "distinct_lines", "words_per_line", "longest_word"]


def _columns() -> list[Column]:
    _n = F.size("_w")
    return [
        F.length("_t"),  # characters
        _n,  # words
        F.length("_t") / _n,  # characters_per_word
        _share(r"\p{Lu}"),  # upper_share
        _share("[0-9]"),  # digit_share
        _share(r"[#$%&*+=<>{}\\^~_@/]"),  # symbol_share
        _share(r"\|"),  # bar_share
        _share("[!?]"),  # exclamation_share
        _share("[.,;:]"),  # stop_share
        F.size(F.array_distinct("_w")) / _n,  # distinct_words
        F.size(F.filter(F.zip_with(F.slice("_w", F.lit(1), _n - 1), F.slice("_w", F.lit(2), _n), lambda a, b: a == b), lambda x: x)) / _n,  # repeated_next
        F.size(F.array_distinct("_lines")) / F.size("_lines"),  # distinct_lines
        _n / F.size("_lines"),  # words_per_line
        F.array_max(F.transform("_w", lambda w: F.length(w))),  # longest_word
    ]


@dataclass
class Rule:
    """A conjunction of (statistic, is at most, threshold) and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [(F.col(f"x{k}") <= v) if le else (F.col(f"x{k}") > v) for k, le, v in self.terms])

    def of(self, x):
        import numpy as np

        return reduce(np.logical_and, [(x[:, k] <= v) if le else (x[:, k] > v) for k, le, v in self.terms])


@dataclass
class Model:
    bias: float
    rules: list[Rule] = field(default_factory=list)

    def score(self) -> Column:
        z = F.lit(float(self.bias))
        for r in self.rules:
            z = z + F.when(r.column(), F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def grow(x, y, trees: int = 40, depth: int = 3, bins: int = 48, rate: float = 0.3, least: int = 15) -> list[Rule]:
    """Rules of all nodes of trees boosted on the logistic loss."""
    import numpy as np

    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(m)]
    code = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
    f, rules = np.full(n, np.log(y.mean() / (1 - y.mean()))), {}
    rng = np.random.default_rng(11)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        allowed = np.sort(rng.choice(m, max(2, 2 * m // 3), replace=False))

        def node(rows, terms, left, g=g, h=h, allowed=allowed):
            if terms:
                rules.setdefault(terms, Rule(terms))
            best = (1e-6, None)
            if left and len(rows) >= 2 * least:
                gt, ht = g[rows].sum(), h[rows].sum()
                for k in allowed:
                    if not len(cuts[k]):
                        continue
                    c, b = code[rows, k], len(cuts[k]) + 1
                    gs, hs, ns = (np.cumsum(np.bincount(c, w, b))[:-1] for w in (g[rows], h[rows], None))
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(ns < least) | (len(rows) - ns < least)] = -1
                    if gain.max() > best[0]:
                        best = (gain.max(), (k, int(gain.argmax())))
            if best[1] is None:
                f[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
                return
            k, at = best[1]
            v, low = float(cuts[k][at]), code[rows, k] <= at
            node(rows[low], (*terms, (int(k), True, v)), left - 1)
            node(rows[~low], (*terms, (int(k), False, v)), left - 1)

        node(np.arange(n), (), depth)
    return list(rules.values())


def lasso(a, y, penalty: float, steps: int = 400):
    """Bias and weights of a logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    import numpy as np

    n, m = a.shape
    scale = a.std(0)
    a = (a - a.mean(0)) / np.where(scale > 0, scale, 1)
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    vw, vb, t = w.copy(), b, 1.0
    v = np.ones(m)
    for _ in range(30):
        v = a.T @ (a @ v)
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-12)
    step = 4 * n / max(norm, n)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ vw + vb))) - y
        nw = vw - step * (a.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * r.mean()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b, scale


def fit(x, y, penalty: float = 0.0005) -> Model:
    import numpy as np

    if not len(y):
        return Model(0.0)
    if y.min() == y.max():
        return Model(4.0 if y[0] else -4.0)
    rules = grow(x, y)
    if not rules:
        return Model(float(np.log(y.mean() / (1 - y.mean()))))
    a = np.stack([r.of(x) for r in rules], 1).astype("float64")
    mean = a.mean(0)
    w, b, scale = lasso(a, y, penalty)
    w = np.where(scale > 0, w / np.where(scale > 0, scale, 1), 0)
    kept = [Rule(r.terms, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6]
    return Model(float(b - (w * mean).sum()), kept)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000) -> Model:
    """A model from the labelled rows whose crc32(doc_id as text) mod 5 is not 0: sample_rows doc_ids at most, and twice as
    many rows of them where doc_ids repeat (those with the smallest hashes)."""
    import numpy as np

    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # sample_rows bounds this side: two numbers a row
    d = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    d = statistics(d, y=F.col("y"), place=F.xxhash64("doc_id", "text"))
    rows = d.select("y", *[f"x{k}" for k in range(len(STATISTICS))], "place").orderBy("place").limit(2 * sample_rows).collect()
    x = np.array([r[1:-1] for r in rows], dtype="float64").reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r[0] for r in rows], dtype="float64"))


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): docs' rows as structs, whatever their columns are called, and their scores."""
    return statistics(docs, row=F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("row", model.score().alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects."""
    return scored(docs, train(docs, labels)).where(F.col("score") >= THRESHOLD).select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return d.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
