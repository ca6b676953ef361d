"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions.

Boosted trees of depth three are fitted to labelled documents' statistics (ratios of the counts in ``measures``). Every path from a
root, to an inner node or a leaf, becomes a rule: a conjunction of bounds on statistics. A logistic model with a lasso penalty over
all rules keeps few of them; its penalty is the largest whose held-out loss lies within a percent of the best. Rules with a weight are
compiled into one Spark expression, so that scoring runs in the JVM on the stored counts.

At most ``SAMPLE`` labelled documents are used, those with the smallest hash of id, label and statistics, so that the rows of an id that
repeats are drawn each on its own. A fifth is held out; on it the threshold is
set: the highest, up to one half, at which ``KEEP`` of the good documents are kept.

Defined results: a null text is an empty one; labels that are null, or whose document isn't there, are ignored; a document with
several labels counts as often; without labels of both classes nothing is fitted, probability is null and every document is kept;
rows without doc_id and repeated rows get a row each; an empty table gives none; a very long text is counted whole; other columns are ignored.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import boosting
from graphloom.session import stored
from graphloom.llm.measures import measured

SAMPLE = 20_000
KEEP = 0.998
#: Statistics by name, each a part of something: (counts to add up, counts to divide by).
STATISTICS = {
    "word_length": ("word_chars", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "symbol_share": ("n_symbols", "word_chars"),
    "repeated_line_share": ("n_dup_lines", "n_lines"),
    "top_token_share": ("n_top", "n_tokens"),
    "different_share": ("n_distinct", "n_tokens"),
    "stop_word_share": ("n_stop", "n_tokens"),
    "words_a_line": ("n_words", "n_lines"),
    "tokens_a_word": ("n_tokens", "n_words"),
}
NAMES = [*STATISTICS, "n_words", "n_dup_lines", "different_root"]


def with_statistics(counts: DataFrame) -> DataFrame:
    ratios = [F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)).alias(n) for n, (a, b) in STATISTICS.items()]
    root = F.coalesce(F.try_divide(F.col("n_distinct").cast("double"), F.sqrt("n_tokens")), F.lit(0.0)).alias("different_root")
    return counts.select("doc_id", *ratios, F.col("n_words").cast("double").alias("n_words"), F.col("n_dup_lines").cast("double").alias("n_dup_lines"), root)


Rule = tuple[tuple[int, float, float], ...]  # (statistic, greater than, at most), ordered by statistic


def rules(trees: boosting.Trees) -> list[Rule]:
    """All different paths, as conjunctions in which a statistic occurs once."""
    out: set[Rule] = set()
    inner = trees.feature.shape[1]
    for feature, cut in zip(trees.feature, trees.cut):
        paths: list[dict[int, tuple[float, float]]] = [{}]
        for node in range(inner):
            own, (j, c) = paths[node], (int(feature[node]), float(cut[node]))
            low, high = own.get(j, (-np.inf, np.inf))
            for bounds in ((low, min(high, c)), (max(low, c), high)):
                paths.append(own | {j: bounds})
        for path in paths[1:]:
            rule = tuple(sorted((j, a, b) for j, (a, b) in path.items() if a > -np.inf or b < np.inf))
            if rule and all(a < b for _, a, b in rule):
                out.add(rule)
    return sorted(out)


def holds(own: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(own)))
    for i, rule in enumerate(own):
        for j, low, high in rule:
            out[:, i] *= (x[:, j] > low) & (x[:, j] <= high)
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: tuple[np.ndarray, float], steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model by accelerated proximal gradient steps; columns of z lie in 0 to 1."""
    w, b = start
    v, vb, t = w, b, 1.0
    rate = 4 * len(y) / max(1e-9, np.linalg.norm(np.c_[z, np.ones(len(y))], 2) ** 2)
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(z @ v + vb))) - y) / len(y)
        new = v - rate * (z.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = vb - rate * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, float(b)


@dataclasses.dataclass
class Model:
    rules: list[Rule]
    weights: np.ndarray
    bias: float
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(holds(self.rules, x) @ self.weights + self.bias)))

    def column(self) -> Column:
        """The same as a Spark expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            when = F.lit(True)
            for j, low, high in rule:
                if low > -np.inf:
                    when &= F.col(NAMES[j]) > low
                if high < np.inf:
                    when &= F.col(NAMES[j]) <= high
            total = total + F.when(when, F.lit(float(w))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Model | None:
    """None unless both classes have two rows at least."""
    if min(y.sum(), len(y) - y.sum()) < 2:
        return None
    order = np.random.default_rng(seed).permutation(len(y))
    x, y = x[order], y[order].astype(float)
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    test = held if held.any() else ~held
    own = rules(boosting.fit(x[~held], y[~held], trees=40, depth=3, rate=0.3, sample=0.6, columns=0.6, seed=seed))
    z = holds(own, x)
    varied = (z[~held].min(axis=0) < z[~held].max(axis=0)) if len(own) else np.zeros(0, bool)
    _, first = np.unique(z[~held][:, varied], axis=1, return_index=True)  # of rules alike on all rows, one
    keep = np.sort(np.flatnonzero(varied)[first])
    own, z = [own[i] for i in keep], z[:, keep]
    mean = y[~held].mean()
    fit = np.zeros(len(own)), float(np.log(mean / (1 - mean)))
    found = []
    for penalty in (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005):
        fit = lasso(z[~held], y[~held], penalty, fit)
        s = z[test] @ fit[0] + fit[1]
        found.append((float(np.mean(np.logaddexp(0, s) - y[test] * s)), fit))
    w, b = next(f for loss, f in found if loss <= 1.01 * min(x for x, _ in found))
    some = np.flatnonzero(w)
    model = Model([own[i] for i in some], w[some], b, 0.5)
    model.threshold = float(min(0.5, np.quantile(model.probability(x[test][y[test] > 0]), 1 - KEEP, method="lower")))
    return model


def fit(statistics: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled documents, which the driver gathers: those with the smallest hash of id, label and statistics."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    hashed = F.pmod(F.xxhash64("doc_id", "quality", *NAMES), F.lit(1 << 40))
    rows = statistics.join(known, "doc_id").select("doc_id", *NAMES, "quality", hashed.alias("h"))
    # A cut of the hash leaves somewhat more rows than that; of them the first ones count.
    cut = int((1 << 40) * min(1.0, (sample + 5 * sample**0.5 + 10) / max(1, rows.count())))
    rows = rows.where(F.col("h") < cut).orderBy("h", "doc_id", "quality", *NAMES).limit(sample).toPandas()
    return train(rows[NAMES].to_numpy(float), (rows["quality"].to_numpy() > 0).astype(float)) if len(rows) else None


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, probability, keep)`` of every row: how likely its quality is good."""
    statistics = stored(with_statistics(measured(docs)))
    model = model or fit(statistics, labels)
    if model is None:
        return statistics.select("doc_id", F.lit(None).cast("double").alias("probability"), F.lit(True).alias("keep"))
    return statistics.select("doc_id", model.column().alias("probability")).withColumn("keep", F.col("probability") >= model.threshold)
