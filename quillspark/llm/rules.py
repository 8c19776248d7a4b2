"""Quality rules as a learned decision list.

Sequential covering over the statistics of labelled texts: a rule grows by the threshold
condition with most information gain until it covers no text of quality 1, is then pruned
from its end on rows kept aside, and takes the rows that it covers away. Rules whose
precision on the rows kept aside is too low end the list. The list becomes one ordered
conditional expression of Spark; the first rule that holds rejects, and what none covers is kept.

Null texts have no words. Repeated rows give repeated results. Without labels of both values
the list is empty, and only the base rules decide. No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import stats
from quillspark.llm.common import appended, stashed

#: Labelled rows of statistics to learn from, at most, of either value.
SAMPLE = {0: 6000, 1: 12000}
THRESHOLDS = 48
LONGEST_RULE = 4
MOST_RULES = 24
LEAST_PRECISION = 0.8
LEAST_COVERED = 4
NAMES = (*stats.BASE, *stats.RATES)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, rows: np.ndarray) -> np.ndarray:
        v = rows[:, NAMES.index(self.name)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        c = F.col(self.name).cast("double")
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, rows: np.ndarray) -> np.ndarray:
    out = np.ones(len(rows), bool)
    for c in rule:
        out &= c.holds(rows)
    return out


def _grow(rows: np.ndarray, bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(rows), bool)
    while len(rule) < LONGEST_RULE:
        x, y = rows[inside], bad[inside]
        p0, n0 = y.sum(), (~y).sum()
        if not n0 or not p0:
            break
        best = (1e-9, None)
        for k, name in enumerate(NAMES):
            v = x[:, k]
            edges = np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, THRESHOLDS)), np.quantile(v[y], np.linspace(0, 1, THRESHOLDS))]))
            order = np.argsort(v, kind="stable")
            ps, ns = np.cumsum(y[order]), np.cumsum(~y[order])
            at = np.searchsorted(v[order], edges, "right")
            low_p = np.where(at > 0, ps[np.maximum(at - 1, 0)], 0)
            low_n = np.where(at > 0, ns[np.maximum(at - 1, 0)], 0)
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p >= LEAST_COVERED, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], Condition(name, above, float(edges[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(rows)
    return tuple(rule)


def _prune(rule: Rule, rows: np.ndarray, bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        c = covered(r, rows)
        p, n = (bad & c).sum(), (~bad & c).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(rows: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Ordered rules that reject, from statistics and whether each row is bad."""
    if not len(rows) or bad.all() or not bad.any():
        return []
    aside = np.arange(len(rows)) % 3 == 2
    found: list[Rule] = []
    left = np.ones(len(rows), bool)
    while len(found) < MOST_RULES and (bad & left & ~aside).sum() >= LEAST_COVERED:
        rule = _prune(_grow(rows[left & ~aside], bad[left & ~aside]), rows[left & aside], bad[left & aside])
        if not rule:
            break
        c = covered(rule, rows) & left
        p, n = (bad & c & aside).sum(), (~bad & c & aside).sum()
        if p < LEAST_PRECISION * (p + n) or not p:
            break
        found.append(rule)
        left &= ~c
    return found


def expression(rules: list[Rule]) -> Column:
    """True where no rule rejects."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def counted(docs: DataFrame) -> DataFrame:
    """docs, without text, with all statistics."""

    def make():
        def work(texts):
            rows = list(zip(*map(stats.of, texts))) or [[]] * len(NAMES)
            return dict(zip(NAMES, map(list, rows)))

        return work

    fields = [T.StructField(n, T.LongType()) for n in stats.BASE] + [T.StructField(n, T.DoubleType()) for n in stats.RATES]
    return appended(docs, "text", make, fields, without=("text",))


def labelled(counts: DataFrame, labels: DataFrame, allowed: Column, per_class: dict[int, int], label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most per_class ids of each value, by a hash of the id; of rows with one id the least."""
    own = labels.where(allowed & F.col(label).isin(*per_class) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    parts = [own.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v, most in per_class.items()]
    sample = parts[0]
    for p in parts[1:]:
        sample = sample.unionByName(p)
    rows = counts.select("doc_id", *NAMES).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*NAMES)).alias("s"))
    rows = rows.select("doc_id", "label", "s.*").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    return rows[list(NAMES)].to_numpy("float64").reshape(-1, len(NAMES)), rows["label"].to_numpy()


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept."""
    counts = stashed(counted(docs.select("doc_id", "text")))
    rows, label = labelled(counts, labels, F.lit(True), SAMPLE)
    rules = learn(rows, label == 0)
    return counts.withColumn("base_failed", base_failed()).select("doc_id", *stats.BASE, "base_failed", (~F.col("base_failed") & expression(rules)).alias("kept"))
