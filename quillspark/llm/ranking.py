"""Quality classifier: Bradley-Terry ranking of documents.

A document's score is a weighted sum of its features: statistics of the text and the shares of
its words in WORD_BUCKETS classes by hash. Weights are learned from preference pairs, each a text
of quality 1 against one of quality 0, by logistic loss on the difference of their features: all pairs of
all labelled texts that may be learned from. Their sums need no pair: what a text adds depends on its
score alone, through how the other class's scores are spread, so each step of Newton's method takes two passes over the texts.
The
threshold is a quantile of the scores of labelled texts: the share of quality 0 among all labels
that may be learned from, counted over the whole table, whatever the sample's share is. A logistic
curve gives THRESHOLD there; texts whose score is the threshold's get 1. Nothing is sampled.

Null and empty texts have the features of a text without words. Repeated rows score alike; of
labelled rows with one id that of the least features counts. Without labels of both values every score is 0.5.
No rows give no rows. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import stats
from quillspark.llm.common import appended, held_out, stashed

#: What all pairs weigh together, at most, against the ridge.
PAIRS = 60_000
FOLDS, HELD_FOLD = 4, 2
THRESHOLD = 0.7
RIDGE = 1.0
WORD_BUCKETS = 256
#: Texts, or pairs, that are in memory at a time.
BLOCK = 8192
#: Scores are spread by linear shares over points GRID apart, up to SPAN; second derivatives take them by COARSE steps.
GRID, SPAN = 1 / 128, 256
COARSE, COARSE_SPAN = 1 / 2, 32
#: Values of a statistic are counted by OCTAVE steps for each power of two, rounded up.
OCTAVE, LOWEST, HIGHEST = 128, -20, 24
QUANTILES = np.asarray([0.01, 0.03, 0.1, 0.25, 0.5, 0.75, 0.9, 0.97, 0.99])
#: Scores are whole numbers of these.
UNIT = 1e-9
#: Words whose classes a Python worker remembers.
CACHE = 500_000
NAMES = (*stats.BASE, *stats.RATES)
_USED = [NAMES.index(n) for n in stats.RATES] + [NAMES.index("n_words")]


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = got = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return got


_BUCKETS = _Buckets()


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The statistics of a text and how many of its words are in each bucket."""
    words = (text or "").lower().split()
    at = np.fromiter(map(_BUCKETS.__getitem__, words), "int64", len(words))
    return np.asarray(stats.of(text), "<f8"), np.bincount(at, minlength=WORD_BUCKETS).astype("<u4")


def described(text: str | None) -> np.ndarray:
    """The statistics of a text and its words' shares in the buckets."""
    known, counts = counted(text)
    return np.concatenate([known, counts / max(1, counts.sum())])


def packed(text: str | None) -> bytes:
    return b"".join(part.tobytes() for part in counted(text))


def unpacked(rows: list[bytes]) -> np.ndarray:
    """What described gives for the texts of these packed rows."""
    both = np.frombuffer(b"".join(rows), "uint8").reshape(len(rows), -1)
    known, counts = np.ascontiguousarray(both[:, : 8 * len(NAMES)]).view("<f8"), np.ascontiguousarray(both[:, 8 * len(NAMES) :]).view("<u4")
    return np.hstack([known, counts / np.maximum(1, counts.sum(1))[:, None]])


def _steps(v: np.ndarray) -> np.ndarray:
    m, e = np.frexp(np.clip(v, 2.0 ** (LOWEST - 1), 2.0**HIGHEST))
    return np.where(v > 0, 1 + (e - LOWEST) * OCTAVE + np.ceil((m - 0.5) * 2 * OCTAVE).astype("int64"), 0)


def _value(step: int) -> float:
    e, k = divmod(step - 1, OCTAVE)
    return (0.5 + k / (2 * OCTAVE)) * 2.0 ** (e + LOWEST) if step else 0.0


class Features:
    """Statistics as logarithms and steps at quantiles, and words' shares as logarithms, on a common scale.

    total: adds up what a function of rows and labels gives for all blocks of them.
    """

    def __init__(self, total: Callable):
        size = 2 + (HIGHEST - LOWEST + 1) * OCTAVE

        def spread(rows, _):
            return np.stack([np.bincount(_steps(rows[:, k]), minlength=size) for k in _USED]).astype("float64")

        reached = np.cumsum(total(spread), 1)
        self.edges = [np.unique([_value(int(at)) for at in np.searchsorted(r, QUANTILES * r[-1] - 1e-9)]) for r in reached]

        def moments(rows, _):
            x = self.raw(rows)
            return np.stack([x.sum(0), (x * x).sum(0)])

        self.mean, square = total(moments) / reached[0, -1]
        self.scale = np.sqrt(np.maximum(square - self.mean**2, 0)) + 1e-6

    def raw(self, rows: np.ndarray) -> np.ndarray:
        v = rows[:, _USED]
        steps = [v[:, [i]] > e[None, :] for i, e in enumerate(self.edges)]
        return np.hstack([np.log1p(np.maximum(v, 0)), *steps, np.log1p(100 * rows[:, len(NAMES) :])]).astype("float64")

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((self.raw(rows) - self.mean) / self.scale, -20, 20)


def pairs_of(good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The better and the worse rows of all pairs."""
    return np.repeat(good, len(bad)), np.tile(bad, len(good))


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -40, 40)))


def _met(counts: np.ndarray, curve: Callable, step: float) -> np.ndarray:
    """At each point t the sum of counts[u] * curve(t - u) over all points u."""
    n = len(counts)
    size = 1 << (3 * n).bit_length()
    kernel = curve(step * np.arange(-(n - 1), n))
    both = np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel, size), size)
    return np.maximum(both[n - 1 : 2 * n - 1], 0)


def _between(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The point below each score and the next one's share."""
    at = np.clip((s + SPAN) / GRID, 0, 2 * SPAN / GRID - 1e-6)
    low = at.astype("int64")
    return low, at - low


def all_pairs(total: Callable, features: Callable, size: int, numbers: tuple[int, int], ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights of the greatest likelihood of all preferences, of numbers[1] texts over numbers[0], less the ridge, by Newton's method.

    All pairs count, each as 1 or, where there are more than PAIRS, so that together they weigh PAIRS.
    """
    points, coarse = int(2 * SPAN / GRID) + 1, int(2 * COARSE_SPAN / COARSE) + 1
    each = min(1.0, PAIRS / (numbers[0] * numbers[1]))
    w = np.zeros(size)

    def bins(s):
        return np.clip(np.rint((s + COARSE_SPAN) / COARSE), 0, coarse - 1).astype("int64")

    def bell(t):
        return _sigmoid(t) * _sigmoid(-t)

    for _ in range(steps):

        def spread(rows, label, w=w):
            s = features(rows) @ w
            low, share = _between(s)
            fine = [np.bincount(low[label == v], 1 - share[label == v], points) + np.bincount(low[label == v] + 1, share[label == v], points) for v in (0, 1)]
            return np.concatenate([*fine, *(np.bincount(bins(s[label == v]), minlength=coarse) for v in (0, 1))])

        bad, good, bad_bins, good_bins = np.split(total(spread), np.cumsum([points, points, coarse]))
        lost = _met(good, _sigmoid, GRID), _met(bad, lambda t: _sigmoid(-t), GRID)  # how often texts of 0 and of 1, at that score, are judged wrongly
        near = _met(good_bins, bell, COARSE), _met(bad_bins, bell, COARSE)

        def slopes(rows, label, w=w, lost=lost, near=near):
            x = features(rows)
            s = x @ w
            low, share = _between(s)
            wrong = np.where(label == 1, *(n[low] * (1 - share) + n[low + 1] * share for n in lost[::-1]))
            at = bins(s)
            weight = np.where(label == 1, near[1][at], near[0][at])
            sums = np.zeros((2, coarse, size))
            for v in (0, 1):
                np.add.at(sums[v], at[label == v], x[label == v])
            return np.vstack([np.where(label == 1, wrong, -wrong) @ x, x.T @ (x * weight[:, None]), *sums])

        got = total(slopes)
        grad, square, of_bad, of_good = got[0], got[1 : 1 + size], got[1 + size : 1 + size + coarse], got[1 + size + coarse :]
        t = COARSE * np.arange(coarse)
        cross = of_good.T @ bell(t[:, None] - t[None, :]) @ of_bad
        step = np.linalg.solve(each * (square - cross - cross.T) + ridge * np.eye(size), each * grad - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def bradley_terry(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights of the greatest likelihood of these preferences less the ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        grad, hess = -ridge * w, ridge * np.eye(len(w))
        for at in range(0, len(better), BLOCK):
            diff = x[better[at : at + BLOCK]] - x[worse[at : at + BLOCK]]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # of the worse one winning
            grad += diff.T @ p
            hess += (diff * (p * (1 - p))[:, None]).T @ diff
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def quantile(scores: np.ndarray, weight: np.ndarray, share: float) -> float:
    """Between the last score within that share of the weight and the next one."""
    order = np.argsort(scores, kind="stable")
    reached = np.cumsum(weight[order]) / weight.sum()
    at = min(int(np.searchsorted(reached, share - 1e-9)), len(scores) - 1)
    return float((scores[order[at]] + scores[order[min(at + 1, len(scores) - 1)]]) / 2)


def in_blocks(rows: np.ndarray, label: np.ndarray) -> Callable:
    """total over rows in memory."""
    return lambda f: sum(f(rows[at : at + BLOCK], label[at : at + BLOCK]) for at in range(0, len(rows), BLOCK))


def in_tasks(learned: DataFrame) -> Callable:
    """total over a table of packed rows and labels: as many tasks as run at once add up their own, the driver their sums."""
    tasks = max(2, learned.sparkSession.sparkContext.defaultParallelism)

    def total(f):
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = None
            for batch in batches:
                if batch.num_rows:
                    one = f(unpacked(batch.column(0).to_pylist()), batch.column(1).to_numpy())
                    got = one if got is None else got + one
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(got).tobytes()], pa.binary()), pa.array([list(got.shape)], pa.list_(pa.int32()))], names=["sum", "shape"])

        kind = "sum binary, shape array<int>"
        found = learned.coalesce(tasks).mapInArrow(own, kind).collect()
        return sum(np.frombuffer(bytes(r["sum"])).reshape(r["shape"]) for r in found)

    return total


def quantile_of(scores: DataFrame, weight: tuple[float, float], share: float) -> int:
    """quantile of the whole numbers in column score, weighted by label, by narrowing ranges."""
    below, low, all_of = 0.0, None, None
    for bits in (48, 36, 24, 12, 0):
        inside = scores if low is None else scores.where(F.shiftright("score", bits + 12) == low)
        found = inside.groupBy(F.shiftright("score", bits).alias("at")).agg(*(F.sum((F.col("label") == v).cast("long")).alias(f"n{v}") for v in (0, 1)))
        rows = sorted((r["at"], r["n0"] * weight[0] + r["n1"] * weight[1]) for r in found.collect())
        all_of = all_of or sum(n for _, n in rows)
        for low, n in rows:
            if (below + n) / all_of >= share - 1e-9 or low == rows[-1][0]:
                break
            below += n
    # with the tied ones it goes past that share: they are the next one's too
    tied = scores.where(F.col("score") == low).agg(*(F.sum((F.col("label") == v).cast("long")).alias(f"n{v}") for v in (0, 1))).first()
    if below + tied["n0"] * weight[0] + tied["n1"] * weight[1] > (share + 1e-9) * all_of:
        return low
    after = scores.where(F.col("score") > low).agg(F.min("score")).first()[0]
    return low if after is None else (low + after) // 2


class Ranker:
    """weights over features, and the score at which the curve gives THRESHOLD.

    totals: how many labels of 0 and of 1 the rows stand for; the rows' own numbers if not given.
    """

    def __init__(self, rows: np.ndarray, label: np.ndarray, totals: tuple[int, int] | None = None):
        numbers = int((label == 0).sum()), int((label == 1).sum())
        if self.fit(in_blocks(rows, label), numbers):
            totals = totals or numbers
            s = self.units(rows)
            self.threshold = int(quantile(s, np.where(label == 1, totals[1] / numbers[1], totals[0] / numbers[0]), totals[0] / sum(totals)))
            self.slope = 4.0 / (np.std(s * UNIT) + 1e-9)

    def fit(self, total: Callable, numbers: tuple[int, int]) -> bool:
        """Whether there are both values to learn weights from."""
        self.weights = None
        if not numbers[0] or not numbers[1]:
            return False
        self.features = Features(total)
        self.weights = all_pairs(total, self.features, len(self.features.mean), numbers)
        return True

    def units(self, rows: np.ndarray) -> np.ndarray:
        """Scores in whole UNITs."""
        return np.rint(self.features(rows) @ self.weights / UNIT).astype("int64")

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), 0.5)
        above = (self.units(rows) - self.threshold) * UNIT
        got = 1 / (1 + np.exp(-np.clip(self.slope * above + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))
        return np.where(above >= 0, np.maximum(got, THRESHOLD), np.minimum(got, np.nextafter(THRESHOLD, 0)))


def trained(rows: DataFrame, labels: DataFrame, allowed: Column) -> Ranker:
    """Fitted to all labelled ones of rows (doc_id, row); labels are counted over the whole table."""
    own = labels.where(allowed & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    learned = stashed(rows.join(own, "doc_id").groupBy("doc_id", "label").agg(F.min("row").alias("row")).select("row", "label"))
    found = {r["label"]: r["n"] for r in learned.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranker = Ranker.__new__(Ranker)
    if ranker.fit(in_tasks(learned), (found.get(0, 0), found.get(1, 0))):
        fields = [T.StructField("score", T.LongType())]
        scores = stashed(appended(learned, "row", lambda: lambda own: {"score": ranker.units(unpacked(own)).tolist() if own else []}, fields, without=("row",)))
        ranker.threshold = quantile_of(scores, (totals[0] / found[0], totals[1] / found[1]), totals[0] / (totals[0] + totals[1]))
        ranker.slope = 4.0 / (scores.agg(F.stddev_pop(F.col("score") * UNIT)).first()[0] + 1e-9)
    return ranker


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    held = held_out("doc_id", FOLDS, HELD_FOLD)
    rows = stashed(appended(docs.select("doc_id", "text"), "text", lambda: lambda texts: {"row": [packed(t) for t in texts]}, [T.StructField("row", T.BinaryType())], without=("text",)))
    ranker = trained(rows, labels, ~held)

    def make():
        def work(own):
            s = ranker.score(unpacked(own)).tolist() if own else []
            return {"score": s, "predicted": [int(v >= THRESHOLD) for v in s]}

        return work

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return appended(rows.select("doc_id", held.alias("held_out"), "row"), "row", make, fields, without=("row",))
