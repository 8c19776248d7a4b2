"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

A text is read as sentences, and a sentence as windows: each of its words, and each two that
follow each other, as insults may have several words or a space put inside. Runs of four and
more single characters ("i d i o t") are one word. Letters are folded to lower case without
accents; those of other scripts are dealt to codes of their own by hash, digits share one.
Signs inside a word vanish, and a mark stands for a word's start. Words of more than LONGEST
codes give overlapping windows of that length, and of two words no more than that around
their meeting place; every code of a text is in a window.

The kernel of two windows sums, over all subsequences of three codes that both have within
a span of SPAN, the product of decay ** span; each window is scaled by the norm of its places,
so gaps and inserted characters only weaken a match. As the trained machine is linear in these
subsequences, all windows of many texts are scored at once from running sums. A text's score is
a logistic function of its highest window, and of how many score above 0, in all and by its length.

Training uses whole labelled texts, at most SAMPLE of either class. A clean text's windows
are negative. Of a toxic one the window that best tells toxic texts is its witness, first by
the texts that have it, then by the machine trained so far; copies of witnesses with an inserted
character join them. Landmarks are spread over witnesses and negatives; in the feature space
that they span a squared-hinge machine is trained by Newton steps. It depends only on windows
within its margin, so after each round all clean windows found there are added. The logistic
function is fitted to the sample weighted by how many labels each class has in the whole table.

Null and empty texts have no window and get the score of that. Repeated rows score alike; of
labelled rows with one id the least text counts. Without labels of both classes every score
is 0.0. No rows give no rows. Columns with the names of results are replaced.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import appended, held_out, training_sample

DECAY = 0.85
SPAN = 6
LONGEST = 24
#: Windows with fewer codes, the mark included, have no score.
SHORTEST = 3
#: So many single characters in a row are one word.
SPELLED = 4
LANDMARKS = 200
#: Labelled texts to learn from, at most, of either class; more aren't needed.
SAMPLE = {0: 2500, 1: 1200}
#: Negative windows of the first round.
FIRST_NEGATIVES = 6000
ROUNDS = 3
#: Characters of texts, and windows, that are scored at a time.
BLOCK = 1 << 18
FOLDS, HELD_FOLD = 5, 0

_CODES = 48  # 0: none, 1-26: letters, 27: digits, 28: a word's start, 29-47: letters of other scripts
_START, _OTHER, _SENTENCE = 28, 29, 255
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: Full stops inside words aren't ends of sentences, unless a word with a capital follows.
_END = re.compile(r"[.!?]+(?=\s|\Z|[^\W\d_a-z][^\W\d_A-Z])|\n")


class _Letters(dict):
    """Of each character one of Latin-1 for the table below, or none where it is a sign."""

    def __missing__(self, c: int) -> str | None:
        char = chr(c)
        base = "s" if char in "ßẞ" else unicodedata.normalize("NFKD", char)[0].lower()
        if base.isascii():
            got = char if c < 128 else base if base.isalnum() else " " if base.isspace() else None
        elif char.isspace():
            got = " "
        else:
            got = chr(128 + zlib.crc32(base.encode("utf-8", "surrogatepass")) % (_CODES - _OTHER)) if char.isalnum() else None
        self[c] = got
        return got


_LETTERS = _Letters()
_TABLE = bytearray(256)
for _c in range(256):
    _s = chr(_c)
    _TABLE[_c] = ord(_s.lower()) - 96 if _s.isascii() and _s.isalpha() else 27 if _s.isascii() and _s.isdigit() else _OTHER + _c - 128 if 128 <= _c < 128 + _CODES - _OTHER else _SENTENCE if _s == "\n" else 0
_TABLE = bytes(_TABLE)
_SIGNS = bytes(c for c in range(256) if not _TABLE[c] and not chr(c).isspace())


def codes_of(text: str) -> bytes:
    """Codes of letters, 0 for white space, _SENTENCE for ends of sentences."""
    text = _END.sub("\n", text)
    if not text.isascii():
        text = text.translate(_LETTERS)
    return text.encode("latin-1").translate(_TABLE, _SIGNS)


def windows_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts in a row, and each window's start, end and text; windows are in order of their starts."""
    parts = [codes_of(t) if t else b"" for t in texts]
    between = bytes([_SENTENCE])
    raw = np.frombuffer(between + between.join(parts) + between, "uint8").copy()
    text_ends = np.cumsum([len(p) + 1 for p in parts])
    del parts
    letter = (raw > 0) & (raw < _SENTENCE)
    head = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1  # first letters of words
    if not len(head):
        none = np.zeros(0, "int64")
        return np.zeros(0, "uint8"), none, none, none
    tail = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    sentence = np.cumsum(raw == _SENTENCE, dtype="int32")[head]
    # runs of single characters become one word: the marks inside go
    joins = np.r_[False, (tail - head == 1)[1:] & (tail - head == 1)[:-1] & (sentence[1:] == sentence[:-1])]
    run = np.cumsum(~joins)
    joins &= np.bincount(run)[run] >= SPELLED
    raw[head - 1] = _START
    keep = letter.copy()
    keep[head[~joins] - 1] = True
    codes = raw[keep]
    start = (np.cumsum(keep, dtype="int32") - 1)[head[~joins] - 1]  # where what is kept comes to stand
    end = np.r_[start[1:], len(codes)]
    sentence, owner = sentence[~joins], np.searchsorted(text_ends, head[~joins] - 1, "right").astype("int32")
    # long words in pieces
    size = end - start
    n = np.maximum(1, -(-(size - LONGEST // 2) // (LONGEST // 2)))
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a = np.repeat(start, n) + k * (LONGEST // 2)
    b = np.minimum(a + LONGEST, np.repeat(end, n))
    # two words that follow each other
    two = np.flatnonzero(sentence[1:] == sentence[:-1])
    middle = start[two + 1]
    starts = np.concatenate([a, np.maximum(start[two], middle - LONGEST // 2)])
    ends = np.concatenate([b, np.minimum(end[two + 1], middle + LONGEST // 2)])
    owners = np.concatenate([np.repeat(owner, n), owner[two]])
    some = ends - starts >= SHORTEST
    starts, ends, owners = starts[some], ends[some], owners[some]
    order = np.argsort(starts, kind="stable")
    return codes, starts[order], ends[order], owners[order]


def _norms(lengths: np.ndarray) -> np.ndarray:
    total = np.zeros(len(lengths))
    for _, b in _OFFSETS:
        total += np.maximum(lengths - b, 0) * DECAY ** (2 * (b + 1))
    return np.sqrt(np.maximum(total, 1e-9))


_NORMS = _norms(np.arange(LONGEST + 1))


def linear(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each window the scaled sum of weights[i, j, k] over its places of i, j, k; windows in order of their starts."""
    flat = weights.reshape(-1)
    out = np.zeros(len(starts))
    for low in range(0, len(starts), BLOCK):
        s, e = starts[low : low + BLOCK], ends[low : low + BLOCK]
        base = int(s[0])
        own = np.r_[codes[base : int(e.max())], np.zeros(SPAN, "uint8")].astype("int32")
        n = len(own) - SPAN
        first = own[:n] * _CODES
        for y in range(2, SPAN):
            here = np.zeros(n)
            for x in range(1, y):
                here += flat[(first + own[x : x + n]) * _CODES + own[y : y + n]]
            total = np.r_[0.0, np.cumsum(here)]
            out[low : low + BLOCK] += DECAY ** (y + 1) * (total[np.maximum(e - y, s) - base] - total[s - base])
    return out / _NORMS[ends - starts]


def features(codes: list[bytes], columns: np.ndarray, width: int) -> np.ndarray:
    """The kernel's own features, one row a window; columns: triple -> column, -1 for none."""
    wide = max(map(len, codes))
    m = np.frombuffer(b"".join(c.ljust(wide + SPAN, b"\0") for c in codes), "uint8").reshape(len(codes), wide + SPAN).astype("int64")
    out = np.zeros(len(codes) * width)
    rows = np.arange(len(codes))[:, None] * width + np.zeros((1, wide), "int64")
    for x, y in _OFFSETS:
        c = m[:, y : y + wide]
        at = columns[(m[:, :wide] * _CODES + m[:, x : x + wide]) * _CODES + c]
        ok = (c > 0) & (at >= 0)
        np.add.at(out, rows[ok] + at[ok], DECAY ** (y + 1))
    return out.reshape(len(codes), width) / _norms(np.asarray([len(c) for c in codes]))[:, None]


def triples(codes: list[bytes]) -> np.ndarray:
    """All triples within the span of any of these windows."""
    wide = max(map(len, codes))
    m = np.frombuffer(b"".join(c.ljust(wide + SPAN, b"\0") for c in codes), "uint8").reshape(len(codes), wide + SPAN).astype("int64")
    found = [np.unique(((m[:, :wide] * _CODES + m[:, x : x + wide]) * _CODES + m[:, y : y + wide])[m[:, y : y + wide] > 0]) for x, y in _OFFSETS]
    return np.unique(np.concatenate(found))


class Nystrom:
    """Features spanned by landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.own = triples(landmarks)
        self.columns = np.full(_CODES**3, -1)
        self.columns[self.own] = np.arange(len(self.own))
        phi = features(landmarks, self.columns, len(self.own))
        w, v = np.linalg.eigh(phi @ phi.T)
        keep = w > 1e-6 * max(w.max(), 1e-12)
        self.map = (phi.T @ (v[:, keep] / np.sqrt(w[keep]))).astype("float32")

    def __call__(self, codes: list[bytes]) -> np.ndarray:
        parts = [features(codes[i : i + 400], self.columns, len(self.own)).astype("float32") @ self.map for i in range(0, len(codes), 400)]
        return np.vstack(parts)

    def primal(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(_CODES**3)
        out[self.own] = self.map @ w
        return out.reshape(_CODES, _CODES, _CODES)


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 4.0, steps: int = 30) -> np.ndarray:
    """The least of |w|^2 / 2 + c / 2 * sum of weight * max(0, 1 - y (x w))^2, by Newton's method; the last coefficient is the offset, which is hardly held back."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    active = np.ones(len(x), bool)
    for _ in range(steps):
        gram, right = ridge.copy(), np.zeros(x.shape[1])
        for at in np.array_split(np.flatnonzero(active), 1 + active.sum() // 4096):
            xa = x[at].astype("float64")
            xw = xa * (c * weight[at])[:, None]
            gram += xw.T @ xa
            right += xw.T @ y[at]
        w = np.linalg.solve(gram, right)
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


class Model:
    """weights over code triples and an offset for windows, and the logistic function of a text."""

    def __init__(self, weights: np.ndarray | None, offset: float):
        self.weights, self.offset = weights, offset
        self.logistic = np.zeros(7)

    def described(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the highest score, whole and up to 0.5; how many are above 0, 0.3 and 0.6, as logarithms; those above 0.3 in 100."""
        out = np.zeros((len(texts), 6))
        for a, b in _portions(texts):
            codes, starts, ends, owner = windows_of(texts[a:b])
            s = linear(codes, starts, ends, self.weights) + self.offset
            above = s > 0
            n = [np.bincount(owner[s > least], minlength=b - a) for least in (0, 0.3, 0.6)]
            most = np.zeros(b - a)
            np.maximum.at(most, owner[above], s[above])
            every = np.bincount(owner, minlength=b - a) + 20
            out[a:b] = np.stack([most, np.minimum(0.5, most), *map(np.log1p, n), np.minimum(3.0, 100 * n[1] / every)], axis=1)
        return out

    def __call__(self, texts: list[str | None]) -> list[float]:
        """The score of each text."""
        if self.weights is None or not texts:
            return [0.0] * len(texts)
        z = self.logistic[0] + self.described(texts) @ self.logistic[1:]
        return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()


def _portions(texts: list[str | None]):
    """Ranges of texts of BLOCK characters together, or one."""
    a = size = 0
    for b, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > BLOCK:
            yield a, b
            a, size = b, 0
        size += n
    yield a, len(texts)


def fitted_logistic(rows: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.02) -> np.ndarray:
    """Offset and weights by Newton's method; features are scaled for the ridge."""
    weight = np.ones(len(rows)) if weight is None else weight
    scale = rows.std(0) + 1e-6
    x = np.hstack([np.ones((len(rows), 1)), rows / scale])
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w)) * ridge
    keep[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (label - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate([w[:1], w[1:] / scale])


def _inserted(code: bytes, k: int) -> bytes:
    at = 2 + k % (len(code) - 1)
    return code[:at] + bytes([1 + k * 7 % 26]) + code[at:]


def _spread(codes, n: int) -> list[bytes]:
    return sorted(codes, key=lambda c: (zlib.crc32(c), c))[:n]


def all_windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """windows_of, by portions: what it makes on the way takes some times as much memory as what it gives."""
    kind = "int32" if sum(len(t or "") + 1 for t in texts) < 1 << 30 else "int64"
    found: tuple[list[np.ndarray], ...] = ([], [], [], [])
    n = 0
    for a, b in _portions(texts):
        codes, starts, ends, owner = windows_of(texts[a:b])
        for part, x in zip(found, (codes, (starts + n).astype(kind), (ends + n).astype(kind), (owner + a).astype("int32"))):
            part.append(x)
        n += len(codes)
    codes, starts, ends, owner = map(np.concatenate, found)
    return codes, starts, ends, owner


class _Sample:
    """The labelled texts' windows: all, and the different ones with the numbers of clean and toxic texts that have them."""

    def __init__(self, texts: list[str], label: np.ndarray):
        self.codes, self.starts, self.ends, owner = all_windows(texts)
        padded = np.r_[self.codes, np.zeros(LONGEST, "uint8")]
        hashes = np.zeros(len(self.starts), "uint64")
        for low in range(0, len(hashes), BLOCK):
            s, e = self.starts[low : low + BLOCK], self.ends[low : low + BLOCK]
            for k in range(LONGEST):
                hashes[low : low + BLOCK] = hashes[low : low + BLOCK] * np.uint64(0x9E3779B97F4A7C15) + np.where(s + k < e, padded[s + k], 0).astype("uint64")
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        del hashes
        self.first, self.kind = order[new], np.empty(len(order), "int32")
        self.kind[order] = np.cumsum(new, dtype="int32") - 1
        del order, new
        n = len(self.first)
        cut = np.unique(np.r_[np.searchsorted(owner, owner[::BLOCK]), len(owner)])  # between texts
        both = np.concatenate([np.zeros(0, "int64"), *(np.unique(owner[a:b].astype("int64") * n + self.kind[a:b]) for a, b in zip(cut, cut[1:]))])
        of_text, window = both // max(n, 1), (both % max(n, 1)).astype("int32")
        toxic = label[of_text] == 1
        self.toxic, self.clean = (np.bincount(window[t], minlength=n) for t in (toxic, ~toxic))
        self.bag, self.witness = of_text[toxic], window[toxic]  # texts and windows of toxic ones

    def __getitem__(self, i: int) -> bytes:
        return self.codes[self.starts[self.first[i]] : self.ends[self.first[i]]].tobytes()

    def scores(self, model: Model) -> np.ndarray:
        out = np.zeros(len(self.first))
        for low in range(0, len(self.starts), BLOCK):
            own = slice(low, low + BLOCK)
            out[self.kind[own]] = linear(self.codes, self.starts[own], self.ends[own], model.weights) + model.offset
        return out

    def witnesses(self, scores: np.ndarray) -> Counter:
        """Of each toxic text the window with the highest score, counted; those of -inf are none."""
        order = np.lexsort((self.witness, -scores[self.witness], self.bag))
        first = order[np.r_[True, self.bag[order][1:] != self.bag[order][:-1]]] if len(order) else order
        return Counter(w for w in self.witness[first].tolist() if scores[w] > -np.inf)


def fit(rows: list[tuple[str | None, int]], totals: tuple[int, int] | None = None) -> Model:
    """The model of labelled texts; equal texts count once, with the highest label. totals: how many labels of either class they stand for."""
    seen: dict[str, int] = {}
    for text, label in rows:
        seen[text or ""] = max(int(label), seen.get(text or "", 0))
    texts = sorted(seen)
    label = np.asarray([seen[t] for t in texts], "int64")
    n = np.bincount(label, minlength=2)
    if not n.all():
        return Model(None, 0.0)
    sample = _Sample(texts, label)
    if not sample.toxic.any():
        return Model(None, 0.0)
    tells = np.log((sample.toxic + 0.5) / (sample.clean + 0.5) * n[0] / n[1])
    witnesses = sample.witnesses(np.where((sample.toxic > 1) & (tells > 1.5), sample.toxic * tells, -np.inf))
    by_count = np.argsort(-sample.clean, kind="stable")
    by_count = by_count[sample.clean[by_count] > 0]
    common, others = by_count[: FIRST_NEGATIVES // 2], by_count[FIRST_NEGATIVES // 2 :]
    step = max(1, len(others) // (FIRST_NEGATIVES // 2))  # windows are numbered by hash
    negatives = np.zeros(len(sample.first), bool)
    negatives[common] = negatives[np.sort(others)[::step]] = True
    model = space = None
    known: dict[bytes, np.ndarray] = {}
    for turn in range(ROUNDS):
        if not witnesses:
            return Model(None, 0.0)
        positives = sorted(((sample[w], n) for w, n in witnesses.items()), key=lambda p: (-p[1], p[0]))
        positives, times = [c for c, _ in positives], np.asarray([float(n) for _, n in positives])
        negatives[list(witnesses)] = False
        against = [sample[i] for i in np.flatnonzero(negatives).tolist()]
        if turn < 2:  # landmarks stay from the second round on
            landmarks = positives[: LANDMARKS // 2] + _spread(positives[LANDMARKS // 2 :], LANDMARKS // 4)
            space, known = Nystrom(landmarks + _spread(against, LANDMARKS - len(landmarks))), {}
        gapped = [_inserted(c, k) for c in positives for k in range(1, 4)]
        codes = positives + gapped + against
        if new := [c for c in dict.fromkeys(codes) if c not in known]:
            known.update(zip(new, space(new)))
        y = np.r_[np.ones(len(positives) + len(gapped)), -np.ones(len(against))]
        weight = np.r_[np.sqrt(times), np.repeat(np.sqrt(times), 3), np.ones(len(against))]
        weight[y > 0] *= (len(against) / weight[y > 0].sum()) ** 0.5
        w = squared_hinge(np.stack([known[c] for c in codes]), y, weight)
        model = Model(space.primal(w[:-1]).astype("float32"), float(w[-1]))
        scores = sample.scores(model)
        negatives |= (scores > -1) & (sample.clean > 0) & (tells < 1.0)
        # what only one toxic text has needs the machine's word
        witnesses = sample.witnesses(np.where((tells > 0.5) & (scores > np.where(sample.toxic > 1, -0.5, 0.3)), scores, -np.inf))
    described = np.vstack([model.described(texts[i : i + 500]) for i in range(0, len(texts), 500)])
    totals = np.asarray(totals or n, float)
    model.logistic = fitted_logistic(described, label.astype(float), (totals / n)[label] * n.sum() / totals.sum())
    return model


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted to a bounded sample of labelled texts, without the held-out fold; labels are counted over the whole table."""
    allowed = ~held_out("doc_id", FOLDS, HELD_FOLD)
    own = labels.where(allowed & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = totals.get(0, 0), totals.get(1, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows, sizes))], pa.binary())], names=["model"])

    # one task gets the sample, which is bounded, so that the driver needn't hold it
    sample = training_sample(docs, labels, "toxic", allowed, SAMPLE).select("text", F.col("label").cast("int").alias("label"))
    got = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else Model(None, 0.0)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs, without text, with score and predicted."""

    def make():
        def work(texts):
            s = model(texts)
            return {"score": s, "predicted": [int(x >= 0.5) for x in s]}

        return work

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return appended(docs, "text", make, fields, without=("text",))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that don't score as toxic."""
    return appended(docs, "text", lambda: lambda texts: {"score": model(texts)}, [], keep=lambda got: [s < 0.5 for s in got["score"]]).select(docs.columns)
