"""Ranked lexical search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import lexical

DOCS = "doc_id bigint, text string, lang string"
ITEMS = "item_id bigint, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def own_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def brute(docs, items, most=50):
    counts = [(i, Counter(own_terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for doc, c in counts:
            m = 50 + 50 * c.total() * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(own_terms(text)) if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda r: r[:3])[:most])]
    return sorted(out, key=str)


def got(spark, docs, items, most=50):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS)
    rows = lexical.searched(d, spark.createDataFrame(items, ITEMS), most).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str)


def texts(seed, n, words=60, most=80):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    return [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(words)], k=rng.randint(1, most))) for _ in range(n)]


def test_terms_are_those_of_the_pattern():
    odd = ["", None, "Ab-c ÀÉ_x\u0085y z ß 你好,世界 İ x\x00y 1.5e\t\x7f~`[", "😀é É", "ſtraße ẞ"]
    for t in odd:
        assert [b.decode() for b in lexical.terms(t)] == own_terms(t)


def test_whole_lists(spark):
    docs = list(enumerate(texts(1, 400)))
    items = list(enumerate(texts(2, 12, most=9)))
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, items, most=3) == brute(docs, items, most=3)


def test_many_small_indexes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 300)
    monkeypatch.setattr(lexical, "BLOCK", 200)  # items in several blocks
    docs = list(enumerate(texts(3, 300)))
    items = list(enumerate(texts(4, 8, most=9)))
    assert got(spark, docs, items, most=10) == brute(docs, items, most=10)


def test_edges(spark):
    long = "common " * 40_000 + "rare"
    docs = [(1, None), (2, ""), (3, "Rare rare"), (3, "rare Rare"), (None, "rare rare"), (None, "rare word"), (5, long), (6, "--- !"), (7, "common"), *[(100 + k, "tie tie") for k in range(70)]]
    items = [(1, "RARE"), (1, "RARE"), (1, "common"), (2, None), (3, ""), (4, "nowhere"), (None, "word"), (5, "tie common")]
    assert got(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == [] and got(spark, [(1, "a")], []) == []


def test_lengths_beyond_64_bits():
    n = np.asarray([1, 4_000_000_000], "int64")
    assert lexical.lengths(n, 50_000_000_000, 10**13).tolist() == [50 + 50 * int(x) * 50_000_000_000 // 10**13 for x in n]


@pytest.mark.parametrize("seed", range(5))
def test_stops_before_the_end_with_the_same_result(seed):
    rng = np.random.default_rng(seed)
    n, n_terms = 3000, 12
    sizes = rng.integers(1, n_terms, n)
    terms = np.concatenate([np.sort(rng.choice(n_terms, k, replace=False)) for k in sizes]).astype("int32")
    tfs = rng.zipf(1.6, len(terms)).clip(max=500).astype("int64")
    index = lexical.Index(rng.integers(50, 400, n), np.r_[0, np.cumsum(sizes)], terms, tfs)
    own = np.repeat(np.arange(n), sizes)
    early = 0
    for size in (1, 2, 6):
        weights = {int(t): int(w) for t, w in zip(rng.choice(n_terms, size, replace=False), rng.integers(1, 6000, size))}
        whole = np.bincount(own, [weights.get(int(t), 0) for t in terms] * index.scores, n).astype("int64")
        docs, scores, read = index.top(weights, 5)
        early += read < sum(int((terms == t).sum()) for t in weights)
        best = sorted(zip(-scores, docs))[:5]
        assert best == sorted((-int(whole[d]), d) for d in np.argsort(-whole, kind="stable")[:5])
        assert (whole[docs] == scores).all()
    assert early  # single terms are settled by their highest impacts
