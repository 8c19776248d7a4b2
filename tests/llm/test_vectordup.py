"""Near duplicates of vectors against all cosines."""

import numpy as np
import pytest

from quillspark.llm import vectordup

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def at(rng, v, cosine):
    """A vector at that cosine from v."""
    w = rng.normal(size=v.shape)
    w = unit(w - (w @ v) * v)
    return cosine * v + np.sqrt(1 - cosine**2) * w


def brute(rows, similar=0.95):
    x = unit(np.asarray([r[1] for r in rows], "float32").astype("float64"))
    links = x @ x.T >= similar
    n, ids = len(rows), [r[0] for r in rows]
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(links)):
        root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (int(links[i].sum()) - 1, least[find(i)]) for i in range(n)}


def got(spark, rows):
    found = vectordup.linked(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}


def test_plan_grows_with_the_table():
    k, tables = vectordup.planned(50_000)
    assert vectordup.planned(5_000_000)[0] > k and vectordup.planned(5_000_000)[1] > tables
    p = vectordup.agreed(np.sqrt(0.1)) ** k
    assert (1 - p) ** tables <= vectordup.MISSED


@pytest.mark.parametrize("cosine,least", [(0.952, 0.9), (0.97, 0.97), (0.99, 1.0)])
def test_recall_of_lone_pairs(cosine, least):
    rng = np.random.default_rng(1)
    x = unit(rng.normal(size=(2000, 64)))
    y = np.stack([at(rng, v, cosine) for v in x])
    k, tables = vectordup.planned(50_000)
    same = (vectordup.keys_of(x, k, tables) == vectordup.keys_of(y, k, tables)).any(1)
    assert same.mean() >= least
    strangers = (vectordup.keys_of(x, k, tables)[:-1] == vectordup.keys_of(x, k, tables)[1:]).sum()
    assert strangers <= 10


def test_clusters_chains_and_copies(spark):
    rng = np.random.default_rng(2)
    parts = [unit(rng.normal(size=(150, 64)))]
    for spread, n in ((0.002, 60), (0.02, 60), (0.028, 40)):  # tight, and with pairs on both sides of the bound
        parts.append(unit(unit(rng.normal(size=64)) + spread * rng.normal(size=(n, 64))))
    chain = [unit(rng.normal(size=64))]
    for _ in range(20):
        chain.append(at(rng, chain[-1], 0.975))
    parts.append(np.stack(chain))
    parts.append(np.repeat(parts[1][:3], 15, axis=0))  # equal rows
    parts.append(parts[0][:5] * 7.5)  # the same directions
    rows = [(i, v) for i, v in enumerate(np.concatenate(parts).astype("float32").tolist())]
    rng.shuffle(rows)
    rows = [(int(i), v) for i, v in rows]
    own, true = got(spark, rows), brute(rows)
    assert set(own) == set(true)
    found, there = sum(n for n, _ in own.values()), sum(n for n, _ in true.values())
    assert all(own[i][0] <= true[i][0] for i in own) and found >= 0.97 * there
    assert np.mean([own[i] == true[i] for i in own]) >= 0.9


def test_one_tight_group_is_counted_without_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(unit(unit(rng.normal(size=64)) + 0.003 * rng.normal(size=(700, 64))).tolist())]
    assert set(got(spark, rows).values()) == {(699, 0)}


def test_blocks_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(vectordup, "BLOCK", 4)
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(unit(unit(rng.normal(size=64)) + 0.024 * rng.normal(size=(90, 64))).tolist())]
    own, true = got(spark, rows), brute(rows)
    assert all(own[i][0] <= true[i][0] for i in own) and sum(n for n, _ in own.values()) >= 0.9 * sum(n for n, _ in true.values())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0]), (10, [1.0, 0.0, 0.0]), (11, [3e38, 1e38]), (12, [0.0, -1.0]), (13, [1e-42, 0.0])]
    own = got(spark, rows)
    alone = {i: (0, i) for i in (1, 2, 3, 4, 5, 6, 9, 10, 12)}
    assert own == alone | {7: (2, 7), 8: (2, 7), 13: (2, 7), 11: (0, 11)}


def test_ids_null_or_repeated(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [-1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, vectordup.linked(df).collect()), key=str) == sorted([(None, 1, 3, False), (3, 1, 3, True), (3, 0, 3, True), (None, 0, None, True)], key=str)


def test_no_rows(spark):
    assert vectordup.linked(spark.createDataFrame([], SCHEMA)).collect() == []
