"""Ball k-means against plain rounds over all centroids."""

import hashlib

import numpy as np
import pytest

from quillspark.llm import ballmeans

SCHEMA = "vec_id bigint, embedding array<float>, cluster int, v string"


def plain(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in kept[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, to) in zip(kept, near) if to == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    each = {}
    for d, j in near:
        each[j] = each.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, each[j], sum(each.values()), sha[j]) for (i, _), (d, j) in zip(kept, near)), key=str)


def got(spark, rows, k, rounds, dim):
    df = spark.createDataFrame([(i, e, 7, "x") for i, e in rows], SCHEMA)
    return sorted((tuple(r) for r in ballmeans.clustered(df, k, rounds, dim).collect()), key=str)


@pytest.mark.parametrize("seed,k,dim,spread", [(1, 12, 8, 0.05), (2, 30, 4, 1.0), (3, 5, 64, 0.3), (4, 9, 2, 0.02)])
def test_same_as_plain_rounds(spark, seed, k, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, dim))
    x = (centres[rng.integers(0, k, 300)] + spread * rng.normal(size=(300, dim))).astype("float32")
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    assert got(spark, rows, k, 4, dim) == plain(rows, k, 4)


def test_ties_copies_and_short_tables(spark):
    grid = [(i, [float(i % 3) / 256, float(i // 3 % 3) / 256]) for i in range(27)]  # each point thrice, many in the middle
    assert got(spark, grid, 7, 3, 2) == plain(grid, 7, 3)
    few = [(5, [0.5, 0.25]), (5, [0.5, 0.25]), (None, [-0.1, 0.0]), (5, [0.1, 0.1])]
    assert got(spark, few, 40, 2, 2) == plain(few, 40, 2)
    assert got(spark, [], 3, 2, 2) == []


def test_left_out_and_clamped(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, [3.0e38, -3.0e38]), (8, [0.0, -0.001])]
    found = {r[0]: r for r in got(spark, rows, 1, 0, 2)}
    assert set(found) == {7, 8}
    # the first centroid is one of the two, at the bounds or near zero
    far = ballmeans.LARGEST
    assert max(found[7][2], found[8][2]) in (far**2 + (far + 1) ** 2, far**2 + (far - 1) ** 2) and min(found[7][2], found[8][2]) == 0


def test_stable_core_is_compared_with_nothing():
    rng = np.random.default_rng(0)
    c = rng.integers(-5000, 5000, (20, 16)).astype("int64")
    guess = rng.integers(0, 20, 4000).astype("int32")
    x = c[guess] + rng.integers(-60, 60, (4000, 16))
    apart = ballmeans.between(c)
    cluster, distance, made = ballmeans.nearest(x, c, apart, guess)
    whole = ballmeans.nearest(x, c, apart, None)
    assert (cluster == whole[0]).all() and (distance == whole[1]).all()
    assert made == len(x) and whole[2] == 20 * len(x)
    # a wrong guess costs comparisons, never the result
    wrong = ballmeans.nearest(x, c, apart, rng.integers(0, 20, 4000).astype("int32"))
    assert (wrong[0] == whole[0]).all() and (wrong[1] == whole[1]).all()


def test_old_rounds_are_deleted(spark):
    import os

    from quillspark.sources import shared

    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(50, 4)).tolist())]
    got(spark, rows, 3, 3, 4)
    left = [d for d in os.listdir(shared.session_dir(spark).removeprefix("file:")) if d.startswith("balls-")]
    assert len({d.rsplit("-", 1)[0] for d in left}) == len(left)  # the last round of each run
