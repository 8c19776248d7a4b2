import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import ranking, rules, stats
from quillspark.llm.common import table

SF = "/root/testdata/sf0.1"


def base_by_hand(text):
    """The base counts by their definition."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = [], 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.append(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(inside)


@pytest.mark.parametrize("seed", range(20))
def test_base_counts(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "b ", "c\n", "\u00a0", "\x0b", "# ", "é ", "\n", "a b a b a b ", "x|y "]) for _ in range(r.randrange(120)))
    assert stats.of(text)[:5] == base_by_hand(text)


def test_empty_texts():
    assert stats.of(None) == stats.of("") and stats.of("")[:5] == (0, 0, 0, 0, 0)


@pytest.fixture(scope="module")
def labelled_rows(spark):
    both = table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id").select("doc_id", "text", "quality").collect()
    return [(r.doc_id, stats.of(r.text), r.quality, ranking.described(r.text)) for r in both]


def test_decision_list_on_held_out_rows(labelled_rows):
    learn = [r for r in labelled_rows if r[0] % 3]
    held = [r for r in labelled_rows if r[0] % 3 == 0]
    found = rules.learn(np.asarray([r[1] for r in learn], float), np.asarray([r[2] == 0 for r in learn]))
    x = np.asarray([r[1] for r in held], float)
    rejected = np.zeros(len(x), bool)
    for rule in found:
        rejected |= rules.covered(rule, x)
    wrong = (rejected != np.asarray([r[2] == 0 for r in held])).mean()
    assert found and wrong < 0.03


@pytest.mark.parametrize("seed", range(5))
def test_conditions_are_those_of_the_most_gain(seed):
    """Each condition of a grown rule against all thresholds of all statistics."""
    r = np.random.default_rng(seed)
    rows = r.integers(0, 6, (60, len(rules.NAMES))).astype(float)
    bad = (rows[:, 3] + rows[:, 7] + r.integers(0, 3, 60)) > 8
    rule = rules._grow(rows, bad)
    inside = np.ones(len(rows), bool)

    def gain(c, x, y):
        h = c.holds(x)
        p, n = (y & h).sum(), (~y & h).sum()
        return p * (np.log2(p / (p + n)) - np.log2(y.sum() / len(y))) if p >= rules.LEAST_COVERED else -1.0

    for c in rule:
        x, y = rows[inside], bad[inside]
        every = [rules.Condition(n, above, float(t)) for n in rules.NAMES for above in (True, False) for t in range(6)]
        assert gain(c, x, y) == pytest.approx(max(gain(e, x, y) for e in every))
        inside &= c.holds(rows)
    assert rule and (len(rule) == rules.LONGEST_RULE or not (~bad & inside).any() or all(gain(e, rows[inside], bad[inside]) <= 1e-9 for e in every))
    kept = rules._prune(rule, rows, bad)
    worth = [((bad & rules.covered(rule[:k], rows)).sum() - (~bad & rules.covered(rule[:k], rows)).sum()) / rules.covered(rule[:k], rows).sum() for k in range(1, len(rule) + 1)]
    assert kept == rule[: len(kept)] and worth[len(kept) - 1] == max(worth)


def test_list_covers_in_order_until_rules_are_too_poor():
    r = np.random.default_rng(1)
    rows = r.random((900, len(rules.NAMES)))
    bad = (rows[:, 2] > 0.8) | (rows[:, 5] < 0.1)
    found = rules.learn(rows, bad)
    left = np.ones(len(rows), bool)
    for rule in found:
        c = rules.covered(rule, rows) & left
        assert bad[c].mean() >= rules.LEAST_PRECISION
        left &= ~c
    assert (bad & left).mean() < 0.02


def test_expression_says_what_the_list_says(spark, labelled_rows):
    x = np.asarray([r[1] for r in labelled_rows[:800]], float)
    found = rules.learn(x, np.asarray([r[2] == 0 for r in labelled_rows[:800]]))
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"{n} double" for n in rules.NAMES))
    got = [r.kept for r in df.select(rules.expression(found).alias("kept")).collect()]
    want = np.ones(len(x), bool)
    for rule in found:
        want &= ~rules.covered(rule, x)
    assert got == want.tolist()


def test_ranking_on_held_out_rows(labelled_rows):
    learn = [r for r in labelled_rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    held = [r for r in labelled_rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    ranker = ranking.Ranker(np.asarray([r[3] for r in learn]), np.asarray([r[2] for r in learn]))
    s = ranker.score(np.asarray([r[3] for r in held]))
    wrong = ((s >= ranking.THRESHOLD) != np.asarray([r[2] == 1 for r in held])).mean()
    assert wrong < 0.03 and s.min() >= 0 and s.max() <= 1


@pytest.mark.parametrize("seed", range(4))
def test_weights_have_the_greatest_likelihood(seed):
    """Against plain gradient ascent over all pairs, one by one."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(14, 3))
    label = (x @ [1.0, -2.0, 0.5] + r.normal(size=14) > 0).astype(int)
    label[:2] = 0, 1
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    w = np.zeros(3)
    for _ in range(6000):
        grad = -ranking.RIDGE * w
        for i in good:
            for j in bad:
                d = x[i] - x[j]
                grad = grad + d / (1 + np.exp(d @ w))
        w = w + 0.02 * grad
    assert ranking.bradley_terry(x, *ranking.pairs_of(good, bad)) == pytest.approx(w, abs=1e-5)


def test_threshold_is_the_quantile_of_all_labels():
    scores = np.asarray([5.0, 1.0, 2.0, 3.0, 4.0])
    assert ranking.quantile(scores, np.ones(5), 0.4) == 2.5
    assert ranking.quantile(scores, np.asarray([1.0, 6.0, 1.0, 1.0, 1.0]), 0.6) == 1.5
    r = np.random.default_rng(1)
    rows = np.abs(r.normal(size=(300, len(ranking.NAMES) + ranking.WORD_BUCKETS)))
    label = np.arange(300) % 2
    rows[:, ranking._USED[0]] += 1.5 * label
    for totals in ((150, 150), (100, 900), (900, 100)):
        ranker = ranking.Ranker(rows, label, totals)
        weight = np.where(label == 1, totals[1], totals[0]) / 150
        low = weight[ranker.score(rows) < ranking.THRESHOLD].sum() / weight.sum()
        assert low == pytest.approx(totals[0] / sum(totals), abs=0.02)


def test_ties_at_the_threshold_are_kept():
    rows = np.zeros((6, len(ranking.NAMES) + ranking.WORD_BUCKETS))
    got = ranking.Ranker(rows, np.asarray([0, 0, 0, 1, 1, 1])).score(rows)
    assert (got >= ranking.THRESHOLD).all()


def test_words_tell_where_statistics_do_not():
    texts = ["good " * 3 + "aaaa bbbb cccc dddd" if k % 2 else "evil " * 3 + "aaaa bbbb cccc dddd" for k in range(80)]
    rows = np.vstack([ranking.described(t) for t in texts])
    ranker = ranking.Ranker(rows, np.arange(80) % 2)
    a, b = ranker.score(np.vstack([ranking.described("good good bbbb"), ranking.described("evil evil bbbb")]))
    assert a > b


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a b c d e f g h i j", 5), (3, "a b c d e f g h i j", 5), (None, "w " * 100_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id bigint, quality int")
    out = rules.judged(docs, labels).collect()
    assert len(out) == 5 and {r.doc_id: r.base_failed for r in out} == {1: True, 2: True, 3: False, None: True}
    assert all(r.kept is False for r in out if r.base_failed)
    none = labels.where("false")
    assert [r.kept for r in rules.judged(docs, none).where("doc_id = 3").collect()] == [True, True]
    scores = ranking.scored(docs, labels).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores)
    assert {r.score for r in ranking.scored(docs, none).collect()} == {0.5}
    empty = docs.where("false")
    assert rules.judged(empty, labels).count() == 0 and ranking.scored(empty, labels).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs_are_learned_from_without_being_made(seed):
    """Sums by scores against the plain form over every pair."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(90, 4))
    label = (x @ [1.0, -2.0, 0.5, 0.0] + r.normal(size=90) > 0.5).astype(int)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    got = ranking.all_pairs(ranking.in_blocks(x, label), lambda rows: rows, 4, (len(bad), len(good)))
    assert got == pytest.approx(ranking.bradley_terry(x, *ranking.pairs_of(good, bad)), abs=1e-4)


def test_every_labelled_text_is_learned_from(spark):
    """More labels of 0 than the 4,000 that were learned from before: a word of few of them is known."""
    n = 6000
    docs = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 6 = 1 THEN 'good plain text here' ELSE concat('evil ', 'w', id % 7, ' text') END AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 6 = 1 AS int) AS quality")
    rows = ranking.appended(docs, "text", lambda: lambda texts: {"row": [ranking.packed(t) for t in texts]}, [ranking.T.StructField("row", ranking.T.BinaryType())], without=("text",))
    seen = ranking.in_tasks(rows.join(labels, "doc_id").select("row", "quality"))(lambda own, label: np.asarray([len(own), label.sum()], float))
    assert seen.tolist() == [n, n / 6]
    ranker = ranking.trained(rows, labels, ranking.F.lit(True))
    want = [r.text.startswith("good") for r in docs.collect()]
    assert (ranker.score(np.vstack([ranking.described(r.text) for r in docs.collect()])) >= ranking.THRESHOLD).tolist() == want
