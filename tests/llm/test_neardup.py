import random
import re

import numpy as np
import pytest

from quillspark.llm import neardup


def words(r, n):
    return ["w%d" % r.randrange(5000) for _ in range(n)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("chunk", [7, neardup.CHUNK])
@pytest.mark.parametrize("seed", range(10))
def test_banded_alignment_is_the_common_subsequence(seed, chunk, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    r = random.Random(seed)
    a = [r.randrange(6) for _ in range(r.randrange(0, 40))]
    b = [x for x in a if r.random() > 0.2] + [r.randrange(6) for _ in range(r.randrange(3))]
    x, y = np.asarray(a, "uint64"), np.asarray(b, "uint64")
    want = lcs(a, b)
    assert neardup.common_within(x, y, len(a) + len(b)) == want
    d = len(a) + len(b) - 2 * want
    assert neardup.common_within(x, y, d) == want
    if d:
        assert neardup.common_within(x, y, d - 1) is None


def test_words_are_plain():
    a, b = neardup.word_hashes("Hello, (world) -- it's"), neardup.word_hashes("hello world it's")
    assert (a == b).all()


@pytest.mark.parametrize("portion", [neardup.PORTION, 40, 3])
def test_words_by_regex(portion, monkeypatch):
    monkeypatch.setattr(neardup, "PORTION", portion)
    r = random.Random(portion)
    texts = [None, "", " ", "...", "one"] + ["".join(r.choice(["a", "B", "é", "Straße", " ", "\n", "\u2003", "-", "_", "'", "中文", "(x)", "\x1c", "word"]) for _ in range(r.randrange(60))) for _ in range(60)]
    names = {}
    for text, got in zip(texts, neardup.words_of(texts)):
        parts = [p for w in (text or "").lower().split() for p in re.split("([\u4e00-\u9fff])", w)]  # characters of Chinese are words
        want = [w for w in (re.sub(r"^\W+|\W+$", "", p) for p in parts) if w]
        assert len(got) == len(want)
        for w, h in zip(want, got.tolist()):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def edited(r, own, share):
    return [w if r.random() > share else "x%d" % r.randrange(10**6) for w in own]


def corpus(seed=1):
    r = random.Random(seed)
    texts, passage = [], words(r, 60)
    for _ in range(60):
        own = words(r, r.randrange(60, 400))
        texts.append(own)
        for _ in range(r.choice((0, 0, 1, 3))):
            texts.append(edited(r, own, r.choice((0.0, 0.02, 0.05))))
        if r.random() < 0.4:
            texts.append(words(r, r.randrange(20, 200)) + passage)
    hot = words(r, 150)
    texts += [edited(r, hot, 0.03) for _ in range(80)]
    r.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def brute(rows):
    """Components of all pairs that are similar."""
    own = {i: neardup.word_hashes(t or "") for i, t in rows}
    label = {i: i for i, _ in rows}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, t) in enumerate(rows):
        for j, u in rows[:k]:
            if t == u or neardup.similarity(own[i], own[j]) >= neardup.SIMILAR:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_classes_are_those_of_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = corpus(2)
    docs = spark.createDataFrame([(i, t, "s", i) for i, t in rows], "doc_id bigint, text string, source string, class_id bigint")
    out = neardup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute(rows).values()))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (5, "A, b."), (6, "w " * 60_000), (6, "w " * 60_000), (None, "a b"), (None, None), (7, "..."), (8, "???"), (None, "lone text"), (None, "lone text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = neardup.classes(docs).collect()
    assert len(got) == len(rows)
    label = {r.doc_id: r.class_id for r in got if r.doc_id}
    assert label == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8}
    assert sorted(r.class_id or 0 for r in got if r.doc_id is None) == [0, 0, 1, 3]
    kept = neardup.deduplicated(docs)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "lone text"), (1, ""), (3, "a b"), (6, "w " * 60_000), (7, "..."), (8, "???")]
    assert neardup.classes(docs.where("false")).count() == 0 and neardup.deduplicated(docs.where("false")).count() == 0


def test_no_text_goes_because_of_its_id(spark):
    rows = [(5, "aaa bbb"), (5, "zzz qqq"), (6, "zzz qqq")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "7 AS row", "'x' AS doc")
    out = neardup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(5, "aaa bbb"), (5, "zzz qqq")]


def test_versions_that_grow_are_one_class(spark):
    r = random.Random(5)
    rows = []
    for k in range(60):  # the first is like the second and the second like the third only
        first = words(r, 400)
        second = first + words(r, 12)
        third = second + words(r, 101)
        rows += [(10 * k, " ".join(first)), (10 * k + 1, " ".join(second)), (10 * k + 2, " ".join(third))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert brute(rows) == {i: i // 10 * 10 for i, _ in rows}
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == brute(rows)


def test_a_far_relative_of_a_large_group_is_found(spark):
    r = random.Random(8)
    first = words(r, 300)
    rows = [(k, " ".join(edited(r, first, 0.03))) for k in range(120)]
    step = first
    for k in range(120, 126):  # each is like the one before, and only the first of them like the group
        step = edited(r, step, 0.11)
        rows.append((k, " ".join(step)))
    want = brute(rows)
    assert set(want.values()) == {0}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == want


@pytest.mark.parametrize("n", [20, 40, 200, 600])
@pytest.mark.parametrize("share", [0.05, 0.1, 0.13, 0.15, 0.17, 0.19, 0.2])
def test_recall_of_lone_pairs_by_similarity(n, share):
    r = np.random.default_rng(n)
    texts = []
    for _ in range(200):
        a = r.integers(1, 2**62, n).astype("uint64")
        b = a.copy()
        at = r.choice(n, int(share * n), replace=False)
        b[at] = r.integers(1, 2**62, len(at)).astype("uint64")
        assert neardup.similarity(a, b) >= neardup.SIMILAR
        texts += [a, b]
    got = neardup.sketches(texts)
    assert sum((p == q).any() for p, q in zip(got[::2], got[1::2])) >= 0.9 * 200


def test_sketches_do_not_depend_on_what_is_beside():
    r = np.random.default_rng(3)
    texts = [r.integers(1, 50, n).astype("uint64") for n in (1, 2, 3, 4, 5, 700, 9000, 4098, 4099, 4100)]
    for t, s in zip(texts, neardup.sketches(texts)):
        assert (neardup.sketches([t])[0] == s).all()


def test_long_texts_are_aligned_soon():
    r = np.random.default_rng(4)
    a = r.integers(1, 5000, 30_000).astype("uint64")
    b = a.copy()
    b[r.choice(len(a), 3000, replace=False)] = 0
    assert neardup.similarity(a, b) == pytest.approx(0.9, abs=0.01)
    assert neardup.similarity(a, r.permutation(a)) == 0.0


def test_scripts_without_spaces():
    """Characters of Chinese, Japanese or Thai are words."""
    h = neardup.word_hashes("清晨，她来到。abc海 边 x ไม้")
    assert len(h) == 12  # the characters of Chinese and Thai, abc and x


@pytest.mark.parametrize("side", [2048, 24])
def test_all_that_agree_on_a_sketch_are_compared_in_large_groups_too(spark, side, monkeypatch):
    """Pairs near 0.8 among texts of one template, whose groups are all large."""
    monkeypatch.setattr(neardup, "SIDE", side, raising=False)
    r = random.Random(11)
    shared, rows = words(r, 130), []
    for _ in range(100):
        own = shared + words(r, 70)
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(edited(r, own, 0.17)))]
    texts = [neardup.word_hashes(t) for _, t in rows]
    picks = neardup.sketches(texts)
    want = {i: i for i, _ in rows}
    for i in range(len(rows)):
        for j in range(i):
            if (picks[i] == picks[j]).any() and want[i] != want[j] and neardup.similarity(texts[i], texts[j]) >= neardup.SIMILAR:
                a, b = want[i], want[j]
                want = {k: min(a, b) if v in (a, b) else v for k, v in want.items()}
    assert len(set(want.values())) < 150
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {x.doc_id: x.class_id for x in neardup.classes(docs).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_blocks_leave_out_only_what_cannot_be_similar(seed):
    import pyarrow as pa

    r = np.random.default_rng(seed)
    base, texts = r.integers(1, 400, 90), []
    for k in range(60):
        t = base.copy()
        at = r.choice(90, int(r.integers(0, 40)), replace=False)
        t[at] = r.integers(1, 400, len(at))
        texts.append(neardup.mixed(t[: int(r.integers(60, 91))].astype("uint64")))
    label, apart = r.integers(0, 8, 60), np.zeros(60, bool)
    apart[:25] = True
    label[25:] = 99  # the first one's class
    bag = [np.bincount((neardup.mixed(t) % np.uint64(neardup.BAG)).astype("int64"), minlength=neardup.BAG).astype("<u2").tobytes() for t in texts]
    both = [(i, len(texts[i]), int(label[i]), bool(apart[i]), asks, bag[i]) for asks in (True, False) for i in range(60) if apart[i] or not asks]
    group = pa.table(dict(zip(("node", "n", "x", "apart", "asks", "bag"), (list(c) for c in zip(*both)))))
    got = neardup.likely_pairs(group).to_pylist()
    found = {(p["node"], p["leader"]) for p in got}
    assert len(found) == len(got) and all(label[a] != label[b] for a, b in found)
    for i in range(60):
        for j in range(i):
            if label[i] != label[j] and neardup.similarity(texts[i], texts[j]) >= neardup.SIMILAR:
                assert (i, j) in found


def test_no_table_has_a_row_for_each_pair_of_a_large_group(spark, monkeypatch):
    """Orders of the same words behind one passage: all pairs share sketches and words, and only copies are similar."""
    r = random.Random(12)
    shared, own, rows = words(r, 100), ["w%d" % k for k in range(60)], []
    for _ in range(300):
        r.shuffle(own)
        rows.append((len(rows), " ".join(shared + own)))
    rows += [(300 + k, rows[7 * k][1] + " end") for k in range(20)]
    sizes, stashed = [], neardup.stashed

    def counted(df):
        out = stashed(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(neardup, "stashed", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.class_id for x in neardup.classes(docs).collect()}
    assert got == {i: i if i < 300 else 7 * (i - 300) for i in range(320)}
    assert max(sizes) <= neardup.SKETCHES * len(rows)  # what each text agrees on


@pytest.mark.parametrize("seed", range(4))
def test_a_block_joins_what_all_of_its_pairs_join(seed):
    import pyarrow as pa

    r = np.random.default_rng(seed)
    texts = []
    for k in range(90):
        t = texts[int(r.integers(0, k))].copy() if k and r.random() < 0.6 else r.integers(1, 60, 90).astype("uint64")
        t[r.choice(90, int(r.integers(0, 25)), replace=False)] = r.integers(60, 400)
        texts.append(t)
    x, apart = np.arange(90), np.arange(90) < 70
    x[70:] = 99  # the first one's class
    keys = [sorted({5, *r.choice([3, 8], 1).tolist()}) for _ in range(90)]
    block = pa.table({"node": list(range(90)), "x": x.tolist(), "apart": apart.tolist(), "asks": apart.tolist(), "asked": [True] * 90, "key": [5] * 90, "keys": keys, "words": [t.tobytes() for t in texts]})

    def label(pairs):
        own = x.tolist()
        for a, b in pairs:
            one, other = sorted((own[a], own[b]))
            own = [one if c == other else c for c in own]
        return own

    got = [(p["node"], p["leader"]) for p in neardup.decided(block).to_pylist()]
    assert all(neardup.similarity(texts[a], texts[b]) >= neardup.SIMILAR for a, b in got)
    want = [(i, j) for i in range(90) for j in range(i) if not (3 in keys[i] and 3 in keys[j]) and neardup.similarity(texts[i], texts[j]) >= neardup.SIMILAR]
    assert label(got) == label(want) and 0 < len(got) < 90 and len(set(label(want))) < len(set(x.tolist()))


def test_short_texts_with_one_word_changed_are_found(spark):
    """Of texts of few words all pairs that are similar, though they have no two k-mers in common."""
    r, rows = random.Random(21), []
    for n in range(3, 10):
        for k in range(40):
            own, at = words(r, n), r.randrange(n)
            other = [own[:at] + ["x"] + own[at + 1 :], own[:at] + own[at + 1 :], own[:at] + ["x"] + own[at:], own[:at] + ["x"] + own[at + 2 :]][k % 4]
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(other))]
    rows += [(len(rows), "w w w w w"), (len(rows) + 1, "w w w w")]
    want = brute(rows)
    assert 100 < len(rows) - len(set(want.values())) < 250
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {x.doc_id: x.class_id for x in neardup.classes(docs).collect()} == want


@pytest.mark.parametrize("n", range(3, 10))
def test_short_texts_agree_just_if_similar(n):
    r = random.Random(n)
    texts = [np.asarray([r.randrange(1, 4) for _ in range(r.randint(n, min(9, n + 1)))], "uint64") for _ in range(150)]
    for k, a in enumerate(texts):
        for b in texts[:k]:
            if min(len(a), len(b)) >= neardup.FEWEST:
                assert bool(set(neardup.shortened(a).tolist()) & set(neardup.shortened(b).tolist())) == (neardup.similarity(a, b) >= neardup.SIMILAR)
