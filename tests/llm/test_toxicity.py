import random
import re
import zlib

import numpy as np
import pytest

from quillspark.llm import toxicity
from quillspark.llm.common import table, training_sample

SF = "/root/testdata/sf0.1"


def kernel_by_hand(a, b):
    """The sum over common triples within the span, by definition."""

    def places(s):
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0.0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = places(a), places(b)
    return sum(v * y.get(t, 0.0) for t, v in x.items())


def window(text):
    codes, starts, ends, _ = toxicity.windows_of([text])
    return codes[starts[0] : ends[0]].tobytes()


PAIRS = [("idiot", "idxiot"), ("moron", "moronic"), ("abc", "xyz"), ("banana", "bandana"), ("混蛋混蛋", "你好混蛋")]


@pytest.mark.parametrize("a,b", PAIRS)
def test_kernel_is_that_of_the_definition(a, b):
    every = toxicity._CODES**3
    codes = [window(a), window(b)]
    f = toxicity.features(codes, np.arange(every), every)
    norms = toxicity._norms(np.asarray([len(c) for c in codes]))
    assert float(f[0] @ f[1]) * norms[0] * norms[1] == pytest.approx(kernel_by_hand(*codes), rel=1e-4)


def test_running_sums_give_the_kernel():
    """Scores of windows of a text are kernel values where the machine is one window."""
    text = "You are an id-iot, x moron. Was für ein Idiot! And idi ots are worthlesssssssssssssssssssssssssssssss"
    other = window("idiot")
    own = toxicity.features([other], np.arange(toxicity._CODES**3), toxicity._CODES**3)[0]
    codes, starts, ends, _ = toxicity.windows_of([text])
    got = toxicity.linear(codes, starts, ends, own.reshape((toxicity._CODES,) * 3))
    for a, b, v in zip(starts, ends, got):
        one = codes[a:b].tobytes()
        norms = toxicity._norms(np.asarray([len(one), len(other)]))
        assert v == pytest.approx(kernel_by_hand(one, other) / norms[0] / norms[1], abs=1e-6)


def test_landmarks_features_give_their_kernel():
    codes = [window(w) for w in ("idiot", "idiotic", "moron", "moronic", "worthless", "flower", "flowers")]
    space = toxicity.Nystrom(codes)
    x = space(codes)
    norms = toxicity._norms(np.asarray([len(c) for c in codes]))
    for i, a in enumerate(codes):
        for j, b in enumerate(codes):
            assert x[i] @ x[j] == pytest.approx(kernel_by_hand(a, b) / norms[i] / norms[j], abs=1e-3)
    w = np.arange(x.shape[1], dtype=float)
    line, starts, ends, _ = toxicity.windows_of(["idiotic"])
    assert toxicity.linear(line, starts, ends, space.primal(w))[0] == pytest.approx(x[1] @ w, rel=1e-3)


@pytest.mark.parametrize("seed", range(3))
def test_machine_has_the_least_loss(seed):
    """Against plain gradient descent."""
    r = np.random.default_rng(seed)
    x, y = r.normal(size=(40, 3)), np.sign(r.normal(size=40))
    weight = r.uniform(0.5, 2, 40)
    one = np.hstack([x, np.ones((40, 1))])
    ridge = np.asarray([1, 1, 1, 1e-3])
    w = np.zeros(4)
    for _ in range(20000):
        slack = np.maximum(0, 1 - y * (one @ w))
        w -= 1e-3 * (ridge * w - 4.0 * (weight * slack * y) @ one)
    assert toxicity.squared_hinge(x, y, weight) == pytest.approx(w, abs=1e-4)


def test_folding():
    assert window("Ídïot!") == window("idiot") == window("i.d.i.o.t") == window("i d i o t") == window("I D I O T")
    assert window("你好") != window("混蛋") and window("дурак") != window("книга")


def words_by_hand(text):
    out = []
    for sentence in re.split(r"[.!?]+(?=\s|\Z|[A-Z][a-z])|\n", text):
        own = [w for w in (re.sub("[^a-z]", "", w.lower()) for w in sentence.split()) if w]
        out += own + [" ".join(p) for p in zip(own, own[1:])]
    return sorted(w for w in out if len(w) > 1)


@pytest.mark.parametrize("seed", range(10))
def test_windows_by_hand(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word", "some", "Other", " ", " ", ". ", ", ", "! ", ".", "\n", "--", "it's", " 'q' "]) for _ in range(60))
    codes, starts, ends, _ = toxicity.windows_of([None, text, ""])
    letters = {toxicity._START: " ", **{k: chr(96 + k) for k in range(1, 27)}}
    got = sorted("".join(letters[c] for c in codes[a:b]).strip() for a, b in zip(starts, ends))
    # words of over 23 letters are in pieces
    assert [w for w in got if all(len(x) < 11 for x in w.split())] == [w for w in words_by_hand(text) if all(len(x) < 11 for x in w.split())]


def test_every_code_of_a_long_word_is_in_a_window():
    codes, starts, ends, _ = toxicity.windows_of(["ab" * 500 + " x" * 3])
    assert (ends - starts).max() <= toxicity.LONGEST
    assert set(range(1001)) <= {i for a, b in zip(starts, ends) for i in range(a, b)}


@pytest.mark.parametrize("insult, plain", [("混蛋", "你好"), ("дурак", "книга"), ("drop dead", "drop by")])
def test_insults_of_other_scripts_and_of_two_words_are_learned(insult, plain):
    r = random.Random(1)
    words = ["the", "of", "дом", "день", "天气", "book", "dead", "river", plain, "yes"]
    rows = []
    for k in range(240):
        own = [r.choice(words) for _ in range(12)]
        if k % 3 == 0:
            own[r.randrange(12)] = insult
        rows.append((" ".join(own), int(k % 3 == 0)))
    model = toxicity.fit(rows)
    assert model(["the " + insult + " of", "the " + plain + " of river"]) == pytest.approx([1, 0], abs=0.3)


def test_offset_follows_the_share_of_all_labels():
    r = random.Random(2)
    rows = [(" ".join(r.choice(["blue", "red", "green", "idiot" if k % 2 or r.random() < 0.3 else "sky"]) for _ in range(4)), k % 2) for k in range(300)]
    few, many = toxicity.fit(rows, (9000, 100)), toxicity.fit(rows, (100, 9000))
    assert few(["red sky"])[0] < many(["red sky"])[0]


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.trained(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_held_out_accuracy(spark, model):
    both = table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id").select("doc_id", "text", "toxic").collect()
    held = [r for r in both if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    scores = model([r.text for r in held])
    wrong = sum((s >= 0.5) != bool(r.toxic) for r, s in zip(held, scores))
    assert wrong <= 0.025 * len(held)  # some labels are noise


def test_gapped_insults(model):
    clean, *toxic = model(["the and of thing", "the and idiot of", "the and id-iot of", "the and i d i o t of", "the and idxiot of", "the and idi ot of"])
    assert clean < 0.5
    assert min(toxic) >= 0.5


def test_edges(spark, model):
    rows = [(1, None, 9.0), (2, "", 9.0), (3, "idiot " * 30_000, 9.0), (3, "idiot", 9.0), (None, "moron", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    out = toxicity.scored(docs, model).collect()
    assert sorted(r.predicted for r in out) == [0, 0, 1, 1, 1]
    assert out[0].asDict().keys() == {"doc_id", "score", "predicted"}
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 2
    empty = spark.createDataFrame([], docs.schema)
    assert toxicity.scored(empty, model).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "idiot")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    m = toxicity.trained(docs, none)
    assert toxicity.scored(docs, m).first().score == 0.0


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    from quillspark.llm.common import held_out

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    sample = training_sample(docs, labels, "toxic", ~held_out("doc_id", 5, 0), {0: 50, 1: 20}).collect()
    assert sum(r.label for r in sample) == 20 and len(sample) == 70


def long_texts(n, words=400):
    r = random.Random(5)
    own = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    return [" ".join(r.choice(own) + r.choice(["", "", "", ".", "\n", " ü"]) for _ in range(words)) for _ in range(n)] + ["", None, "a", "x" * 3000]


def test_windows_by_portions_are_those_of_all_texts(monkeypatch):
    texts = long_texts(60)
    whole = toxicity.windows_of(texts)
    monkeypatch.setattr(toxicity, "BLOCK", 5000)
    for a, b in zip(toxicity.all_windows(texts), whole):
        assert a.tolist() == b.tolist()
    for none in ([], [""], [None, "?"]):
        assert [x.tolist() for x in toxicity.all_windows(none)] == [[], [], [], []]


def test_training_holds_little_more_than_the_windows():
    import tracemalloc

    texts = long_texts(1200)
    label = np.arange(len(texts)) % 3 == 0
    tracemalloc.start()
    try:
        sample = toxicity._Sample([t or "" for t in texts], label.astype(int))
        a_window = tracemalloc.get_traced_memory()[1] / len(sample.starts)
    finally:
        tracemalloc.stop()
    hashes = {}
    for k, (s, e) in enumerate(zip(sample.starts.tolist(), sample.ends.tolist())):
        hashes.setdefault(sample.codes[s:e].tobytes(), []).append(k)
    assert len(sample.first) == len(hashes) and sorted(sample.first.tolist()) == [own[0] for own in hashes.values()]
    assert all(len(set(sample.kind[own].tolist())) == 1 for own in hashes.values())
    assert a_window < 80, a_window
