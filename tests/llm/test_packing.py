import random
import zlib

import numpy as np
import pytest

from quillspark.llm import packing
from quillspark.llm.common import tokenizer_path

TEXTS = ["", None, " ", "one", "a  b", "a \n b", "x\n foo", "don't  ", " a\u3000b c", "a\x1cb c\x1d d", "  lead", "tab\tx y", "<|endoftext|> hi", "hi <|endoftext|> x", "a <|endoftext|><|endoftext|>", "<|endoftext |>", "é 中文 字 😀 ok", "it 's 're", "word " * 5000]


def reference_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [*t.encode(text or "", add_special_tokens=False).ids, packing.END]


def test_ids_are_those_of_the_tokenizer():
    ids = packing.Ids(tokenizer_path())
    for text, got in zip(TEXTS, ids([t or "" for t in TEXTS])):
        assert np.frombuffer(got, "<u4").tolist() == reference_ids(text)


def test_added_tokens_in_a_text_are_themselves():
    got = packing.Ids(tokenizer_path())(["hi <|endoftext|> x"])[0]
    assert np.frombuffer(got, "<u4").tolist() == [5303, 220, 50256, 2124, 2]


def test_cuts():
    assert packing.cuts(1) == [(0, 1)]
    assert packing.cuts(1024) == [(0, 1024)]
    assert packing.cuts(2050) == [(0, 2), (2, 1024), (1026, 1024)]


@pytest.mark.parametrize("seed", range(8))
def test_pack_fills_no_bin_beyond_its_size_and_loses_nothing(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 1023) if seed % 2 else min(1023, int(r.lognormvariate(5, 1)) + 1) for _ in range(600)]
    at, offset = packing.pack(lengths)
    places = {}
    for n, b, o in zip(lengths, at, offset):
        places.setdefault(b, []).append((o, n))
    for own in places.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= 1024
    assert len(places) >= -(-sum(lengths) // 1024)


def brute_least_bins(lengths, size):
    """The least number of bins, by trying every assignment."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= size:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        bins.append(lengths[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_pack_is_near_the_least_number(seed):
    r = random.Random(100 + seed)
    lengths = [r.randint(60, 700) for _ in range(9)]
    assert len(set(packing.pack(lengths)[0])) <= brute_least_bins(lengths, 1024) + 1


def test_local_search_raises_squared_fill():
    r = random.Random(5)
    bins = packing.Bins([r.randint(200, 500) for _ in range(400)])
    for i, n in enumerate(bins.lengths):  # a poor start: two in a bin
        if i % 2:
            bins.items[-1].append(i)
            bins.fill[-1] += n
        else:
            bins.items.append([i])
            bins.fill.append(n)
    before = sum(f * f for f in bins.fill)
    bins.improve()
    assert sum(f * f for f in bins.fill) > before
    assert sorted(i for own in bins.items for i in own) == list(range(400))
    assert sum(map(bool, bins.items)) < 200


def test_documents_round_trip(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(3, "one", "extra"), (None, "no id", "extra")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length string")
    out = packing.pack_documents(docs, shard=8).toPandas()
    by_sequence = {}
    for r in out.itertuples():
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= 1024
    long = out[out.doc_id == len(TEXTS) - 1].sort_values("piece")
    ids = np.asarray(reference_ids(TEXTS[-1]), "<u4")
    assert long.length.sum() == len(ids)
    assert (long.length.iloc[1:] == 1024).all()
    for r in long.itertuples():
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert (out.doc_id == 3).sum() == 2
    assert out.doc_id.isna().sum() == 1


def test_no_documents(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("seed, n, low, high", [(9, 80, 60, 300), (31, 100, 200, 500), (120, 40, 60, 200), (122, 60, 100, 300)])
def test_search_looks_at_all_items_and_bins(seed, n, low, high):
    r = random.Random(seed)
    lengths = [r.randint(low, high) for _ in range(n)]
    assert len(set(packing.pack(lengths)[0])) == -(-sum(lengths) // 1024)


@pytest.mark.parametrize("seed", range(6))
def test_no_step_is_left_between_any_two_bins(seed):
    from itertools import combinations

    r = random.Random(200 + seed)
    low, high = ((20, 150), (60, 300), (200, 500))[seed % 3]
    bins = packing.Bins([r.randint(low, high) for _ in range(150)])
    bins.best_fit()
    bins.improve()
    assert sorted(i for own in bins.items for i in own) == list(range(150))
    assert bins.fill == [sum(bins.lengths[i] for i in own) for own in bins.items]
    under = [b for b in range(len(bins.items)) if 0 < bins.fill[b] < 1024]
    some = {b: {k: {sum(bins.lengths[i] for i in c) for c in combinations(bins.items[b], k)} for k in range(3)} for b in under}
    for b in under:
        for other in under:
            steps = [t - g for g in set().union(*some[b].values()) for t in some[other][1] | some[other][2] if other != b]
            assert not any(0 < s <= 1024 - bins.fill[b] and bins.fill[b] + s > bins.fill[other] for s in steps)
