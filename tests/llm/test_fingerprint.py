import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import fingerprint as fp


def phrases(text):
    """Each the shortest that no earlier one equals; what is left over at the end is none."""
    seen, phrase = [], ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.append(phrase)
            phrase = ""
    return seen


@pytest.mark.parametrize("seed", range(12))
def test_phrases_and_shared_parse(seed):
    r = random.Random(seed)
    text = "".join(r.choice("abcé 😀") for _ in range(r.randrange(0, 400)))
    other = "".join(r.choice("abc ") for _ in range(r.randrange(0, 400)))
    seen = {}
    fp._parse(text, seen, "")
    assert list(seen) == phrases(text)
    edited = fp.edited_text(text, other)
    f, g = fp.fingerprints(text, edited)
    assert (f == fp.fingerprint(text)).all() and (g == fp.fingerprint(edited)).all()


def test_equal_phrases_have_equal_hashes():
    a, b = {}, {}
    fp._parse("abcabcabcabd", a, "")
    fp._parse("zzabcabcabcabd", b, "")
    h = dict(zip(a, fp._hashes("abcabcabcabd", fp._lengths(a))))
    g = dict(zip(b, fp._hashes("zzabcabcabcabd", fp._lengths(b))))
    assert all(h[p] == g[p] for p in h.keys() & g.keys())
    assert len(set(h.values())) == len(h)


def test_likeness_is_that_of_the_phrase_sets():
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh ") for _ in range(300))
    edited = fp.edited_text(text, "".join(r.choice("abcdefgh ") for _ in range(300)))
    a, b = set(phrases(text)), set(phrases(edited))
    got = fp.likeness(*fp.fingerprints(text, edited))
    assert abs(got - len(a & b) / len(a | b)) < 0.2
    assert fp.likeness(np.empty(0, "uint32"), np.empty(0, "uint32")) == 1.0
    assert fp.likeness(np.empty(0, "uint32"), np.asarray([1], "uint32")) == 0.0


@pytest.mark.parametrize("n", [1, 2, 37, 1300])
def test_documents_against_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 10)
    r = random.Random(n)
    rows = [(i * 3 - 20, None if i == 5 else "".join(r.choice("abcé ") for _ in range(r.randrange(0, 90))), "x") for i in range(n)]
    docs = spark.createDataFrame(r.sample(rows, n), "doc_id bigint, text string, bucket string")
    out = {x.doc_id: x for x in fp.fingerprinted(docs).collect()}
    assert len(out) == n
    for k, (i, text, _) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % n][1] or ""
        edited = fp.edited_text(text, after)
        got = out[i]
        assert got.n_chars == len(text)
        assert got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got.fingerprint == fp.told(fp.fingerprint(text))
        assert got.edited_fingerprint == fp.told(fp.fingerprint(edited))
        assert got.near_edited == fp.likeness(fp.fingerprint(text), fp.fingerprint(edited))
        assert got.near_next == fp.likeness(fp.fingerprint(text), fp.fingerprint(after))


@pytest.mark.parametrize("hot", [None, 7])
def test_many_rows_of_one_id_are_split(spark, hot, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 10)
    r = random.Random(3)
    rows = [(hot if i % 3 else i, "".join(r.choice("abcé ") for _ in range(30)) + str(i)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    dealt = fp.bucketed(docs, len(rows), sum(i is None for i, _ in rows))
    sizes = {x.bucket: x["count"] for x in dealt.groupBy("bucket").count().collect()}
    assert len(sizes) > 60 and max(sizes.values()) < 60
    order = [(x.doc_id is not None, x.doc_id or 0, x.hash, x.bucket, x.text) for x in dealt.collect()]
    order.sort()
    assert [x[3] for x in order] == sorted(x[3] for x in order)
    texts = [x[4] for x in order]
    want = sorted(hashlib.sha256(fp.edited_text(t, texts[(k + 1) % len(texts)]).encode()).hexdigest() for k, t in enumerate(texts))
    assert sorted(x.edited_sha256 for x in fp.fingerprinted(docs).collect()) == want


def test_edges(spark):
    rows = [(1, "a"), (1, "a"), (1, "b" * 200_000), (None, "c"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = fp.fingerprinted(docs).collect()
    assert len(out) == 5 and sum(r.doc_id is None for r in out) == 2
    assert fp.fingerprinted(docs.where("false")).count() == 0
