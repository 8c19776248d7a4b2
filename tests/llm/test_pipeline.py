import random

from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import neardup, secrets, toxicity
from quillspark.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    read = docs
    names = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, read, SF)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        got = spark.read.parquet(path)
        names.append(name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == docs.columns
        if name == "toxicity":
            model = toxicity.trained(docs, table(spark, SF, "labels"))
            scores = model([r.text for r in read.collect()])
            assert got.count() == sum(s < 0.5 for s in scores)
        elif name == "minhash_near_dedup":
            assert got.count() == neardup.classes(read).select("class_id").distinct().count()
        elif name == "secret_scan":
            assert got.count() == read.count()
            assert not any(secrets.found_in(r.text) for r in got.collect())
            assert got.where(F.length("text") != F.col("n_chars")).count() == 0
        elif name == "source_mixing":
            assert got.join(read, "doc_id", "left_anti").count() == 0
        else:
            assert set(got.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
            assert got.where("piece = 0").count() == read.count()
        read = got
    assert names == ["toxicity", "minhash_near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, predicted string, row int, n string, sketches int, spans string, hash int, piece string, length string"


def staged(spark, tmp_path, rows, labels=()):
    """What each stage gives for these rows."""
    folder = str(tmp_path)
    more = (0.5, "p", 1, "n", 2, "s", 3, "x", "y")
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *more) for i, t, s in rows], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    read, out = table(spark, folder, "documents"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, read, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == docs.columns, name
        got.write.parquet(f"{folder}/{k}")
        read = out[name] = spark.read.parquet(f"{folder}/{k}")
    return {k: v.collect() for k, v in out.items()}


def test_nulls_long_texts_ties_and_repeated_rows(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", None), (3, "one two three four", "a"), (3, "one two three four", "a"), (4, "one two three four", "b"), (5, "first text of five", "a"), (5, "quite another of five", "a"),
            (None, "no id at all", None), (None, "no id at all", None), (6, long, "a"), (7, long + " end", "b"), (8, "password = abcdefgh12345678 here", "a")]
    out = staged(spark, tmp_path, rows)
    assert len(out["toxicity"]) == len(rows)
    kept = sorted((r.doc_id or 0, (r.text or "")[:20]) for r in out["minhash_near_dedup"])
    assert kept == [(0, "no id at all"), (1, ""), (3, "one two three four"), (5, "first text of five"), (5, "quite another of fiv"), (6, long[:20]), (8, "password = abcdefgh1")]
    secret = {r.doc_id: r for r in out["secret_scan"]}
    assert secret[8].text == "[assign] here" and secret[8].n_chars == 13 and secret[6].text == long and secret[1].text is None
    mixed = out["source_mixing"]
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in out["secret_scan"]}
    pieces = out["best_fit_packing"]
    assert sum(r.piece == 0 for r in pieces) == len(mixed)
    ends = {}
    for r in pieces:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for own in ends.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][1] <= 1024


def test_toxic_documents_go_and_others_stay(spark, tmp_path):
    rows = [(i, f"plain words number {i} of the book" if i % 4 else f"you are a foul villain number {i}", "s") for i in range(120)]
    out = staged(spark, tmp_path, rows, [(i, 1, int(i % 4 == 0)) for i in range(100)])
    assert {r.doc_id for r in out["toxicity"]} == {i for i in range(120) if i % 4}


def test_empty_tables(spark, tmp_path):
    assert all(rows == [] for rows in staged(spark, tmp_path, []).values())


def test_stages_chained_without_writing(spark):
    docs = table(spark, SF, "documents")
    read = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        read = stage(spark, read, SF)
    other = corpus_pipeline.without_near_duplicates(spark, docs, SF)  # another pipeline of the same session begins
    assert corpus_pipeline.STAGES[4][1](spark, read, SF).where("piece = 0").count() == read.count() > 0 and other.count() > 0
    first, second = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    assert first.count() == second.count() > 0


def test_near_duplicates_go_in_large_groups_too(spark):
    """Pairs near 0.8 among texts of one template, as many classes as there are by all pairs that agree on a sketch."""
    r = random.Random(11)
    shared, rows = ["w%d" % r.randrange(5000) for _ in range(130)], []
    for _ in range(100):
        own = shared + ["w%d" % r.randrange(5000) for _ in range(70)]
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(w if r.random() > 0.17 else "x%d" % r.randrange(10**6) for w in own))]
    texts = [neardup.word_hashes(t) for _, t in rows]
    picks = neardup.sketches(texts)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (picks[i] == picks[j]).any() and neardup.similarity(texts[i], texts[j]) >= neardup.SIMILAR:
                a, b = sorted((label[i], label[j]))
                label = [a if v == b else v for v in label]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(x.doc_id for x in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()) == sorted(set(label))


def test_large_groups_make_no_table_of_their_pairs(spark, monkeypatch):
    """Orders of the same words behind one passage: only copies go, and no table of the stage has a row for each pair."""
    r = random.Random(13)
    shared, own, rows = " ".join("s%d" % k for k in range(100)), ["w%d" % k for k in range(60)], []
    for _ in range(300):
        r.shuffle(own)
        rows.append((len(rows), f"{shared} {' '.join(own)}"))
    rows += [(300 + k, rows[7 * k][1] + " end") for k in range(20)]
    sizes, stashed = [], neardup.stashed

    def counted(df):
        out = stashed(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(neardup, "stashed", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(x.doc_id for x in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()) == list(range(300))
    assert max(sizes) <= neardup.SKETCHES * len(rows)


def test_packing_leaves_out_no_bin_or_candidate(spark):
    """As many sequences as the tokens need, where a search of some of the items and bins takes one more."""
    r = random.Random(122)
    lengths = [r.randint(100, 300) for _ in range(60)]
    docs = spark.createDataFrame([(k, " ".join(["a"] * (n - 1))) for k, n in enumerate(lengths)], "doc_id bigint, text string").repartition(3)
    out = corpus_pipeline.packed(spark, docs, SF).collect()
    assert {x.doc_id: x.length for x in out} == dict(enumerate(lengths))
    assert len({x.sequence_id for x in out}) == -(-sum(lengths) // 1024) == 12


def test_near_duplicates_of_few_words_go_too(spark):
    """Texts of four words and the same with one more, and of five with one changed in the middle."""
    rows = []
    for k in range(20):
        a, b, c, d, e, f = (f"{x}{k}" for x in "abcdef")
        rows += [(4 * k, f"{a} {b} {c} {d}"), (4 * k + 1, f"{a} {b} {c} {d} {e}"), (4 * k + 2, f"{f} {e} {d} {c} {b}"), (4 * k + 3, f"{f} {e} {a} {c} {b}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(x.doc_id for x in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()) == list(range(0, 80, 2))
