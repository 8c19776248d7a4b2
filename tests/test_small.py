"""Functions that stand alone: formulas in answers, the index of orphans, dropped tables, shared runs."""

import random

from pyspark.sql import functions as F

from quillspark.operators import lint, links, overlap, vectors


def test_bare_environments_become_formulas(spark):
    block = "\\begin{a}x\n$y$\\end{a}"
    rows = [f"t {block} u", f"$$\n{block}\n$$", f"$${block}$$", "none", f"{block} and {block}"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(links.with_math(F.col("t"))).collect()]
    assert got == [f"t $$\n{block}\n$$ u", rows[1], rows[2], "none", f"$$\n{block}\n$$ and $$\n{block}\n$$"]


def test_orphans_enter_the_index_once(spark):
    rows = [("orphan", "wiki/x/b.md"), ("orphan", "a.md"), ("orphan", "y/a.md"), ("broken-link", "c.md")]
    found = spark.createDataFrame(rows, "kind string, page string")
    entries = lint.index_entries(found)
    assert lint.with_entries(spark.createDataFrame([("# I\n- old\n\n",)], "content string"), entries).first().content == "# I\n- old\n- [[a]]\n- [[b]]\n"
    assert lint.with_entries(spark.createDataFrame([], "content string"), entries).first().content == "# Wiki Index\n- [[a]]\n- [[b]]\n"
    assert [r.entry for r in lint.index_entries(found, F.lit("x\n- [[a]]\n")).collect()] == ["- [[b]]"]


def test_legacy_tables_are_dropped(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("old_vectors")
    assert vectors.drop_legacy(spark, "old_vectors") == 3 and not spark.catalog.tableExists("old_vectors")
    assert vectors.drop_legacy(spark, "old_vectors") == 0


def test_shared_runs_by_hand(spark, monkeypatch):
    r = random.Random(1)
    words = list("abcdefg") + ["É", "é", ""]
    make = lambda n: [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(n)]
    docs, items = [*make(40), (99, None), (3, "a b c a b c a b c")], [*make(15), (7, "\ta b  c\na b c a b c ")]

    def runs(rows):
        out = {}
        for key, text in rows:
            w = overlap._GAPS.split((text or "").lower())
            out.setdefault(key, set()).update(" ".join(w[i : i + 4]) for i in range(len(w) - 3))
        return out

    want = {(d, i): len(a & b) for d, a in runs(docs).items() for i, b in runs(items).items() if a & b}
    for block in (overlap.BLOCK, 20):
        monkeypatch.setattr(overlap, "BLOCK", block)
        got = overlap.shared_runs(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), 4)
        assert {(x.doc_id, x.item_id): x.n_shared for x in got.collect()} == want
    none = spark.createDataFrame([], "item_id int, text string")
    assert overlap.shared_runs(spark.createDataFrame(docs, "doc_id int, text string"), none).count() == 0
