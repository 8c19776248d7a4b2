"""Queries on pairs: their joins make no row for each pair of rows that are alike."""

import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.operators import graph, ingest


def joined_rows(spark, df):
    """The rows of df, and how many rows the joins made that it needs."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    rows = df().collect()
    bus.waitUntilEmpty()
    made = 0
    for k in range(before, store.executionsCount()):
        run = store.executionsList().apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made += int(values.apply(m.accumulatorId()).replace(",", ""))
    return rows, made


def adamic_adar(pages, own):
    """{(a, b): score} by the definition."""
    of = defaultdict(set)
    for k, slugs in pages:
        for s in slugs:
            of[s].add(k)
    score = defaultdict(float)
    for pages_of in of.values():
        for a in filter(own, pages_of):
            for b in pages_of - {a, None}:
                score[a, b] += 1 / math.log(max(len(pages_of), 2))
    return score


@pytest.mark.parametrize("small_parts", [False, True])
def test_f1_pages_of_one_link_set_meet_as_blocks(spark, tmp_path, monkeypatch, small_parts):
    if small_parts:
        monkeypatch.setattr(graph, "BLOCK", 16)
        monkeypatch.setattr(graph, "SHARE", 500)
    same = ["de", "The", "en", "la", "un"]
    pages = [(k, same) for k in range(600)] + [(600 + k, ["de", "x"][: k % 3] + [f"own{k}"]) for k in range(30)]
    pages += [(7, ["x"]), (700, []), (720, ["lonely"]), (None, ["de", "x"]), (-20, ["x", "x", "THE"])]  # 7 twice, one without id
    html = [(k, "".join(f'<li><a href="/{s}">t</a></li>' for s in slugs)) for k, slugs in pages] + [(740, None)]
    spark.createDataFrame(html, "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows, made = joined_rows(spark, lambda: entry.queries()["adamic_adar_pages"](spark, str(tmp_path)))
    want = adamic_adar([(k, [s.lower() for s in slugs]) for k, slugs in pages], lambda k: k is not None and k % 20 == 0)
    assert len(rows) == len(want) == len({(r.a, r.b) for r in rows})
    assert all(abs(r.score - want[r.a, r.b]) < 2e-6 for r in rows)
    assert small_parts or made < 3000  # of 600 pages and 30 asked ones, by five targets, 90,000 before


def test_f1_nobody_asked(spark, tmp_path):
    spark.createDataFrame([(1, '<li><a href="/x">')], "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert entry.queries()["adamic_adar_pages"](spark, str(tmp_path)).collect() == []


def test_f2_suppliers_of_one_name_meet_others_once(spark, tmp_path):
    made = {}
    for copies in (1, 4):
        n, path = 776 * copies, tmp_path / str(copies)  # names repeat after 776
        spark.range(n).select(F.col("id").alias("s_suppkey")).write.parquet(str(path / "supplier.parquet"))
        rows, made[copies] = joined_rows(spark, lambda path=path: entry.queries()["entity_dedup"](spark, str(path)))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{path}/supplier.parquet/*.parquet'")
        assert sorted((r.id, r.known_id) for r in rows) == sorted(con.execute(entry.oracle_sql()["entity_dedup"]).fetchall())
    assert made[4] <= made[1] + 3 * 388  # the new names' own rows; 16 times as many before


def test_f2_an_id_of_several_names_and_names_known_twice(spark):
    new = [(1, "Alpha Works"), (1, "Beta"), (2, "alpha-works"), (3, "unlike anything"), (4, None)]
    known = [("k9", "ALPHA works", 9), ("k2", "alpha_works", 2), ("k1", "betas", 1), ("k5", None, 0), ("k7", "alpha works", 2)]
    got = ingest.name_matches(spark.createDataFrame(new, "id int, name string"), spark.createDataFrame(known, "known_id string, known_name string, ord int")).collect()
    assert sorted((r.id, r.known_id) for r in got) == [(1, "k1"), (2, "k2")]
