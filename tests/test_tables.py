"""Table functions and the web search source, as SQL users call them."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunk, tables, text
from quillspark.operators import links
from quillspark.operators.ingest import file_blocks
from quillspark.sources import websearch

PAGE = "---\ntitle: x\n---\n# A\n\n" + "Some words of it. " * 90 + "\n\n## B\n\n[[One|shown]] and [[ two ]] and [[Three]]\n"


@pytest.fixture(scope="module")
def sql(spark):
    tables.register(spark)
    websearch.register(spark)
    return spark.sql


def test_chunks_are_those_of_the_dataframe_function(spark, sql):
    pages = spark.createDataFrame([("p", PAGE), ("q", ""), ("r", None)], "page_id string, content string")
    got = sql("SELECT p.page_id, c.* FROM {p} p, LATERAL md_chunks(p.content) c", p=pages).drop("page_id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in chunk.chunks(pages.where("page_id = 'p'")).drop("page_id", "chunk_id").collect()]
    small = sql("SELECT c.* FROM {p} p, LATERAL md_chunks(p.content, 200, 300, 20, 0) c", p=pages).collect()
    assert len(small) > len(got) and max(len(r.text) for r in small) <= 300


def test_links_and_tokens_are_those_of_the_column_functions(spark, sql):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "no links"), (4, "What is 深度学习 of the Äpfel-Baum 深 \u3000x? it's")], "id int, content string")
    got = {(r.id, r.pos): r.target for r in sql("SELECT p.id, l.* FROM {p} p, LATERAL wikilinks(p.content) l", p=pages).collect()}
    assert got == {(r.id, r.pos): r.col for r in pages.select("id", F.posexplode(links.targets(F.col("content")))).collect()} and len(got) == 3
    got = {(r.id, r.pos): r.token for r in sql("SELECT p.id, t.* FROM {p} p, LATERAL query_tokens(p.content) t", p=pages).collect()}
    assert got == {(r.id, r.pos): r.col for r in pages.select("id", F.posexplode(text.tokenize(F.col("content")))).collect()} and "深度" in got.values()
    plan = sql("SELECT l.* FROM {p} p, LATERAL wikilinks(p.content) l", p=pages)._jdf.queryExecution().toString()
    assert "Python" not in plan.split("== Physical Plan ==")[1]


def test_file_blocks_are_those_of_the_function(spark, sql):
    answer = "---FILE: wiki/a.md---\n```\n---END FILE---\n```\nx\n---END FILE---\n---FILE: ../b---\n---END FILE---\n---FILE: wiki/c.md---\nopen"
    got = [tuple(r) for r in sql("SELECT b.* FROM {a} a, LATERAL file_blocks(a.t) b", a=spark.createDataFrame([(answer,), (None,), ("",)], "t string")).collect()]
    found, warnings = file_blocks(answer)
    assert got == [(0, *found[0], None), (1, None, None, warnings[0]), (2, None, None, warnings[1])]


RESULTS = {"results": [{"title": "T", "url": "https://www.a.org/x", "content": "c"}, {"title": None, "url": "http://b.www.org/", "content": None}]}
ANSWER = {"choices": [{"message": {"content": "word " * 300}}], "citations": ["https://first.org/1", "https://www.second.org/2", "not an address", "https://third.org"]}


def searched(spark, queries, answers, **options):
    reader = spark.read.format("web_search").option("queries", json.dumps(queries)).option("transport", "quillspark.sources.websearch:replayed").option("answers", json.dumps(answers))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_source_with_a_list_of_results(spark, sql):
    df = searched(spark, ["one", "two", "one"], {"one": RESULTS, "two": {}})
    assert df.rdd.getNumPartitions() == 3
    assert [tuple(r) for r in df.orderBy("query_pos", "pos").collect()] == [(q, "one", *row) for q in (0, 2) for row in ((0, "T", "https://www.a.org/x", "c", "a.org"), (1, "Untitled", "http://b.www.org/", "", "b.org"))]
    assert searched(spark, ["one"] * 7, {"one": RESULTS}, atOnce=2).rdd.getNumPartitions() == 2
    assert searched(spark, [], {}).count() == 0


def test_source_with_an_answer(spark, sql):
    query = "a question of more than sixty characters, which is cut in the title of its row"
    got = [tuple(r)[2:] for r in searched(spark, [query], {query: ANSWER}, layout="answer", maxResults=4).orderBy("pos").collect()]
    assert got[0] == (0, "Perplexity: " + query[:60], "https://first.org/1", ("word " * 300)[:800], "perplexity.ai")
    assert got[1:] == [(1, "Source 2", "https://www.second.org/2", "", "second.org"), (2, "Source 4", "https://third.org", "", "third.org")]
    assert searched(spark, [query], {query: ANSWER}, layout="answer", maxResults=2).count() == 2
    silent = {"choices": [], "citations": ["https://a.b/1", "https://c.d/2"]}
    assert [r.title for r in searched(spark, ["q"], {"q": silent}, layout="answer").collect()] == ["Source 2"]


def test_source_that_fails(spark, sql):
    bad = {"good": RESULTS, "bad": {"results": [{"url": "nowhere"}]}}
    with pytest.raises(Exception, match="Invalid URL"):
        searched(spark, ["good", "bad"], bad).collect()
    with pytest.raises(Exception, match="no answer is recorded"):
        searched(spark, ["other"], bad).collect()
    assert searched(spark, ["good", "bad", "other"], bad, onError="skip").count() == 2
    with pytest.raises(Exception, match="not configured"):
        spark.read.format("web_search").option("queries", '["a"]').load().collect()
    with pytest.raises(Exception, match="Unknown search provider"):
        searched(spark, ["good"], bad, layout="else").collect()


def test_search_as_a_table_function(spark, sql):
    asked = spark.createDataFrame([(1, "Some Words"), (2, None)], "id int, q string")
    got = sql("SELECT a.id, r.* FROM {a} a, LATERAL web_search(a.q, 'quillspark.sources.websearch:echoed') r ORDER BY pos", a=asked).collect()
    assert [(r.id, r.pos, r.title, r.url, r.source) for r in got] == [(1, k, "Untitled" if k == 2 else f"Some Words {k}", f"https://www.site{k}.example/some", f"site{k}.example") for k in range(3)]
