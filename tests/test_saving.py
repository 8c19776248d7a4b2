from pyspark.sql import functions as F

from quillspark.functions.latex import to_unicode
from quillspark.operators import media, saving
from quillspark.sources import websearch


def test_latex():
    assert to_unicode("$\\alpha$ and $a \\leq b$ and $$x \\to y$$ \\beta $\\unknown$") == "α and a ≤ b and \nx \\to y\n \\beta \\unknown"


def test_slugs():
    assert [saving.slug_of(t) for t in ("  What is　RoPE? ", "默会 知识！", "🙂", "ＡＢ-c", None)] == ["what-is-rope", "默会-知识", "query", "ab-c", "query"]


def test_addresses(spark):
    rows = ["./media/a/i.png", "/x/wiki/media/b/i.png", "https://h/i.png", ""]
    df = spark.createDataFrame([(r,) for r in rows], "url string").withColumn("p", F.lit("/p/"))
    got = [tuple(r) for r in df.select(media.absolute(F.col("url"), F.col("p")), media.resolved(F.col("url"), F.lit("/p"))).collect()]
    assert got[0] == ("/p/wiki/media/a/i.png", "/api/fs/media?path=%2Fp%2Fwiki%2Fmedia%2Fa%2Fi.png")
    assert got[1][0] == rows[1] and got[2][1] == rows[2] and got[3][1] == ""
    raw = spark.createDataFrame([("raw/sources/a.pdf", "a.pdf", 1), ("raw/sources/z/a.md", "a.md", 0)], "path string, name string, ord int")
    assert {r.url: r.source for r in media.raw_sources(df.select("url"), raw).collect()}[rows[0]] == "raw/sources/z/a.md"


def test_captions(spark):
    pages = spark.createDataFrame([("p", "one ![a](u1) two ![b](u2) three"), ("q", "none")], "page_id string, content string")
    refs = media.references(pages).orderBy("pos").collect()
    assert [(r.alt, r.url, r.before, r.after) for r in refs] == [("a", "u1", "one ", " two ![b](u2) three"), ("b", "u2", "one ![a](u1) two ", " three")]
    caps = spark.createDataFrame([("p", "u2", "x]\ny")], "page_id string, url string, caption string")
    assert {r.page_id: r.content for r in media.captioned(pages, caps).collect()} == {"p": "one ![a](u1) two ![x) y](u2) three", "q": "none"}
    assert pages.select(media.without_images(F.col("content"))).first()[0] == "one   two   three"


def test_image_section_is_idempotent(spark):
    rows = [("s", 2, 10, "b.png", None), ("s", 1, 2, "a.png", "cap"), ("s", 3, None, "c.png", "d")]
    s = media.section(spark.createDataFrame(rows, "source string, index int, page int, rel_path string, caption string"))
    text = s.first().section
    assert text == "## Embedded Images\n\n### Page 2\n\n![cap](a.png)\n\n### Page 10\n\n![](b.png)\n\n### Document\n\n![d](c.png)"
    page = spark.createDataFrame([("body\n", text)], "c string, s string")
    once = page.select(media.with_section(F.col("c"), F.col("s")).alias("c"), "s")
    assert once.first().c == once.select(media.with_section(F.col("c"), F.col("s"))).first()[0]


def test_saved_answers(spark):
    a = spark.createDataFrame([('# What "is" it?\n<think>x</think>text<!-- sources: 1 -->',)], "content string").withColumn("saved_at", F.to_timestamp(F.lit("2024-05-06 07:08:09")))
    r = saving.saved_answers(a).first()
    assert r.path == "wiki/queries/what-is-it-2024-05-06-070809.md"
    assert r.content == '---\ntype: query\ntitle: "What \\"is\\" it?"\ncreated: 2024-05-06\ntags: []\n---\n# What "is" it?\ntext'
    df = spark.createDataFrame([("# I\n\n## Queries\n- old\n",), ("# I\n",)], "i string")
    assert [x[0] for x in df.select(saving.with_index_entry(F.col("i"), F.lit("- $1 new"))).collect()] == ["# I\n\n## Queries\n- $1 new\n- old\n", "# I\n\n## Queries\n- $1 new\n"]


def test_research(spark):
    t = spark.createDataFrame([("1", "Topic: x", "<think>open")], "task_id string, topic string, synthesis string").withColumn("saved_at", F.to_timestamp(F.lit("2024-05-06 00:00:00")))
    q = spark.createDataFrame([(0, "a"), (1, "b"), (2, "boom")], "query_pos int, query string")

    def transport(text):
        return {"results": [{"title": text, "url": "https://www.h.org/1", "content": "s"}, {"title": text, "url": f"https://h.org/{text}"}]} if text != "boom" else 1 / 0

    found = websearch.search(q, transport).withColumn("task_id", F.lit("1"))
    assert found.count() == 4 and saving.distinct_results(found).count() == 3
    r = saving.research_pages(t, found).first()
    assert r.path == "wiki/queries/research-topic-x-2024-05-06.md" and "1. [a](https://www.h.org/1) — h.org\n2. [a](https://h.org/a)" in r.content
    assert [x["url"] for x in websearch.from_citations({"choices": [{"message": {"content": "t"}}], "citations": ["https://c.d/e"]})] == ["", "https://c.d/e"]
    o = spark.createDataFrame([("TOPIC: t\nQUERY: a\nQUERY: b",), ("nothing",)], "a string").select(saving.optimised_topic(F.col("a"), F.lit("f")).alias("o")).collect()
    assert (o[0].o.topic, o[0].o.queries, o[1].o.queries) == ("t", ["a", "b"], ["f"])
    topics = spark.createDataFrame([("Research: X", "d"), ("Create", "first\nsecond")], "t string, d string")
    assert [x[0] for x in topics.select(saving.research_topic(F.col("t"), F.col("d"))).collect()] == ["X", "first"]


def test_projects(spark):
    assert saving.templates(spark).count() == 5
    p = spark.createDataFrame([("1", "a", "/a", 1), ("1", "b", "/b", 2)], "project_id string, name string, path string, opened_at int")
    assert saving.registered(p.limit(0), p).first().path == "/b"
