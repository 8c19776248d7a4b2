import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import models
from quillspark.sources import files, html, office
from quillspark.streaming import queue, windows

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


DOCX = zipped({"word/document.xml": f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> &amp; plain</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="ListParagraph"/></w:pPr><w:r><w:t>item</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""})
PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 120, 200) + b"\0" * 8
PPTX = zipped({
    "ppt/slides/slide10.xml": f"<p {A}><a:p><a:t>Last</a:t></a:p></p>",
    "ppt/slides/slide2.xml": f"<p {A}><a:p><a:t>Ti</a:t><a:t>tle</a:t></a:p><a:p><a:t>point</a:t></a:p></p>",
    "ppt/slides/_rels/slide2.xml.rels": '<R><Relationship Id="1" Target="../media/i.png"/></R>',
    "ppt/media/i.png": PNG,
})
XLSX = zipped({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>na|me</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="A2"><v>1.256</v></c></row></sheetData></worksheet>',
})


def test_office_files():
    assert office.markdown(DOCX, "docx")[0] == "## Head\n\n**bold** & plain\n\n- item\n| a\\|b | c |\n| --- | --- |\n\n"
    assert office.markdown(PPTX, "pptx")[0] == "## Slide 1\n\n**Title**\n\n- point\n\n## Slide 2\n\n**Last**\n\n\n"
    assert office.markdown(XLSX, "xlsx")[0] == "| na\\|me |  | 2 |\n| --- | --- | --- |\n| 1.26 |  |  |\n\n"
    assert office.markdown(zipped({"content.xml": "<a>x &lt;y&gt;</a>\n<b>z</b>"}), "odt")[0] == "x <y>\n\nz"
    assert office.markdown(b"broken", "docx")[0] is None
    assert [(i["index"], i["mime"], i["width"], i["page"]) for i in office.images(PPTX)] == [(1, "image/png", 120, 2)]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "wiki"
    for name, data in {"b.md": b"# B", "a/z.md": b"# Z", "a/y/x.md": b"# X", "a.md": b"# A", ".hid/h.md": b"no", "d.docx": DOCX, "s.pptx": PPTX, "p.png": PNG, "v.mp4": b"0" * 2000, "o.key": b"0", "bad.txt": b"\xff\xfe", "r.pdf": b"%PDF"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def test_listing_order(spark, folder):
    got = files.pages(spark, folder).orderBy("ord").collect()
    assert [(r.path, r.ord) for r in got] == [("a/y/x.md", 0), ("a/z.md", 1), ("a.md", 2), ("b.md", 3)]
    assert got[0].page_id == "x" and got[0].content == "# X"


def test_texts_of_files(spark, folder):
    found = files.scan(spark, folder)
    got = {r.path: (r.text, r.error) for r in files.texts(found).collect()}
    assert got["p.png"][0] == f"[Image: p.png ({len(PNG) / 1024:.1f} KB)]" and got["v.mp4"][0] == "[Media: v.mp4 (0.0 MB)]"
    assert got["o.key"][0].startswith("[Document: o.key") and got["d.docx"][0].startswith("## Head")
    assert got["bad.txt"][0] is None and "UTF-8" in got["bad.txt"][1] and "PDF" in got["r.pdf"][1]
    assert {r.path: r.text for r in files.texts(found, pdf=lambda b: "## Page 1").collect()}["r.pdf"] == "## Page 1"
    assert files.images(found).count() == 1
    c = {r.path: r.c for r in found.select("path", files.category(F.col("path")).alias("c")).collect()}
    assert (c["a.md"], c["p.png"], c["r.pdf"], c["o.key"], c["bad.txt"]) == ("markdown", "image", "pdf", "document", "text")
    cache = spark.createDataFrame([("a.md",)], "path string").withColumn("cached_at", F.expr("timestamp'2100-01-01'"))
    assert files.stale(found, cache).count() == found.count() - 1


def test_clips(spark):
    rows = [("Hello, World!", "u1", "text"), ("Hello World", "u2", "more"), ("No content", "u", "")]
    got = files.clips(spark.createDataFrame(rows, "title string, url string, content string").withColumn("clipped", F.to_date(F.lit("2024-05-06")))).orderBy("path").collect()
    assert [r.path for r in got] == ["raw/sources/hello-world-20240506-2.md", "raw/sources/hello-world-20240506.md"]
    assert 'title: "Hello, World!"\nurl: "u1"\nclipped: 2024-05-06\norigin: web-clip' in got[1].content


def test_readable_pages():
    para = "This is a paragraph, with commas, and enough words to count as main content of the page. " * 3
    page = f"<html><head><title>T &amp; x</title></head><body><nav><a href=a>menu</a></nav><div class='sidebar'><p>{para}</p></div><div class='article-body'><h2>Head</h2><p>{para}<b>bold</b> <a href='u'>link</a></p><p>{para}</p><ul><li>one</li><li>two</li></ul><table><tr><th>a</th><td>b|c</td></tr></table></div><script>var t='</p>'</script></body></html>"
    title, text = html.readable(page)
    assert text.startswith("## Head\n\nThis is") and "**bold** [link](u)" in text and "- one\n- two" in text and "| a | b|c |" in text
    assert "menu" not in text and "var t" not in text and text.count("This is a paragraph") == 6
    assert html.readable("") == ("", "")


def take(batch):
    return batch.select("*", F.when(F.col("content").startswith("ok"), F.array(F.struct(F.concat(F.lit("wiki/"), "source").alias("path"), "content"))).alias("files"), F.lit(None).cast("string").alias("error"))


def test_queue_takes_each_text_once_and_gives_up(spark, tmp_path):
    inbox, state, check = (str(tmp_path / n) for n in ("inbox", "state", "check"))
    (tmp_path / "inbox").mkdir()

    def put(name, *rows):
        (tmp_path / "inbox" / name).write_text("\n".join(json.dumps({"project_id": "p", "source": s, "content": c, "added_at": "2024-01-01T00:00:00Z"}) for s, c in rows))

    def run():
        queue.start(queue.inbox(spark, inbox, 1), take, state, check, every=None).awaitTermination()

    put("1.json", ("a", "ok 1"), ("b", "bad"))
    run()
    put("2.json", ("a", "ok 1"), ("c", "ok 3"))
    run()
    put("3.json", ("a", "ok 2"))
    run()
    put("4.json", ("d", "ok 4"))
    run()
    assert {r.path: r.content for r in queue.current_pages(spark, state).collect()} == {"wiki/a": "ok 2", "wiki/c": "ok 3", "wiki/d": "ok 4"}
    assert [(r.source, r.tries) for r in queue.failed_for_good(spark, state).collect()] == [("b", 3)]
    assert spark.read.parquet(f"{state}/done").count() == 4


def test_windows_of_a_stream(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.createDataFrame([("2024-01-01 00:10:00", 1, 2.0), ("2024-01-01 00:50:00", 1, 3.0), ("2024-01-01 05:00:00", 2, 1.0)], "ts string, user_id int, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, user_id int, value double").parquet(path)
    q = windows.tumbling(stream, "1 hour", "user_id", late="10 minutes").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.user_id, r.n, r.total) for r in spark.table("hours").collect()] == [(1, 2, 5.0)]


def test_models(spark):
    calls = []

    def embed(text):
        calls.append(len(text))
        if len(text) > 100:
            raise ValueError("too long")
        return [1.0]

    assert models.halving(embed)("x" * 300) == [1.0] and calls == [300, 150, 75]
    calls.clear()
    assert models.halving(lambda t: embed("x" * 200 if calls.append(0) is None else t))("x" * 128) is None
    chunks = spark.createDataFrame([("a", "hello"), ("b", "hello")], "chunk_id string, text string")
    got = models.embedded(chunks, models.hashing_embedder(8)).collect()
    assert got[0].vector == got[1].vector and len(got[0].vector) == 8
    items = spark.createDataFrame([("1", 0), ("2", 0), ("3", 1)], "id string, batch int")
    assert [r.id for r in models.judged(items, lambda ids: ["2"] if "1" in ids else 1 / 0).collect()] == ["2"]
    asked = spark.createDataFrame([("p",), ("q",)], "prompt string")
    assert sorted(r.answer for r in models.replayed(asked, spark.createDataFrame([("p", "x")], "prompt string, answer string")).collect()) == ["", "x"]


def test_defect_11_images_are_extracted():
    small = PNG[:16] + struct.pack(">II", 99, 500) + b"\0" * 8
    found = office.images(zipped({"word/media/a.png": PNG, "word/media/b.png": small, "word/media/c.txt": b"x"}))
    assert [(i["index"], i["width"], i["height"], i["page"]) for i in found] == [(1, 120, 200, None)]
    assert office.images(b"no zip") == []


def test_defect_13_rows_of_the_inbox_carry_their_source(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"project_id": "p", "source": "dir/a.md", "content": "ok", "added_at": "2024-01-01T00:00:00Z"}))
    q = queue.inbox(spark, str(tmp_path)).writeStream.format("memory").queryName("inbox").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [r.source for r in spark.table("inbox").collect()] == ["dir/a.md"]


def test_long_pages_without_scored_parts_are_whole(spark):
    page = "<body>" + "".join(f"<div>line {i}<br></div>" for i in range(8000)) + "</body>"
    assert html.readable(page)[1] == ""
    got = html.main_markdown(spark.createDataFrame([(1, page)], "page_id bigint, html string")).first().markdown
    assert len(got) > 50_000 and got.rstrip().endswith("line 7999")


TEXT = "A sentence of the article, with a comma, and long enough to count as one. " * 8


@pytest.mark.parametrize("name", ["div", "section", "blockquote"])
def test_defect_deep_pages(name):
    n = 20_000
    _, markdown = html.readable(f"<title>T</title><body><p>{TEXT}</p>" + f"<{name}>" * n + f"<p>{TEXT} End.</p>" + f"</{name}>" * n)
    assert "End." in markdown and "A sentence" in markdown


def test_tables_and_images():
    rows = "<tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr><tr><td>x <b>y</b></td><td>2</td><td>3</td></tr>"
    page = f"<body><article><p>{TEXT}</p><table>{rows}</table><p>{TEXT}<img src=u.png width=9px><img src=v.png height=10></p></article></body>"
    _, markdown = html.readable(page)
    assert "| a | b|c |\n| --- | --- | --- |\n| 1 |\n| x **y** | 2 | 3 |" in markdown
    assert "u.png" not in markdown and "![](v.png)" in markdown
