"""Captions with a cache, scanned pages, the judge of reviews, and stored state."""

import base64
import hashlib
import json
import os

from pyspark.sql import functions as F

from quillspark.operators import media, stored, sweep, viewing, vision

PAGES = "page_id string, content string"
IMAGES = "page_id string, url string, mime string, content binary"


def test_each_image_goes_out_once(spark, tmp_path):
    calls = str(tmp_path)

    def caption(image, mime, before, after):
        name = image.decode()
        with open(f"{calls}/{name}-{os.urandom(8).hex()}", "w") as f:
            f.write(f"{before}|{after}")
        if name == "broken":
            raise RuntimeError("no")
        return f"a ]{name}\n"

    def made():
        return sorted(n.rsplit("-", 1)[0] for n in os.listdir(calls))

    pages = spark.createDataFrame([("a", "x ![](1.png) y ![](2.png) z ![](1.png)"), ("b", "![old](3.png) ![k](4.png) ![](gone.png)"), ("c", "none")], PAGES)
    images = spark.createDataFrame([("a", "1.png", "image/png", b"cat"), ("a", "2.png", "image/png", b"dog"), ("b", "3.png", "image/jpeg", b"cat"), ("b", "4.png", "image/png", b"broken")], IMAGES)
    cache = spark.createDataFrame([(hashlib.sha256(b"dog").hexdigest(), "a dog", "image/png", "m0", None)], vision.CACHE)
    at = F.lit("2024-05-06 07:08:09")
    got = vision.captions(pages, images, cache, caption, "m1", at)
    text = {r.page_id: r.content for r in got["pages"].collect()}
    assert text == {"a": "x ![a )cat](1.png) y ![a dog](2.png) z ![a )cat](1.png)", "b": "![a )cat](3.png) ![k](4.png) ![](gone.png)", "c": "none"}
    assert {r.page_id: (r.fresh, r.cached, r.failed) for r in got["counts"].collect()} == {"a": (1, 1, 0), "b": (1, 0, 2)}
    new = {r.sha256: (r.caption, r.model) for r in got["cache"].collect()}
    assert new == {hashlib.sha256(b"dog").hexdigest(): ("a dog", "m0"), hashlib.sha256(b"cat").hexdigest(): ("a ]cat\n", "m1")}
    assert made() == ["broken", "cat"]  # however often results are read
    assert open(f"{calls}/{next(n for n in os.listdir(calls) if n.startswith('cat'))}").read() == "x | y ![](2.png) z ![](1.png)"
    again = vision.captions(pages, images, got["cache"], caption, "m2", at)
    assert again["cache"].exceptAll(got["cache"]).count() == 0 and made() == ["broken", "broken", "cat"]


def test_scanned_pages_in_order_without_those_that_fail(spark):
    def payload(pages, kind="image_pages"):
        return vision.MARKER + json.dumps({"type": kind, "page_count": len(pages), "dpi": 150, "pages": [base64.b64encode(p.encode()).decode() for p in pages]})

    def read(image, page, total):
        if image == b"bad":
            raise RuntimeError("no")
        return f" {image.decode()} {page + 1}/{total}\n"

    files = [("a", payload(["p"] * 11 + ["bad", "q"])), ("b", payload(["bad"])), ("c", payload([])), ("d", payload(["p"], "else")), ("e", vision.MARKER + "{"), ("f", "plain text")]
    got = {r.path: (r.text, r.error) for r in vision.scanned_texts(spark.createDataFrame(files, "path string, content string"), read).collect()}
    parts = [f"<!-- Page {n} -->\np {n}/13" for n in range(1, 12)] + ["<!-- Page 13 -->\nq 13/13"]
    assert got == {"a": ("\n\n".join(parts), None), "b": (vision.NO_TEXT, None), "c": (vision.NO_TEXT, None), "d": (None, "Invalid image_pages payload"), "e": (None, "Invalid image_pages payload")}


ITEMS = "project_id string, id string, type string, title string, description string, pages array<string>, created_at bigint"


def test_judge_is_asked_until_a_batch_resolves_nothing(spark):
    items = [("p", f"{n:03}", "confirm", f"T{n}", "d" * 300, ["a.md"], n) for n in range(250)] + [("q", f"{n:03}", "confirm", "T", None, None, n) for n in range(90)] + [("r", "1", "suggestion", "T", "", [], 1)]
    pages = [("p", n, f"page-{n}", "Title" if n else None) for n in range(310)]

    def judge(asked):
        lines = asked.split("\n")
        ids = [x.split("=")[1].split(" ")[0] for x in lines if x.startswith("- id=")]
        known = [x for x in lines if x.startswith("- page-")]
        if "(no pages yet)" in lines:
            if len(ids) == 1:
                raise RuntimeError("no")
            return json.dumps({"resolved": ["000", "zzz", 3]})  # nothing of the second batch
        assert len(known) == 300 and known[0] == "- page-0" and known[1] == "- page-1  (title: Title)" and "d" * 200 + " | affected: a.md" in lines[-3]
        return f"```json\n{json.dumps({'resolved': ids[:2]})}\n```"

    got = sweep.asked(spark.createDataFrame(items, ITEMS), spark.createDataFrame(pages, "project_id string, ord int, page_id string, title string"), judge)
    rows = {(r.project_id, r.batch): (r.n_items, r.resolved) for r in got.collect()}
    assert rows == {**{("p", k): (40, [f"{40 * k:03}", f"{40 * k + 1:03}"]) for k in range(5)}, ("q", 0): (40, ["000"]), ("q", 1): (40, []), ("r", 0): (1, [])}


def test_answers_that_cannot_be_read_resolve_nothing():
    assert sweep.resolved_of('x {"resolved": ["a", "b", "a"]} y', ["b", "a"]) == ["b", "a"]
    assert all(sweep.resolved_of(t, ["a"]) == [] for t in (None, "", "no", '{"resolved": "a"}', '{"x": 1}', '{"resolved": [1]}', "[]", '{"resolved": [["a"]]}'))


FILES = "project_id string, path string, text string"


def test_three_layouts_give_one_table(spark):
    m = lambda i, c="c1": {"id": str(i), "role": "user", "content": f"t{i}", "timestamp": i, "conversationId": c}
    conv = {"id": "c1", "title": "T", "createdAt": 1, "updatedAt": 2}
    files = [
        ("a", "conversations.json", json.dumps([conv, {**conv, "id": "c2"}, {**conv, "id": "bad"}])), ("a", "chats/c1.json", json.dumps([m(1), {**m(2), "references": [{"title": "x", "path": "y"}]}])),
        ("a", "chats/bad.json", "[{"), ("a", "chats/other.json", json.dumps([m(9, "other")])), ("a", "chat-history.json", json.dumps([m(7)])),
        ("b", "chat-history.json", json.dumps({"conversations": [conv], "messages": [m(1), m(2)]})), ("b", "conversations.json", "{broken"),
        ("c", "chat-history.json", json.dumps([{k: v for k, v in m(n).items() if k != "conversationId"} for n in (5, 6)])),
        ("d", "chat-history.json", "[]"), ("e", "chat-history.json", "nothing"), ("f", "review.json", json.dumps([{"id": "r", "type": "confirm", "affectedPages": ["p"], "resolved": False, "createdAt": 3}])), ("g", "review.json", "{}"),
    ]
    got = stored.chats(spark.createDataFrame(files, FILES), F.lit(99))
    talks = {(r.project_id, r.layout, r.id, r.title, r.createdAt, r.updatedAt) for r in got["conversations"].collect()}
    assert talks == {*(("a", "split", i, "T", 1, 2) for i in ("c1", "c2", "bad")), ("b", "combined", "c1", "T", 1, 2), ("c", "flat", "default", "Previous Conversations", 5, 6), ("d", "flat", "default", "Previous Conversations", 99, 99)}
    said = sorted((r.project_id, r.pos, r.id, r.conversationId, r.content) for r in got["messages"].collect())
    assert said == [("a", 0, "1", "c1", "t1"), ("a", 1, "2", "c1", "t2"), ("b", 0, "1", "c1", "t1"), ("b", 1, "2", "c1", "t2"), ("c", 0, "5", "default", "t5"), ("c", 1, "6", "default", "t6")]
    review = stored.review_items(spark.createDataFrame(files, FILES)).collect()
    assert [(r.project_id, r.pos, r.id, r.affectedPages, r.resolved) for r in review] == [("f", 0, "r", ["p"], False)]


def test_what_is_stored_can_be_read(spark):
    m = [{"id": str(i), "role": "user", "content": "é\n", "timestamp": i, "conversationId": "c"} for i in range(130)]
    files = spark.createDataFrame([("p", "chat-history.json", json.dumps({"conversations": [{"id": "c", "title": "T", "createdAt": 1, "updatedAt": 2}], "messages": m}))], FILES)
    first = stored.chats(files)
    out = stored.stored(first["conversations"], first["messages"])
    assert sorted(r.path for r in out.collect()) == ["chats/c.json", "conversations.json"]
    again = stored.chats(out)
    assert [r.id for r in again["messages"].orderBy("pos").collect()] == [str(i) for i in range(30, 130)]
    assert again["conversations"].drop("layout").collect() == first["conversations"].drop("layout").collect()


def test_long_pages_take_linear_time(spark):
    import time

    lines = "\n".join(["# head", "text"] * 50_000)
    keys = "---\n" + "\n".join(f"key{n}: v\nlist{n}:\n  - a\n  - b" for n in range(5_000)) + "\n---\n"
    images = "![a](b.png) some text " * 3_000
    df = spark.createDataFrame([(lines, keys)], "l string, k string")
    began = time.time()
    assert df.select(F.size(viewing.sections(F.col("l")))).first()[0] == 50_000
    got = df.select(viewing.front_matter(F.col("k")).alias("m")).select(F.size("m.scalars").alias("n"), F.col("m.lists")["list4999"].alias("v")).first()
    assert got.n == 10_000 and got.v == ["a", "b"]
    assert media.references(spark.createDataFrame([("p", images)], PAGES)).count() == 3_000
    assert time.time() - began < 15


def test_front_matter_keeps_the_last_of_equal_keys(spark):
    text = "---\r\na: 1\r\nb: [x, 'y']\r\na: \"2\"\r\nb:\r\n  - z\r\nc: [ ]\r\n---\r\nbody"
    m = spark.createDataFrame([(text,)], "t string").select(viewing.front_matter(F.col("t")).alias("m")).first().m
    assert m.scalars["a"] == "2" and m.lists == {"b": ["z"]}
