import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunk, language, text
from quillspark.functions import frontmatter as fm


def values(spark, rows, **columns):
    """Each expression's value for each text."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    out = df.select("i", *(f(F.col("t")).alias(k) for k, f in columns.items())).orderBy("i").collect()
    return [r.asDict() for r in out]


def test_tokenize(spark):
    got = values(spark, ["What is the attention?", "默会知识", "a the of", "RoPE rope RoPE-2d", "知识"], t=text.tokenize)
    assert [r["t"] for r in got] == [["attention?"], ["默会", "会知", "知识", "默", "会", "知", "识", "默会知识"], [], ["rope", "2d"], ["知识"]]


def test_phrase_keeps_inner_signs(spark):
    assert [r["p"] for r in values(spark, ["  总资产。", "2024-Q3", "(hi) "], p=text.phrase)] == ["总资产", "2024-q3", "hi"]


def test_occurrences_do_not_overlap(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("abc", ""), ("x", "xx")], "h string, n string")
    assert [r[0] for r in df.select(text.occurrences(F.col("h"), F.col("n"))).collect()] == [2, 0, 0]


def test_snippet(spark):
    rows = ["x" * 100 + "NEEDLE" + "y" * 100, "needle at the start", "nothing\nhere"]
    got = [r["s"] for r in values(spark, rows, s=lambda c: text.snippet(c, F.lit("needle")))]
    assert got == ["..." + "x" * 80 + "NEEDLE" + "y" * 80 + "...", "needle at the start", "nothing here"]


def test_names_and_titles(spark):
    assert [r["n"] for r in values(spark, ["中国平安 保险集团", "Open-AI_", "KV Cache"], n=text.normalize_name)] == ["中国平安保险", "openai", "kvcache"]
    assert [r["n"] for r in values(spark, ["Missing page:  KV   Cache ", "缺失页面：注意力", "Duplicate-page: X"], n=text.normalize_review_title)] == ["kv cache", "注意力", "x"]


def test_versions_and_greetings(spark):
    assert [r["v"] for r in values(spark, ["v1.2.3", "2.x", "0.10"], v=text.version_parts)] == [[1, 2, 3], [2, 0, 0], [0, 10, 0]]
    assert [r["g"] for r in values(spark, ["Hi!", "hello there", "你好啊", "what is RoPE", "", None], g=text.is_greeting)] == [True, True, True, False, False, False]


def test_safe_paths(spark):
    rows = ["wiki/a.md", "wiki/../x", "/etc/x", "raw/x", "wiki\\b.md", "wiki/..x/y"]
    assert [r["s"] for r in values(spark, rows, s=text.safe_wiki_path)] == [True, False, False, False, True, True]


def test_thinking(spark):
    got = values(spark, ["<think>a</think> b", "<thinking>open", "plain"], a=text.without_thinking, t=text.thinking)
    assert [(r["a"], r["t"]) for r in got] == [("b", "a"), ("", "open"), ("plain", "")]


def test_image_refs(spark):
    got = values(spark, ["![a](u1) ![b](u2) ![c](u1)"], i=text.image_refs)[0]["i"]
    assert [(x.alt, x.url) for x in got] == [("a", "u1"), ("b", "u2")]


PAGE = '---\ntype: Concept\ntitle: "KV Cache"\nsources:\n  - a.pdf\n  - "b.md"\ntags: [x, \'y\']\n---\n\n# Heading\n\nbody\n'


def test_front_matter(spark):
    r = values(
        spark, [PAGE, "# Only\ntext", "---\nx: 1\n---\nplain"],
        k=fm.page_type, s=lambda c: fm.items(c, "sources"), g=lambda c: fm.items(c, "tags"), t=lambda c: fm.title(c, F.lit("wiki/my-page.md")), b=fm.body,
    )
    assert r[0] == {"i": 0, "k": "concept", "s": ["a.pdf", "b.md"], "g": ["x", "y"], "t": "KV Cache", "b": "\n# Heading\n\nbody\n"}
    assert (r[1]["k"], r[1]["t"], r[2]["t"]) == ("other", "Only", "my page")


def test_title_reads_any_line_of_a_page_with_front_matter(spark):
    assert values(spark, ["---\nx: 1\n---\ntitle: Late\n"], t=lambda c: fm.title(c, F.lit("a.md")))[0]["t"] == "Late"


def test_sources_are_written_back(spark):
    rows = [PAGE, "---\ntitle: x\n---\nbody", "no front matter $1", '---\nsources: ["old"]\nz: 1\n---\nb']
    new = F.array(F.lit("a$1.pdf"), F.lit("c"))
    got = [r["w"] for r in values(spark, rows, w=lambda c: fm.with_sources(c, new))]
    assert got[0].startswith('---\ntype: Concept\ntitle: "KV Cache"\nsources: ["a$1.pdf", "c"]\ntags:')
    assert got[1] == '---\ntitle: x\nsources: ["a$1.pdf", "c"]\n---\nbody'
    assert got[2] == rows[2]
    assert got[3] == '---\nsources: ["a$1.pdf", "c"]\nz: 1\n---\nb'


def test_union_of_sources_keeps_the_first_case(spark):
    df = spark.createDataFrame([(["A.md", "b"], ["a.MD", "c"])], "x array<string>, y array<string>")
    assert df.select(fm.merged(F.col("x"), F.col("y"))).first()[0] == ["A.md", "b", "c"]


LANGUAGES = [
    ("Chinese", "深度学习"), ("Japanese", "これは漢字です"), ("Korean", "안녕하세요"), ("Russian", "Привет мир"), ("Arabic", "مرحبا"), ("Greek", "Γειά σου"),
    ("German", "das ist nicht gut und schön"), ("French", "le chat est une bête"), ("Spanish", "el niño y los años"), ("Portuguese", "não é uma ação que"),
    ("Polish", "zażółć gęślą jaźń"), ("Vietnamese", "tiếng việt"), ("Italian", "il gatto della casa che"), ("English", "plain words only"), ("English", ""), ("Hindi", "नमस्ते"),
]


def test_languages(spark):
    got = values(spark, [t for _, t in LANGUAGES], d=language.detect)
    assert [r["d"] for r in got] == [n for n, _ in LANGUAGES]


def test_language_guard(spark):
    long = "plain words only, and more of them to be long enough"
    df = spark.createDataFrame([(long, "English"), (long, "Chinese"), ("短", "English"), ("这是一个很长的中文句子，需要超过二十个字符才可以判断", "English")], "c string, t string")
    assert [r[0] for r in df.select(language.fits(F.col("c"), F.col("t"))).collect()] == [True, False, True, False]


def slices(content, got):
    return all(c["text"].endswith(content[c["char_start"] : c["char_end"]]) for c in got)


def test_chunk_sizes_of_one_long_word():
    got = chunk.chunk_markdown("a" * 2000, chunk.Sizes(200, 1500, 200, 500))
    assert [len(c["text"]) for c in got] == [200] + [300] * 9


def test_chunk_table_stays_whole():
    table = "\n".join(f"| row {i} | value |" for i in range(50))
    got = chunk.chunk_markdown(f"intro\n\n{table}\n\nend", chunk.Sizes(200, 400, 20, 0))
    assert sum(c["oversized"] for c in got) == 1
    assert any(table in c["text"] for c in got)


def test_defect_1_no_paragraph_twice():
    content = " ".join(f"Sentence number {i} is here." for i in range(300))
    got = chunk.chunk_markdown(content, chunk.Sizes(overlap=0))
    assert "".join(c["text"] for c in got) == content


def test_defect_2_a_lone_table_line_ends():
    content = "| lone\n\n" + "word " * 400
    assert "".join(c["text"] for c in chunk.chunk_markdown(content, chunk.Sizes(overlap=0))) == content


def test_defect_3_chunks_are_slices():
    content = "tiny.\n\nbbb\n\n" + "c" * 1200
    got = chunk.chunk_markdown(content)
    assert slices(content, got) and got[0]["text"].startswith("tiny.\n\nbbb")


@pytest.mark.parametrize("seed", range(20))
def test_chunks_cover_the_body(seed):
    r = random.Random(seed)
    parts = ["# Head\n", "## Sub\n", "```\ncode # not a head\n```\n", "| a | b |\n| - | - |\n", "word. " * 50, "\n\n", "x" * 1500, "。句子" * 40, "\n", "text\n"]
    content = r.choice(["", "---\ntitle: x\n---\n"]) + "".join(r.choice(parts) for _ in range(r.randrange(1, 25)))
    got = chunk.chunk_markdown(content)
    assert slices(content, got)
    assert [c["index"] for c in got] == list(range(len(got)))
    ends = [(c["char_start"], c["char_end"]) for c in got]
    assert ends == sorted(ends) and all(b <= c for (_, b), (c, _) in zip(ends, ends[1:]))
    body = content.split("---\n", 2)[-1] if content.startswith("---") else content
    start = len(content) - len(body)
    left = "".join(content[a:b] for a, b in zip([start, *(b for _, b in ends)], [*(a for a, _ in ends), len(content)]))
    assert not left.strip()


def test_heading_paths():
    got = chunk.chunk_markdown("## A\ntext\n### B\ntext\n## C\ntext\n")
    assert [c["heading_path"] for c in got] == ["## A", "## A > ### B", "## C"]
