import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import frontmatter as fm
from quillspark.operators import cascade, chat, community, context, graph, ingest, insights, links, lint, ranking, reviews, search, vectors

PAGES = "page_id string, ord bigint, path string, content string"


def wiki(spark, pages):
    rows = [(p.rsplit("/", 1)[-1].removesuffix(".md"), i, p, c) for i, (p, c) in enumerate(pages.items())]
    return spark.createDataFrame(rows, PAGES)


def page(title, body="", kind="concept", sources=()):
    listed = ", ".join(f'"{s}"' for s in sources)
    return f"---\ntype: {kind}\ntitle: {title}\nsources: [{listed}]\n---\n\n# {title}\n\n{body}\n"


def test_rank_without_one_task(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    got = ranking.ranked(df, [F.desc("v")], partitions=7).collect()
    assert all(r["rank"] == 1000 - r.v for r in got)


def test_ranks_of_more_rows_than_the_sampler_takes(spark, tmp_path):
    n = 3_000_000
    df = spark.range(n).select(F.concat(F.lit("page-"), "id").alias("page_id"), (F.xxhash64("id") % 50).alias("score"), F.col("id").alias("ord"))
    df.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    ranking.ranked(df, [F.desc("score"), F.col("ord")], partitions=16).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert tuple(got.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()) == (n, 1, n)
    some = got.where("rank % 300007 = 5").collect()
    for r in some:
        better = (F.col("score") > r.score) | ((F.col("score") == r.score) & (F.col("ord") < r.ord))
        assert df.where(better).count() == r["rank"] - 1


def test_fusion_by_counts_is_fusion_of_all_ranks(spark, monkeypatch):
    rows = [(f"p{i}", i, f"wiki/p{i}.md", page(f"T{i}", "attention " * (i * 7 % 13))) for i in range(120)]
    pages = spark.createDataFrame(rows, PAGES)
    near = spark.createDataFrame([(f"p{i * 11}", 1.0 / (i + 1)) for i in range(12)] + [("gone", 0.3)], "page_id string, score double")
    few = search.search(pages, "attention", near).collect()
    monkeypatch.setattr(search, "FEW_PAGES", 0)
    assert [tuple(r) for r in few] == [tuple(r) for r in search.search(pages, "attention", near).collect()]
    assert len(few) == 20


def test_stashed_tables_can_be_cleared(spark):
    from quillspark.sources import shared

    kept = shared.stashed(spark.range(5))
    assert kept.count() == 5 and shared.session_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    with shared.scope("some"):
        gone = shared.stashed(spark.range(7))
    assert gone.count() == 7
    shared.cleared(spark, "some")
    assert kept.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0]).count()


SEARCHED = {
    "wiki/concepts/attention.md": page("Attention", "the mechanism"),
    "wiki/concepts/transformer.md": page("Transformer", "uses attention. attention is attention"),
    "wiki/entities/other.md": page("Other", "nothing of note"),
    "wiki/concepts/moc.md": page("默会知识", "知识管理"),
}


def test_search_prefers_the_file_of_that_name(spark):
    got = search.search_tokens(wiki(spark, SEARCHED), "attention").collect()
    assert [r.page_id for r in got] == ["attention", "transformer"]
    # 200 name + 50 title + 2 phrases in content (title line and heading) + 5 title token + 1 content token
    assert got[0].score == 200 + 50 + 2 * 20 + 5 + 1
    assert got[1].score == 3 * 20 + 1


def test_search_in_cjk(spark):
    assert [r.page_id for r in search.search_tokens(wiki(spark, SEARCHED), "知识").collect()] == ["moc"]


def test_search_phrase_without_end_sign(spark):
    got = search.search_tokens(wiki(spark, SEARCHED), "attention。").first()
    assert got.page_id == "attention" and got.score > 200


def test_fusion(spark):
    live = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "page_id string, path string")
    t = spark.createDataFrame([("a", 1), ("b", 2)], "page_id string, token_rank int")
    v = spark.createDataFrame([("c", 1), ("b", 2), ("ghost", 3)], "page_id string, vector_rank int")
    got = search.fused(t, v, live).collect()
    assert [r.page_id for r in got] == ["b", "a", "c"]  # equal scores by path; pages that are gone don't show
    assert got[0].score == pytest.approx(2 / 62) and got[1].score == pytest.approx(1 / 61)


@pytest.mark.parametrize("scores,want", [([0.9, 0.5], 1.0), ([0.88], 0.88), ([0.2], 0.2), ([0.6, 0.4, 0.4, 0.4, 0.4], 1.0), ([0.95], 0.95), ([0.5, 0.1, 0.1], 0.56)])
def test_page_rollup(spark, scores, want):
    hits = spark.createDataFrame([("p", i, f"c{i}", s) for i, s in enumerate(scores)], "page_id string, chunk_index int, chunk_text string, score double")
    r = vectors.page_rollup(hits).first()
    assert r.score == pytest.approx(want)
    assert [c.score for c in r.chunks] == sorted(scores, reverse=True)[:3]


VECTORS = "chunk_id string, page_id string, chunk_index int, vector array<float>"


def test_defects_6_and_7_upsert(spark):
    stored = spark.createDataFrame([("a#0", "a", 0, [1.0, 0.0]), ("b#0", "b", 0, [0.0, 1.0])], VECTORS)
    new = spark.createDataFrame([("", "a", 0, [0.5, 0.5]), ("", "c", 0, [1.0]), ("", "../x", 0, [1.0, 1.0])], VECTORS)
    assert sorted(r.chunk_id for r in vectors.upsert(stored, new).collect()) == ["a#0", "b#0"]
    assert vectors.upsert(stored, new.where("false")).count() == 2
    assert vectors.delete_pages(stored, new).count() == 1


def test_defect_5_neighbours_carry_their_place(spark):
    stored = spark.createDataFrame([("a#0", "a", 0, [1.0, 0.0]), ("b#0", "b", 0, [0.0, 1.0])], VECTORS)
    got = vectors.nearest(stored, [1.0, 0.0], 2).collect()
    assert [(r.page_id, r.chunk_index, r.score) for r in got] == [("a", 0, 1.0), ("b", 0, pytest.approx(1 / 3))]


LINKED = {
    "wiki/kv-cache.md": page("KV Cache", "[[Attention]] [[attention|x]] [[kv-cache]]", sources=["a.pdf", "b.pdf"]),
    "wiki/attention.md": page("Attention", "[[KV Cache]] [[Missing]]", "entity", ["A.pdf", "a.pdf"]),
    "wiki/Rope.md": page("Rope", "[[rope]]", "source"),
    "wiki/q.md": page("Q", "[[attention]]", "query"),
}


def test_link_resolution(spark):
    pages = wiki(spark, LINKED)
    got = {(r.src, r.pos): r.dst for r in links.resolved(links.links(pages), pages).collect()}
    assert got == {("kv-cache", 0): "attention", ("kv-cache", 1): "attention", ("kv-cache", 2): "kv-cache", ("attention", 0): "kv-cache", ("attention", 1): None, ("Rope", 0): "Rope", ("q", 0): "attention"}


def test_relevance_by_hand(spark):
    pages = wiki(spark, LINKED)
    edges = graph.out_edges(pages)
    asked = spark.createDataFrame([("attention", "kv-cache"), ("attention", "q"), ("kv-cache", "q"), ("Rope", "q")], "a string, b string")
    got = {(r.a, r.b): r.relevance for r in graph.relevance_of(asked, graph.nodes(pages), edges).collect()}
    # links both ways, one shared source, entity and concept
    assert got["attention", "kv-cache"] == pytest.approx(3 * 2 + 4 * 1 + 1.2)
    assert got["attention", "q"] == pytest.approx(3 + 0.8)
    # q and kv-cache share attention, which has a link both ways and one more
    assert got["kv-cache", "q"] == pytest.approx(1.5 / math.log(3) + 1.0)
    assert got["Rope", "q"] == pytest.approx(0.8)  # nothing but the affinity of types (defect 8)
    top = {(r.id, r.other): r["rank"] for r in graph.related(graph.nodes(pages), edges, 2).collect()}
    assert top["q", "attention"] == 1 and top["q", "kv-cache"] == 2 and not any("Rope" in x for x in top)
    n = {r.id: r.link_count for r in graph.link_counts(pages).collect()}
    assert n == {"kv-cache": 3, "attention": 4, "Rope": 0, "q": 1}


def test_visual_graph_leaves_queries_out_but_not_their_weight(spark):
    nodes, edges = graph.visual_graph(wiki(spark, LINKED))
    assert {r.id for r in nodes.collect()} == {"kv-cache", "attention", "Rope"}
    e = edges.collect()
    assert len(e) == 1 and (e[0].source, e[0].target) == ("kv-cache", "attention") and e[0].weight == pytest.approx(11.2)


CLIQUES = [(a, b, 1.0) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 1.0)]


def test_two_cliques_are_two_communities(spark):
    nodes = spark.createDataFrame([(c, i) for i, c in enumerate("abcdwxyz")], "id string, ord int")
    edges = spark.createDataFrame(CLIQUES, "source string, target string, weight double")
    got = {r.id: r.community for r in community.louvain(nodes, edges).collect()}
    assert {got[c] for c in "abcd"} == {"a"} and {got[c] for c in "wxyz"} == {"w"}
    spread = {r.id: r.community for r in community.label_propagation(nodes, edges).collect()}
    assert modularity(got, CLIQUES) >= modularity(spread, CLIQUES)


def modularity(labels, edges):
    m = sum(w for *_, w in edges)
    inside, degree = {}, {}
    for a, b, w in edges:
        inside[labels[a]] = inside.get(labels[a], 0.0) + w * (labels[a] == labels[b])
        for x in (a, b):
            degree[labels[x]] = degree.get(labels[x], 0.0) + w
    return sum(inside.get(c, 0.0) / m - (d / (2 * m)) ** 2 for c, d in degree.items())


def greedy(nodes, edges):
    """Louvain by the book, one node after the other."""
    member, near, loops = {n: n for n in nodes}, {n: {} for n in nodes}, dict.fromkeys(nodes, 0.0)
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    total = 2 * sum(w for *_, w in edges)
    while True:
        degree = {n: sum(near[n].values()) + loops[n] for n in near}
        c, sums, moved = {n: n for n in near}, dict(degree), False
        again = True
        while again:
            again = False
            for n in near:
                into = {c[n]: 0.0}
                for m, w in near[n].items():
                    into[c[m]] = into.get(c[m], 0.0) + w
                sums[c[n]] -= degree[n]
                best = max(into, key=lambda x: (round(into[x] - sums[x] * degree[n] / total, 9), x == c[n]))
                again |= best != c[n]
                moved |= best != c[n]
                c[n] = best
                sums[best] += degree[n]
        if not moved:
            return member
        member = {n: c[k] for n, k in member.items()}
        new = {k: {} for k in set(c.values())}
        new_loops = dict.fromkeys(new, 0.0)
        for n in near:
            new_loops[c[n]] += loops[n]
            for m, w in near[n].items():
                if c[n] == c[m]:
                    new_loops[c[n]] += w
                else:
                    new[c[n]][c[m]] = new[c[n]].get(c[m], 0.0) + w
        near, loops = new, new_loops


@pytest.mark.parametrize("groups, size, outside", [(6, 25, 0.1)])
def test_communities_are_as_good_as_those_of_one_task(spark, groups, size, outside):
    import random

    r = random.Random(groups)
    ids = [f"p{i:03}" for i in range(groups * size)]
    edges = {}
    for i in range(len(ids)):
        for _ in range(5):
            j = i // size * size + r.randrange(size) if r.random() > outside else r.randrange(len(ids))
            if i != j:
                edges[ids[min(i, j)], ids[max(i, j)]] = 1.0 + r.randrange(3)
    edges = [(a, b, w) for (a, b), w in edges.items()]
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(ids)], "id string, ord int")
    got = {x.id: x.community for x in community.louvain(nodes, spark.createDataFrame(edges, "source string, target string, weight double")).collect()}
    assert got.keys() == set(ids)
    assert modularity(got, edges) >= 0.97 * modularity(greedy(ids, edges), edges)


def test_communities_without_edges(spark):
    nodes = spark.createDataFrame([("a", 0), ("b", 1)], "id string, ord int")
    none = spark.createDataFrame([], "source string, target string, weight double")
    assert {r.id: r.community for r in community.louvain(nodes, none).collect()} == {"a": "a", "b": "b"}


def graph_of(spark, nodes, edges):
    return (
        spark.createDataFrame(nodes, "id string, ord int, label string, type string, link_count bigint, community int"),
        spark.createDataFrame(edges, "source string, target string, weight double"),
    )


def test_surprising_connections(spark):
    n, e = graph_of(spark, [("a", 0, "A", "source", 1, 0), ("b", 1, "B", "concept", 4, 1), ("c", 2, "C", "concept", 3, 1), ("index", 3, "I", "x", 1, 5)], [("a", "b", 1.5), ("b", "c", 5.0), ("a", "index", 1.0)])
    got = insights.surprising_connections(n, e).collect()
    assert [(r.key, r.score) for r in got] == [("a:::b", 8)]
    assert got[0].reasons == ["crosses community boundary", "connects source to concept", "peripheral node links to hub", "weak but present connection"]
    assert insights.without_dismissed(insights.surprising_connections(n, e), spark.createDataFrame([("a:::b",)], "key string")).count() == 0


def test_statistics_and_bridges(spark):
    n, e = graph_of(spark, [(f"n{i}", i, f"L{i}", "concept", 9 - i, i % 4) for i in range(8)], [("n0", "n4", 1.0), ("n0", "n1", 1.0), ("n0", "n2", 1.0), ("n0", "n3", 1.0)])
    s = {r.community: r for r in community.statistics(n, e).collect()}
    assert s[0].intra_edges == 1 and s[0].cohesion == 1.0 and s[0].top_nodes == ["L0", "L4"] and s[1].cohesion == 0.0
    assert [r.id for r in insights.bridges(n, e).collect()] == ["n0"]
    assert [r.number for r in community.renumbered(community.statistics(n, e)).orderBy("first").collect()] == [0, 1, 2, 3]


LINTED = {"wiki/index.md": "[[a]]", "wiki/a.md": "[[dir/b]] [[gone]] [[gone]]", "wiki/dir/b.md": "plain", "wiki/self.md": "[[self]]", "wiki/c.md": "[[other/b]]"}


def test_lint_with_defect_12(spark):
    pages = wiki(spark, LINTED)
    # other/b isn't broken, as b exists, but gives no page credit; a link to oneself does
    assert sorted(r.page_id for r in lint.orphans(pages).collect()) == ["c"]
    assert [r.page_id for r in lint.no_outlinks(pages).collect()] == ["b"]
    assert [(r.page_id, r.pos, r.link) for r in lint.broken_links(pages).orderBy("pos").collect()] == [("a", 1, "gone"), ("a", 2, "gone")]


def test_semantic_findings(spark):
    t = "x\n---LINT: contradiction | warning | A vs B ---\nThey differ.\nPAGES: a.md, b.md\n---END LINT---\n"
    got = spark.createDataFrame([(t,)], "t string").select(lint.semantic(F.col("t")).alias("f")).first().f
    assert [(x.kind, x.severity, x.title, x.pages, x.detail) for x in got] == [("contradiction", "warning", "A vs B", ["a.md", "b.md"], "They differ.")]


def test_review_blocks(spark):
    t = "---REVIEW: Missing-Page | Missing page: X ---\nNeeds it.\nOPTIONS: Create | Skip\nPAGES: a.md\nSEARCH: q1 | q2\n---END REVIEW---\n---REVIEW: odd | T ---\n---END REVIEW---"
    a, b = spark.createDataFrame([(t,)], "t string").select(reviews.parsed(F.col("t")).alias("f")).first().f
    assert (a.type, a.title, a.options, a.pages, a.queries, a.description) == ("missing-page", "Missing page: X", ["Create", "Skip"], ["a.md"], ["q1", "q2"], "Needs it.")
    assert (b.type, b.description) == ("confirm", "")


ITEM = "id string, type string, title string, description string, source_path string, pages array<string>, queries array<string>, resolved boolean, created_at bigint"


def test_reviews_merge_and_sweep(spark):
    rows = [
        ("1", "missing-page", "Missing page: KV Cache", "old", "s1", ["a"], ["q"], False, 1),
        ("2", "missing-page", "kv  cache", "", None, ["b", "a"], ["r"], False, 2),
        ("3", "missing-page", "KV Cache", "x", None, [], [], True, 3),
        ("4", "duplicate", "Dup", "", None, ["wiki/kv-cache.md", "wiki/gone.md"], [], False, 4),
        ("5", "duplicate", "Dup2", "", None, ["wiki/kv-cache.md"], [], False, 5),
        ("6", "contradiction", "kv cache", "", None, [], [], False, 6),
        ("7", "missing-page", "Nowhere", "", None, [], [], False, 7),
    ]
    items = spark.createDataFrame(rows, ITEM)
    m = {r.id: r for r in reviews.merged(items).collect()}
    assert (m["1"].description, m["1"].source_path, m["1"].pages, m["1"].queries, m["1"].n_merged) == ("old", "s1", ["a", "b"], ["q", "r"], 2)
    assert "3" not in m
    pages = spark.createDataFrame([("kv-cache", "KV Cache")], "page_id string, title string")
    assert {r.id: r.action for r in reviews.swept(items, pages).collect()} == {"1": "page-exists", "2": "page-exists", "4": "page-gone"}
    assert [r.batch for r in reviews.batches(items).collect()] == [0] * 6


def test_actions(spark):
    df = spark.createDataFrame([("Research this", "suggestion"), ("Skip", "suggestion"), ("Create entity page", "missing-page"), ("Create Page", "missing-page"), ("__x research", "a")], "a string, t string")
    got = df.select(reviews.action_kind(F.col("a")), reviews.page_type(F.col("a"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("research", "query"), ("dismiss", "query"), ("create", "entity"), ("create", "concept"), ("create", "query")]


@pytest.mark.parametrize("size,want", [(8192, (8192, 1228, 409, 4096, 4096)), (32000, (32000, 4800, 1600, 16000, 5000)), (131072, (131072, 19660, 6553, 65536, 19660)), (0, (204800, 30720, 10240, 102400, 30720)), (1000000, (1000000, 150000, 50000, 500000, 150000))])
def test_budget(spark, size, want):
    assert tuple(spark.range(1).select(context.budget(F.lit(size)).alias("b")).first().b) == want


def test_packing_skips_and_goes_on(spark):
    rows = [(0, "a", 0, 1, "x" * 60), (0, "b", 1, 1, "y" * 60), (0, "c", 1, 2, "z" * 30)]
    got = context.packed(spark.createDataFrame(rows, "query_id bigint, page_id string, priority int, place int, content string"), 100, 5000)
    assert [r.page_id for r in got.orderBy("position").collect()] == ["a", "c"]


def test_expansions(spark):
    seeds = spark.createDataFrame([("s1", 1), ("s2", 2)], "id string, rank int")
    rel = spark.createDataFrame([("s1", "x", 3.0, 1), ("s1", "s2", 9.0, 2), ("s1", "low", 1.9, 3), ("s2", "x", 8.0, 1), ("s2", "y", 5.0, 2), ("s2", "z", 4.0, 4)], "id string, other string, relevance double, rank int")
    assert [(r.id, r.relevance) for r in context.expansions(seeds, rel).orderBy("place").collect()] == [("y", 5.0), ("x", 3.0)]


def test_citations_and_index(spark):
    rows = [("text <!-- cited: 1, 9, 2 -->", 3), ("see [2] and [2] and [7]", 3), ("none", 3)]
    assert [r[0] for r in spark.createDataFrame(rows, "a string, n int").select(context.cited(F.col("a"), F.col("n"))).collect()] == [[1, 2], [2], []]
    index = "## H\n- [[rope]] x\n- [[other]] y\n" + "- filler\n" * 50
    got = spark.createDataFrame([(index,)], "i string").select(context.trimmed_index(F.col("i"), F.array(F.lit("rope")), F.lit(40))).first()[0]
    assert got == "## H\n- [[rope]] x" + context.TRIMMED


def test_conversations(spark):
    rows = [("c", i, r, f"t{i}") for i, r in enumerate(["system", "user", "assistant", "user", "assistant"])] + [("d", 0, "user", "x" * 80)]
    m = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert sorted(r.turn for r in chat.history(m, 3).where("conv_id = 'c'").collect()) == [2, 3, 4]
    assert chat.without_last_answer(m).count() == 5
    assert {r.conv_id: r.title for r in chat.titles(m).collect()} == {"c": "t1", "d": "x" * 50}


def similar(a, b):
    """By the definition, over all pairs."""
    import re

    na, nb = (re.sub(r"[\s_\-·•]", "", x.lower()) for x in (a, b))

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = [i] + [0] * len(y) if False else _next(row, i, c, y)
        return row[-1]

    def _next(row, i, c, y):
        new = [i]
        for j, d in enumerate(y, 1):
            new.append(row[j - 1] if c == d else 1 + min(row[j], new[-1], row[j - 1]))
        return new

    n = max(len(na), len(nb))
    return na == nb or (len(na) > 1 and len(nb) > 1 and (na in nb or nb in na)) or n <= 8 and lev(na, nb) <= 1 or n <= 12 and lev(na, nb) <= 2


def test_entity_matches_lose_nothing(spark):
    import random

    r = random.Random(3)
    name = lambda: "".join(r.choice("abcd -") for _ in range(r.randrange(1, 14)))
    new, known = [(i, name()) for i in range(60)], [(f"k{i}", name(), i) for i in range(60)]
    got = {x.id: x.known_id for x in ingest.name_matches(spark.createDataFrame(new, "id int, name string"), spark.createDataFrame(known, "known_id string, known_name string, ord int")).collect()}
    want = {}
    for i, a in new:
        hits = [k for k, b, _ in known if similar(a, b)]
        if hits:
            want[i] = hits[0]
    assert got == want


def test_file_blocks_with_defect_9():
    t = "---FILE: wiki/a.md---\n```\n---END FILE---\n```\nx\n---END FILE---\n--- file: ../evil.md ---\ny\n---END FILE---\r\n---FILE: wiki/open.md---\nz"
    files, warnings = ingest.file_blocks(t)
    assert files == [("wiki/a.md", "```\n---END FILE---\n```\nx")]
    assert warnings == ["unsafe path: ../evil.md", "unclosed block: wiki/open.md"]


def test_parsers_run_in_tasks(spark):
    df = spark.createDataFrame([("---FILE: wiki/a.md---\nx\n---END FILE---", 'say {"a": "}"} ok')], "f string, j string")
    r = df.select(ingest.parse_files("f").alias("p"), ingest.extract_json("j").alias("j")).first()
    assert r.p.files[0].path == "wiki/a.md" and r.j == '{"a": "}"}'


def test_json_objects():
    assert ingest.json_object('```json\n{"a": {"b": "\\"}"}}\n```') == '{"a": {"b": "\\"}"}}'
    assert ingest.json_object("none") == "" and ingest.json_object("{open") == ""


def test_links_are_applied_once(spark):
    got = ingest.linked("---\ntitle: RoPE\n---\nRoPE and RoPE, [[KV]] KV", [("RoPE", "rope"), ("KV", "KV"), ("none", "n")])
    assert got == "---\ntitle: RoPE\n---\n[[rope|RoPE]] and RoPE, [[KV]] [[KV]]"
    pages = spark.createDataFrame([("p", "a b"), ("q", "a")], "page_id string, content string")
    terms = spark.createDataFrame([("p", "b", "bb", 0)], "page_id string, term string, target string, pos int")
    assert {r.page_id: r.content for r in ingest.apply_links(pages, terms).collect()} == {"p": "a [[bb|b]]", "q": "a"}


def test_merge_write(spark):
    old = spark.createDataFrame([("wiki/a.md", page("A", "old", sources=["x.pdf"])), ("wiki/log.md", "one\n"), ("wiki/index.md", "old")], "path string, content string")
    new = spark.createDataFrame([("wiki/a.md", page("A", "new", sources=["X.pdf", "y.pdf"])), ("wiki/log.md", "two"), ("wiki/index.md", "new"), ("wiki/b.md", "b")], "path string, content string")
    got = {r.path: r.content for r in ingest.merged_pages(old, new).collect()}
    assert 'sources: ["x.pdf", "y.pdf"]' in got["wiki/a.md"] and "new" in got["wiki/a.md"]
    assert (got["wiki/log.md"], got["wiki/index.md"], got["wiki/b.md"]) == ("one\ntwo", "new", "b")


def test_alias(spark):
    df = spark.createDataFrame([(page("A"),), ("---\ntitle: x\naliases: [Old]\n---\nb",)], "c string")
    got = [r[0] for r in df.select(ingest.with_alias(F.col("c"), F.lit("old"))).collect()]
    assert 'aliases: ["old"]' in got[0] and got[1] == "---\ntitle: x\naliases: [Old]\n---\nb"


def test_defect_10_related_pages_and_cascade(spark):
    pages = wiki(
        spark,
        {
            "wiki/index.md": '- [[Only]] x\n- [[both]] y\n"a.pdf"',
            "wiki/only.md": page("Only", sources=["A.pdf"]),
            "wiki/both.md": page("Both", "see [[only|it]] and [[Only]]", sources=["a.pdf", "b.pdf"]),
            "wiki/sources/a-summary.md": page("S", sources=["c.pdf"]),
            "wiki/text.md": page("Text", "mentions a.pdf in prose"),
        },
    )
    assert sorted(r.page_id for r in cascade.related_pages(pages, "a.pdf").collect()) == ["a-summary", "both", "only"]
    got = {r.page_id: r for r in cascade.delete_source(pages, "a.pdf").collect()}
    assert {k: v.action for k, v in got.items()} == {"index": "relink", "only": "delete", "both": "keep"}
    assert got["index"].content == '- [[both]] y\n"a.pdf"'
    assert 'sources: ["b.pdf"]' in got["both"].content and "see it and Only" in got["both"].content
    assert got["only"].content is None


def test_cache(spark):
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "source string, hash string")
    old = spark.createDataFrame([("a", "1", ["f"]), ("b", "x", ["f"]), ("c", "3", ["f", "lost"])], "source string, hash string, files_written array<string>")
    got = {r.source: r.status for r in ingest.cache_status(cur, old, spark.createDataFrame([("f",)], "path string")).collect()}
    assert got == {"a": "hit", "b": "changed", "c": "changed", "d": "new"}


def test_rendered_links(spark):
    got = spark.createDataFrame([("[[a|b]] [[c]] [[d]",)], "t string").select(links.rendered(F.col("t"))).first()[0]
    assert got == "[b](wikilink:a) [c](wikilink:c) [d](wikilink:d)"


def test_defect_12_fate_is_case_insensitive(spark):
    df = spark.createDataFrame([(["A.md"],), (["a.md", "b"],), (["c"],)], "s array<string>")
    got = df.select(cascade.fate(F.col("s"), F.lit("a.MD")).alias("f")).collect()
    assert [(r.f.action, r.f.survivors) for r in got] == [("delete", []), ("keep", ["b"]), ("skip", ["c"])]


def test_sources_of_a_page_without_front_matter(spark):
    df = spark.createDataFrame([("text\nsources: [a.pdf]\n",)], "c string")
    assert df.select(fm.sources(F.col("c"))).first()[0] == ["a.pdf"]


def test_defect_4_pages_found_by_vector_alone_may_lie_anywhere(spark):
    pages = wiki(spark, {**SEARCHED, "wiki/comparisons/a-b.md": page("A and B"), "wiki/root.md": page("Root")})
    near = spark.createDataFrame([("a-b", 0.9), ("root", 0.8), ("ghost", 0.7)], "page_id string, score double")
    got = [r.page_id for r in search.search(pages, "attention", near).collect()]
    assert set(got) == {"attention", "transformer", "a-b", "root"}


def test_neighbours_in_blocks(spark, monkeypatch):
    import random

    r = random.Random(2)
    rows = spark.createDataFrame([(f"c{i}", [r.random() for _ in range(4)]) for i in range(60)], "chunk_id string, vector array<float>")
    asked = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(9)], "query_id int, query_vector array<float>")
    one = {(x.query_id, x.chunk_id, x["rank"]) for x in vectors.nearest_batch(rows, asked, 3).collect()}
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 25)
    assert {(x.query_id, x.chunk_id, x["rank"]) for x in vectors.nearest_batch(rows, asked, 3).collect()} == one
