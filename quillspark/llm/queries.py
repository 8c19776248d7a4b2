"""Queries that apply the operators to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import ballmeans, extraction, fingerprint, lexical, mixing, neardup, packing, ranking, rules, secrets, toxicity, urlfilter, vectordup
from quillspark.llm.common import held_out, table, tuned


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(tuned(spark), sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(tuned(spark), sf_dir, "pages").select("page_id", "url", "html"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprinted(table(tuned(spark), sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.scored(docs.select("doc_id", "text"), toxicity.trained(docs, labels))
    return scored.select("doc_id", held_out("doc_id", toxicity.FOLDS, toxicity.HELD_FOLD).alias("held_out"), "score", "predicted")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(tuned(spark), sf_dir, "pages").select("page_id", "url")).drop("url")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.scored(table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "mix_copy")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(tuned(spark), sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(tuned(spark), sf_dir, "documents").select("doc_id", "text"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.searched(table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballmeans.clustered(table(tuned(spark), sf_dir, "embeddings"))


def op13_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.linked(table(tuned(spark), sf_dir, "embeddings"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 counts before its method judges."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that op4 compares with the documents' own."""
    return op4_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of each url, and the verdict of those that have a rule."""
    judged = op6_url_filter(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("by_rule"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of op10's base kinds."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_best_fit_packing, op2_html_extraction, op3_quality_rules, op4_fingerprints, op5_toxicity,
    op6_url_filter, op7_quality_classifier, op8_source_mixing, op9_near_duplicates, op10_secret_scan,
    op11_lexical_search, op12_ball_kmeans, op13_vector_duplicates,
    quality_base, edited_texts, url_rules, secret_base_counts,
)}



def _kmeans_sql(k: int = ballmeans.CLUSTERS, rounds: int = ballmeans.ROUNDS) -> str:
    """The rounds one after the other; whole numbers in doubles, so that products and sums are exact."""
    steps = [f"""
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM v QUALIFY c < {k})"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min_by(c, d * 100 + c) AS c, min(d) AS d FROM
  (SELECT v.vec_id, v, c, list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m) AS d FROM v, c{r}) GROUP BY vec_id)""")  # fmt: skip
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(list_transform(n, lambda x: x), m) AS m FROM c{r} LEFT JOIN
  (SELECT c, list(x ORDER BY i) AS n FROM (SELECT c, i, floor(sum(v[i]) / count(*)) AS x FROM a{r}, range(1, 65) t(i) GROUP BY c, i) GROUP BY c) s ON s.c = c{r}.c)""")  # fmt: skip
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, a.c::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(m, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""  # fmt: skip


ORACLE_SQL: dict[str, str] = {
    "op8_source_mixing": """
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS source, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS weight FROM documents GROUP BY 1),
r AS (SELECT source, (1.0 * sum(n) OVER () * (weight / sum(weight) OVER ()) / n) AS rate FROM n),
d AS (SELECT doc_id, documents.source, rate,
        ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
      FROM documents JOIN r ON coalesce(documents.source, '') = r.source),
p(rate, k, log, cdf) AS (
  SELECT DISTINCT rate, 0, -rate, exp(-rate) FROM r
  UNION ALL
  SELECT rate, k + 1, log + ln(rate / (k + 1)), cdf + exp(log + ln(rate / (k + 1))) FROM p WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 30))
SELECT d.doc_id, d.source, p.k AS mix_copy FROM d JOIN p ON p.rate = d.rate AND p.cdf <= d.u
""",
    "op11_lexical_search": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
d AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY 1),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), s GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50
""",
    "op12_ball_kmeans": _kmeans_sql(),
    "op13_vector_duplicates": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95),
c AS (SELECT a AS vec_id, a AS o FROM (SELECT DISTINCT a FROM l) UNION SELECT c.vec_id, l.b FROM c JOIN l ON l.a = c.o),
m AS (SELECT vec_id, min(o) AS least FROM c GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, vec_id) AS component_id, vec_id = coalesce(least, vec_id) AS kept
FROM embeddings LEFT JOIN m USING (vec_id) LEFT JOIN n USING (vec_id)
""",
    "quality_base": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d), k AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM r, range(5) t(k) GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(k.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, (len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w)) AS base_failed FROM w LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    "edited_texts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next FROM documents)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(next, 1, length(t) // 4)) AS edited_sha256 FROM d
""",
    "url_rules": """
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p, says) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(says, length(h || p)) AS by_rule FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, rule, by_rule FROM u LEFT JOIN f USING (page_id)
""",
    "secret_base_counts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18))::BIGINT AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16))::BIGINT AS n_hex FROM d
""",
}
