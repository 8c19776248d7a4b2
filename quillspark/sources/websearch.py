"""Web search: a data source, a table function for SQL, and a function over DataFrames; no network by itself.

A transport is a callable (query, options) that gives a provider's answer as a dict. It is named
by an option, "module:callable", and called on the executors. Answers have one of two layouts: a list
of results, or a text with citations.

    websearch.register(spark)
    spark.read.format("web_search").option("queries", '["a", "b"]').option("transport", "my.module:call").load()
    spark.sql("SELECT t.id, r.* FROM t, LATERAL web_search(t.query, 'my.module:call', 'results', 10) r")
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from quillspark.sources.shipping import shipped

SCHEMA = "title string, url string, snippet string, source string"
MOST = 10
# What stands for a provider whose answer is a text, and how much of query and text is shown.
ANSWER_TITLE, ANSWER_URL, ANSWER_SOURCE, TITLE_CHARS, SNIPPET_CHARS = "Perplexity: ", "https://www.perplexity.ai", "perplexity.ai", 60, 800


def host(url: str) -> str:
    return (urlsplit(url).hostname or "").removeprefix("www.")


def from_results(answer: dict) -> list[dict]:
    """Rows of an answer with a list of results: title, url, content."""
    return [{"title": r.get("title") or "Untitled", "url": r.get("url") or "", "snippet": r.get("content") or "", "source": host(r.get("url") or "")} for r in answer.get("results") or []]


def from_citations(answer: dict, name: str = "answer") -> list[dict]:
    """A row for the answer's text, then one for each address that it cites."""
    text = ((answer.get("choices") or [{}])[0].get("message") or {}).get("content") or ""
    rows = [{"title": name, "url": "", "snippet": text, "source": name}] if text else []
    return rows + [{"title": host(u) or u, "url": u, "snippet": "", "source": host(u)} for u in answer.get("citations") or []]


def search(queries: DataFrame, transport: Callable[[str], dict], parse: Callable[[dict], list[dict]] = from_results, at_once: int = 3) -> DataFrame:
    """query_pos, pos and the rows that transport(query) gives for queries (query_pos, query); an error gives none.

    at_once partitions bound how many queries run at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for n, q in zip(f["query_pos"], f["query"]):
                try:
                    found = parse(transport(q))
                except Exception:
                    found = []
                rows += [{"query_pos": n, "pos": k, **r} for k, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=["query_pos", "pos", "title", "url", "snippet", "source"])

    return queries.select("query_pos", "query").repartition(at_once).mapInPandas(run, f"query_pos int, pos int, {SCHEMA}")


def results_rows(query: str, answer: Mapping, most: int = MOST) -> list[tuple]:
    """Rows (title, url, snippet, source) of a list of results; one without a valid address fails the query."""
    rows = []
    for r in answer.get("results") or []:
        url = r.get("url") or ""
        if not urlsplit(url).hostname:
            raise ValueError(f"Invalid URL: {url}")
        either = lambda k, other: other if r.get(k) is None else r[k]  # noqa: B023, E731
        rows.append((either("title", "Untitled"), url, either("content", ""), urlsplit(url).hostname.replace("www.", "", 1)))
    return rows


def answer_rows(query: str, answer: Mapping, most: int = MOST) -> list[tuple]:
    """A row for an answer's text, which has the first citation's address, and one for each further citation with a valid one."""
    text = ((answer.get("choices") or [{}])[0].get("message") or {}).get("content") or ""
    cited = list(answer.get("citations") or [])
    rows = [(ANSWER_TITLE + query[:TITLE_CHARS], cited[0] if cited else ANSWER_URL, text[:SNIPPET_CHARS], ANSWER_SOURCE)] if text else []
    for n, url in enumerate(cited[1:most], 2):
        if host_ := urlsplit(url).hostname:
            rows.append((f"Source {n}", url, "", host_.replace("www.", "", 1)))
    return rows[:most]


LAYOUTS: dict[str, Callable[[str, Mapping, int], list[tuple]]] = {"results": results_rows, "answer": answer_rows}


def named(transport: str) -> Callable[[str, Mapping], Mapping]:
    """The callable that "module:callable" names."""
    module, _, name = transport.partition(":")
    if not name:
        raise ValueError(f"a transport is given as module:callable, not as {transport!r}")
    return getattr(importlib.import_module(module), name)


def replayed(query: str, options: Mapping) -> Mapping:
    """A transport that answers from the option answers, JSON by query; a query that isn't there fails."""
    answers = json.loads(options["answers"])
    if query not in answers:
        raise LookupError(f"no answer is recorded for {query!r}")
    return answers[query]


def rows_of(query: str, transport: str, layout: str, most: int, options: Mapping) -> list[tuple]:
    if layout not in LAYOUTS:
        raise ValueError(f"Unknown search provider: {layout}")
    return LAYOUTS[layout](query, named(transport)(query, options), most)


class _Queries(InputPartition):
    def __init__(self, queries: list[tuple[int, str]]):
        self.queries = queries


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)
        self.queries = list(enumerate(json.loads(options.get("queries", "[]"))))
        if not options.get("transport"):
            raise ValueError("Web search not configured. Give a transport.")
        self.most, self.layout = int(options.get("maxresults", MOST)), options.get("layout", "results")
        self.skips = options.get("onerror", "fail") == "skip"
        self.at_once = int(options.get("atonce", 0)) or len(self.queries)

    def partitions(self) -> list[InputPartition]:
        """One for each query, or as many as may run at once."""
        parts: list[list] = [[] for _ in range(min(self.at_once, len(self.queries)))]
        for k, q in self.queries:
            parts[k % len(parts)].append((k, q))
        return [_Queries(p) for p in parts] or [_Queries([])]

    def read(self, partition: _Queries) -> Iterator[tuple]:
        for k, q in partition.queries:
            try:
                found = rows_of(q, self.options["transport"], self.layout, self.most, self.options)
            except Exception:
                if not self.skips:
                    raise
                found = []
            yield from ((k, q, n, *row) for n, row in enumerate(found))


class WebSearch(DataSource):
    """Format web_search. Options: queries (a JSON list), transport, layout (results, answer), maxResults, atOnce, onError (fail, skip), and what the transport asks for."""

    @classmethod
    def name(cls) -> str:
        return "web_search"

    def schema(self) -> str:
        return f"query_pos int, query string, pos int, {SCHEMA}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


class WebSearchRows:
    """Table function web_search(query, transport, layout, max_results): pos and a result's columns; a null query has none."""

    def eval(self, query: str, transport: str, layout: str = "results", most: int = MOST):
        for n, row in enumerate(rows_of(query, transport, layout, most, {}) if query is not None else []):
            yield (n, *row)


def register(spark: SparkSession) -> None:
    """Makes the format and the table function known to the session."""
    shipped(spark)
    spark.dataSource.register(WebSearch)
    spark.udtf.register("web_search", udtf(WebSearchRows, returnType=f"pos int, {SCHEMA}"))


def echoed(query: str, options: Mapping) -> Mapping:
    """A transport for tests and dry runs, which makes three results of the query itself."""
    word = (query.split() or ["nothing"])[0]
    return {"results": [{"title": None if k == 2 else f"{query} {k}", "url": f"https://www.site{k}.example/{word.lower()}", "content": f"about {query}"} for k in range(3)]}
