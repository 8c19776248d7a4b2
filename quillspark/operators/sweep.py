"""The second stage of the review sweep: a model judges what no rule has resolved.

Of each project the first BATCHES batches of BATCH pending items may go to the model, with up to PAGES of its
pages. After a batch of which the model resolves nothing no other is asked. Projects are judged apart from
each other, each within one task, whose rows these three numbers bound. Any error, and any answer that
can't be read, resolves nothing. Every call is made once, as answers are written before they are read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.ingest import json_object
from quillspark.operators.reviews import BATCH, BATCHES
from quillspark.sources.shared import stashed

PAGES, DESCRIPTION = 300, 200
ASKED = "project_id string, batch int, n_items int, resolved array<string>"


def prompt(items: list[dict], pages: list[dict]) -> str:
    """What the model is asked: the project's pages and a batch of its items."""
    known = [f"- {p['page_id']}" + (f"  (title: {p['title']})" if p["title"] else "") for p in pages]
    asked = []
    for r in items:
        affected = f" | affected: {', '.join(r['pages'])}" if r["pages"] is not None and len(r["pages"]) else ""
        about = f" — {r['description'][:DESCRIPTION]}" if r["description"] else ""
        asked.append(f"- id={r['id']} [{r['type']}] \"{r['title']}\"{about}{affected}")
    return "\n".join([
        "Some items of this wiki's review queue may be settled by now, as pages were added, merged or deleted.",
        "", "Pages:", *(known or ["(no pages yet)"]), "", "Items:", *asked, "",
        'Answer with JSON only: {"resolved": [ids of the items that are settled beyond doubt]}. Leave all others pending.',
    ])


def resolved_of(answer: str | None, ids: list[str]) -> list[str]:
    """The ids that an answer resolves, as far as they were asked for."""
    try:
        got = json.loads(json_object(answer or ""))["resolved"]
        return [i for i in ids if i in {x for x in got if isinstance(x, str)}] if isinstance(got, list) else []
    except (ValueError, KeyError, TypeError):
        return []


def asked(items: DataFrame, pages: DataFrame, judge: Callable[[str], str]) -> DataFrame:
    """A row (ASKED) for each batch that the judge, given a prompt, was asked about, with what it resolved.

    items: project_id, id, type, title, description, pages, created_at; those still pending. pages: project_id, ord, page_id, title.
    """
    nth = F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", "id"))
    first = items.withColumn("nth", nth).where(F.col("nth") <= BATCH * BATCHES)
    listed = pages.withColumn("nth", F.row_number().over(Window.partitionBy("project_id").orderBy("ord", "page_id"))).where(F.col("nth") <= PAGES)
    own = first.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "type", "title", "description", "pages"))).alias("items"))
    known = listed.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("nth", "page_id", "title"))).alias("known"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for project, queue, there in zip(f["project_id"], f["items"], f["known"]):
                for k in range(0, len(queue), BATCH):
                    batch = list(queue[k : k + BATCH])
                    ids = [r["id"] for r in batch]
                    try:
                        got = resolved_of(judge(prompt(batch, [] if there is None else list(there))), ids)
                    except Exception:
                        got = []
                    rows.append((project, k // BATCH, len(batch), got))
                    if not got:
                        break
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ASKED.split(", ")])

    return stashed(own.join(known, "project_id", "left").mapInPandas(run, ASKED))


def judged(items: DataFrame, pages: DataFrame, judge: Callable[[str], str]) -> DataFrame:
    """project_id, id and action of the items that the judge resolves."""
    return asked(items, pages, judge).select("project_id", F.explode("resolved").alias("id")).withColumn("action", F.lit("llm-judged"))
