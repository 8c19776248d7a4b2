"""Stored state of projects: reviews and conversations as JSON files, of today's layout and two earlier ones.

Files are rows of project_id, path (below the project's folder of state) and text. Of a project's conversations
    1. conversations.json lists them, and chats/<id>.json has each one's messages; those without a file have none;
    2. else chat-history.json has conversations and messages in one object;
    3. or it is a list of messages, which become one conversation.
The first layout that can be read counts. What can't be read is as if it weren't there. Each project is detected for itself, all in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONVERSATION = "struct<id:string,title:string,createdAt:bigint,updatedAt:bigint>"
MESSAGE = "struct<id:string,role:string,content:string,timestamp:bigint,conversationId:string,references:array<struct<title:string,path:string>>>"
REVIEW = (
    "struct<id:string,type:string,title:string,description:string,sourcePath:string,affectedPages:array<string>,searchQueries:array<string>,"
    "options:array<struct<label:string,action:string>>,resolved:boolean,resolvedAction:string,createdAt:bigint>"
)
# The conversation that messages of the oldest layout become, and how many messages of one are stored.
DEFAULT_ID, DEFAULT_TITLE, STORED = "default", "Previous Conversations", 100


def _list(text: Column, kind: str) -> Column:
    """A list of kind; null if the text isn't one."""
    return F.when(text.rlike("\\A\\s*\\["), F.from_json(text, f"array<{kind}>"))


def review_items(files: DataFrame) -> DataFrame:
    """project_id, pos and the fields of the items in review.json."""
    rows = files.where("path = 'review.json'").select("project_id", F.posexplode(_list(F.col("text"), REVIEW)).alias("pos", "r"))
    return rows.select("project_id", "pos", "r.*")


def chats(files: DataFrame, now: Column | None = None) -> dict[str, DataFrame]:
    """conversations and messages of all projects, with layout (split, combined or flat) and pos, the place in its file.

    now stands for the times, in milliseconds, of a list without messages.
    """
    now = F.unix_millis(F.current_timestamp()) if now is None else now
    text = F.col("text")
    listed = files.where("path = 'conversations.json'").select("project_id", _list(text, CONVERSATION).alias("c")).where("c IS NOT NULL")
    parts = files.where(F.col("path").rlike("^chats/[^/]+\\.json$")).select("project_id", F.regexp_extract("path", "^chats/([^/]+)\\.json$", 1).alias("id"), _list(text, MESSAGE).alias("m"))
    split_c = listed.select("project_id", F.posexplode("c").alias("pos", "c")).select("project_id", F.lit("split").alias("layout"), "pos", "c.*")
    split_m = parts.join(split_c.select("project_id", "id"), ["project_id", "id"], "left_semi").select("project_id", F.posexplode("m").alias("pos", "m"))

    old = files.where("path = 'chat-history.json'").join(listed.select("project_id"), "project_id", "left_anti")
    both = F.when(text.rlike("\\A\\s*\\{"), F.from_json(text, f"struct<conversations:array<{CONVERSATION}>,messages:array<{MESSAGE}>>"))
    old = old.select("project_id", both.alias("b"), _list(text, MESSAGE).alias("m"))
    combined_c = old.select("project_id", F.posexplode("b.conversations").alias("pos", "c")).select("project_id", F.lit("combined").alias("layout"), "pos", "c.*")
    combined_m = old.select("project_id", F.posexplode("b.messages").alias("pos", "m"))
    flat = old.where("m IS NOT NULL")
    time = lambda at: F.coalesce(F.try_element_at("m", F.lit(at))["timestamp"], now)
    flat_c = flat.select("project_id", F.lit("flat").alias("layout"), F.lit(0).alias("pos"), F.lit(DEFAULT_ID).alias("id"), F.lit(DEFAULT_TITLE).alias("title"), time(1).alias("createdAt"), time(-1).alias("updatedAt"))
    flat_m = flat.select("project_id", F.posexplode(F.transform("m", lambda m: m.withField("conversationId", F.lit(DEFAULT_ID)))).alias("pos", "m"))

    messages = None
    for layout, rows in (("split", split_m), ("combined", combined_m), ("flat", flat_m)):
        rows = rows.select("project_id", F.lit(layout).alias("layout"), "pos", "m.*")
        messages = rows if messages is None else messages.unionByName(rows)
    return {"conversations": split_c.unionByName(combined_c).unionByName(flat_c), "messages": messages}


def stored(conversations: DataFrame, messages: DataFrame, last: int = STORED) -> DataFrame:
    """Files (project_id, path, text) of today's layout, with the last messages of each conversation.

    A conversation's file holds so many messages at most; a project's list holds all its conversations.
    """
    fields = lambda kind: [p.split(":")[0] for p in kind[len("struct<") : -1].replace("array<struct<title:string,path:string>>", "x").split(",")]
    json = lambda kind: F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields(kind)).alias("x")))), lambda s: s["x"]))
    back = Window.partitionBy("project_id", "conversationId").orderBy(F.desc("pos"))
    kept = messages.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= last)
    parts = kept.groupBy("project_id", "conversationId").agg(json(MESSAGE).alias("text"))
    lists = conversations.groupBy("project_id").agg(json(CONVERSATION).alias("text"))
    return parts.select("project_id", F.concat(F.lit("chats/"), "conversationId", F.lit(".json")).alias("path"), "text").unionByName(lists.select("project_id", F.lit("conversations.json").alias("path"), "text"))
