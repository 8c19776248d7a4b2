"""What a viewer shows: page information, sections, pages behind names and citations, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import frontmatter as fm
from quillspark.functions.text import let, trimmed
from quillspark.operators.ingest import contained

# Folders below the wiki and the types they stand for, and what may be imported.
FOLDER_TYPES = (("entities", "entity"), ("concepts", "concept"), ("sources", "source"), ("queries", "query"), ("comparisons", "comparison"), ("synthesis", "synthesis"))
CITED_FOLDERS = ("entities", "concepts", "sources", "queries", "synthesis", "comparisons")
IMPORTED = ("md", "mdx", "txt", "pdf", "docx", "pptx", "xlsx", "xls", "csv", "json", "html")


def page_info(content: Column, path: Column) -> Column:
    """A struct of title, type, tags and origin; type and title fall back to folder, heading and file name."""
    file = F.regexp_extract(path, "([^/]*)$", 1)
    named = F.replace(F.replace(file, F.lit(".md"), F.lit("")), F.lit("-"), F.lit(" "))
    head = F.regexp_extract(content, "\\A---\\n([\\s\\S]*?)\\n---", 1)
    line = lambda name, value: trimmed(F.regexp_extract(head, f"(?m)^{name}:\\s*{value}\\s*$", 1))
    or_null = lambda c: F.nullif(c, F.lit(""))
    title = F.coalesce(or_null(line("title", "[\"']?(.+?)[\"']?")), named)
    title = F.when(title == named, F.coalesce(or_null(fm.heading(content)), named)).otherwise(title)
    given = F.coalesce(or_null(F.lower(line("type", "(.+?)"))), F.lit("other"))
    by_folder = None
    for folder, kind in FOLDER_TYPES:
        test = F.contains(path, F.lit(f"/{folder}/"))
        by_folder = F.when(test, kind) if by_folder is None else by_folder.when(test, kind)
    by_folder = by_folder.when(file == "overview.md", "overview").otherwise("other")
    tags = F.regexp_extract(head, "(?m)^tags:\\s*\\[(.+?)\\]", 1)
    return F.struct(
        title.alias("title"),
        F.when(given == "other", by_folder).otherwise(given).alias("type"),
        F.when(tags == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(tags, ","), lambda t: F.regexp_replace(trimmed(t), "[\"']", ""))).alias("tags"),
        or_null(line("origin", "(.+?)")).alias("origin"),
    )


def front_matter(content: Column) -> Column:
    """A struct of scalars and lists, maps of what stands in the front matter, each key's last value.

    The block is cut once, where a line begins with a key, so that each entry has its own lines only.
    """
    entries = F.split(F.replace(fm.block(content), F.lit("\r\n"), F.lit("\n")), "\n(?=\\w+:)")
    inline, scalar = "^\\w+:\\s*\\[(.*)\\]\\s*$", "^\\w+:\\s*\"?([^\"#\\r\\n]*)\"?\\s*$"
    head = lambda e: F.substring_index(e, "\n", 1)
    key = lambda e: F.regexp_extract(e, "^(\\w+):", 1)
    unquoted = lambda x: F.regexp_replace(trimmed(x), "^[\"']|[\"']$", "")

    def listed(e: Column) -> Column:
        below = F.filter(F.split(e, "\n"), lambda x: x.rlike("^\\s*-\\s+"))
        items = F.filter(F.transform(F.split(F.regexp_extract(head(e), inline, 1), ","), unquoted), lambda v: v != "")
        own = F.when(head(e).rlike(inline), items).otherwise(F.transform(below, lambda x: trimmed(F.regexp_extract(x, "^\\s*-\\s+\"?([^\"]*)\"?\\s*$", 1))))
        return F.struct(key(e).alias("k"), own.alias("v"))

    def last(pairs: Column) -> Column:
        """Pairs as a map; of equal keys the last one."""
        placed = F.array_sort(F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v"))))
        kept = let(placed, lambda all_: F.filter(all_, lambda x, i: ~x["k"].eqNullSafe(F.try_element_at(all_, (i + 2).cast("int"))["k"])))
        return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))

    def parsed(all_: Column) -> Column:
        lists = F.transform(F.filter(all_, lambda e: head(e).rlike(inline) | head(e).rlike("^\\w+:\\s*$")), listed)
        scalars = F.transform(F.filter(all_, lambda e: head(e).rlike(scalar) & ~head(e).rlike(inline)), lambda e: F.struct(key(e).alias("k"), trimmed(F.regexp_extract(head(e), scalar, 1)).alias("v")))
        return F.struct(last(scalars).alias("scalars"), last(F.filter(lists, lambda x: F.size(x["v"]) > 0)).alias("lists"))

    return let(entries, parsed)


def sections(body: Column) -> Column:
    """Structs of heading, level (1 to 3; 0 before the first) and content; parts without both are left out. Lines are cut once."""
    pattern = "^(#{1,3})\\s+(.+)$"

    def cut(lines: Column) -> Column:
        at = lambda i: F.element_at(lines, i.cast("int"))
        heads = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: at(i).rlike(pattern))

        def part(s: Column) -> Column:
            own = F.slice(lines, s["s"] + 1, s["e"] - s["s"] - 1)
            head = F.when(s["s"] > 0, at(F.greatest(s["s"], F.lit(1)))).otherwise("")
            text = F.when(s["e"] - s["s"] > 1, F.concat(F.array_join(own, "\n"), F.lit("\n"))).otherwise("")
            return F.struct(trimmed(F.regexp_extract(head, pattern, 2)).alias("heading"), F.length(F.regexp_extract(head, pattern, 1)).alias("level"), text.alias("content"))

        parts = F.transform(F.arrays_zip(F.concat(F.array(F.lit(0)), heads).alias("s"), F.concat(heads, F.array(F.size(lines) + 1)).alias("e")), part)
        return F.filter(parts, lambda p: (trimmed(p["content"]) != "") | (p["heading"] != ""))

    return let(F.split(body, "\\r?\\n"), cut)


def pages_of_names(names: DataFrame, paths: DataFrame) -> DataFrame:
    """id and path of the page that each name (id, name) means: that of its stem or slug, else one that holds it or that it holds.

    paths: path and ord, the listing order, which decides among several.
    """
    stem = F.lower(F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "\\.md$", ""))
    known = paths.where(F.contains("path", F.lit("wiki/")) & ~F.contains("path", F.lit("wiki/media/")) & F.col("path").endswith(".md")).select("path", "ord", stem.alias("stem"))
    low = names.select("id", F.lower("name").alias("name"))
    forms = low.select("id", F.explode(F.array_distinct(F.array("name", F.regexp_replace("name", "\\s+", "-")))).alias("stem"))
    exact = forms.join(known, "stem").groupBy("id").agg(F.min(F.struct("ord", "path")).alias("p"))
    rest = low.join(exact.select("id"), "id", "left_anti").select("id", F.col("name").alias("na"))
    part = contained(rest, known.select(F.col("path").alias("known_id"), F.col("stem").alias("nb"), "ord")).groupBy("id").agg(F.min(F.struct("ord", F.col("known_id").alias("path"))).alias("p"))
    return exact.unionByName(part).select("id", "p.path")


def linked_citations(answer: Column) -> Column:
    """Structs of title and path of the pages that an answer links to, each once, for answers without numbers."""
    links = F.regexp_extract_all(answer, F.lit("(\\[\\[[^\\]|]+?(?:\\|[^\\]]+?)?\\]\\])"), 1)
    both = F.transform(links, lambda x: F.struct(trimmed(F.regexp_extract(x, "\\[\\[([^\\]|]+)", 1)).alias("id"), trimmed(F.regexp_extract(x, "\\|([^\\]]+)\\]\\]$", 1)).alias("shown")))
    ids = F.transform(both, lambda b: b["id"])
    first = F.filter(both, lambda b, i: F.array_position(ids, b["id"]) == i + 1)
    path = lambda i: F.when(F.contains(i, F.lit("/")), F.concat(F.lit("wiki/"), i, F.lit(".md"))).otherwise(F.concat(F.lit(f"wiki/{CITED_FOLDERS[0]}/"), i, F.lit(".md")))
    return F.transform(first, lambda b: F.struct(F.when(b["shown"] != "", b["shown"]).otherwise(b["id"]).alias("title"), path(b["id"]).alias("path")))


def cited_images(cited: DataFrame, pages: DataFrame) -> DataFrame:
    """cited (path) with count and first_url of the images on its page, looked for in the known folders; 0 if there is no page."""
    id_ = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "\\.md$", "")
    places = F.concat(F.array("path"), F.array(*(F.concat(F.lit(f"wiki/{f}/"), id_, F.lit(".md")) for f in CITED_FOLDERS)), F.array(F.concat(F.lit("wiki/"), id_, F.lit(".md"))))
    tried = cited.select("path").distinct().select("path", F.posexplode(places).alias("nth", "at"))
    urls = F.regexp_extract_all(F.col("content"), F.lit("!\\[[^\\]]*\\]\\(([^)\\s]+)\\)"), 1)
    found = tried.join(pages.select(F.col("path").alias("at"), urls.alias("urls")), "at").groupBy("path").agg(F.min_by("urls", "nth").alias("urls"))
    return cited.join(found, "path", "left").select(*cited.columns, F.coalesce(F.size("urls"), F.lit(0)).alias("count"), F.try_element_at("urls", F.lit(1)).alias("first_url"))


def folder_counts(files: DataFrame) -> DataFrame:
    """folder and n_files below it, at any depth, from path; folders without files don't show."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"))


def imported(files: DataFrame) -> DataFrame:
    """Files whose extension may be taken in."""
    return files.where(F.lower(F.regexp_extract("path", "([^.]*)$", 1)).isin(*IMPORTED))


def ingest_statistics(written: DataFrame, warnings: DataFrame, reviews: DataFrame) -> DataFrame:
    """By source: files written, new entities, those merged into others, review items, and a line that says so.

    written: source, path. warnings: source, warning. reviews: source.
    """
    new = F.count_if(F.col("path").startswith("wiki/entities/") | F.col("path").startswith("wiki/concepts/"))
    one = written.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), new.alias("n_entities"))
    merged = warnings.where(F.contains("warning", F.lit("merged into canonical"))).groupBy("source").agg(F.count(F.lit(1)).alias("n_merged"))
    asked = reviews.groupBy("source").agg(F.count(F.lit(1)).alias("n_reviews"))
    every = one.join(merged, "source", "full_outer").join(asked, "source", "full_outer").na.fill(0, ["n_files", "n_entities", "n_merged", "n_reviews"])
    some = lambda n, text: F.when(F.col(n) > 0, F.concat(*text)).otherwise("")
    line = F.concat(F.col("n_files").cast("string"), F.lit(" files written"), some("n_reviews", (F.lit(", "), F.col("n_reviews").cast("string"), F.lit(" review item(s)"))), some("n_merged", (F.lit(" · "), F.col("n_merged").cast("string"), F.lit(" entities merged"))))
    return every.withColumn("detail", F.when(F.col("n_files") > 0, line).otherwise("No files generated"))


# How page types are called and in which order they are shown.
GROUPS = (("overview", "Overview"), ("entity", "Entities"), ("concept", "Concepts"), ("source", "Sources"), ("synthesis", "Synthesis"), ("comparison", "Comparisons"), ("query", "Queries"))
OTHERS = ("Other", 99)


def page_groups(pages: DataFrame) -> DataFrame:
    """type, label, place and number of pages (path, type), in the order in which groups are shown; index and log aren't. Unknown types come last, as they were listed first (ord)."""
    shown = pages.where(~F.regexp_extract("path", "([^/]*)$", 1).isin("index.md", "log.md"))
    label = F.create_map(*(F.lit(x) for g in GROUPS for x in g))
    place = F.create_map(*(F.lit(x) for k, (t, _) in enumerate(GROUPS) for x in (t, k)))
    known = lambda m, other: F.coalesce(F.try_element_at(m, F.col("type")), F.lit(other))
    own = shown.groupBy("type").agg(F.count(F.lit(1)).alias("n_pages"), F.min("ord").alias("first"))
    return own.select("type", known(label, OTHERS[0]).alias("label"), known(place, OTHERS[1]).alias("place"), "n_pages", "first").orderBy("place", "first").drop("first")


def recent_conversations(messages: DataFrame, limit: int = 50) -> DataFrame:
    """conv_id and updated of the conversations with the newest messages (conv_id, at)."""
    return messages.groupBy("conv_id").agg(F.max("at").alias("updated")).orderBy(F.desc("updated"), "conv_id").limit(limit)
