"""Front matter of markdown pages as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import stem, trimmed

_BLOCK = "^---\\r?\\n([\\s\\S]*?)\\r?\\n---"


def block(content: Column) -> Column:
    """What stands between the first --- lines; '' without them."""
    return F.regexp_extract(content, _BLOCK, 1)


def field(block: Column, name: str) -> Column:
    """A scalar, without quotes; '' if missing."""
    return trimmed(F.regexp_extract(block, f"(?m)^{name}:[ \\t]*[\"']?([^\\n]+?)[\"']?[ \\t\\r]*$", 1))


def heading(content: Column) -> Column:
    return trimmed(F.regexp_extract(content, "(?m)^#[ \\t]+([^\\n]+)$", 1))


def unbounded_field(content: Column, name: str) -> Column:
    """As the listing reads it: any such line of a page that opens with ---."""
    return trimmed(F.regexp_extract(content, f"(?m)\\A---\\n[\\s\\S]*?^{name}:[ \\t]*[\"']?([^\\n]+?)[\"']?[ \\t]*$", 1))


def title(content: Column, path: Column) -> Column:
    """Front matter, else the first heading, else the file's stem with spaces."""
    return F.coalesce(F.nullif(unbounded_field(content, "title"), F.lit("")), F.nullif(heading(content), F.lit("")), F.replace(stem(path), F.lit("-"), F.lit(" ")))


def page_type(content: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(field(block(content), "type")), F.lit("")), F.lit("other"))


def _items(block: Column, name: str) -> Column:
    many = F.regexp_extract(block, f"(?m)^{name}:[ \\t]*\\r?\\n((?:[ \\t]+-[ \\t]+[^\\n]+\\n?)*)", 1)
    lines = F.regexp_extract_all(many, F.lit("(?m)^[ \\t]+-[ \\t]+[\"']?([^\\n]+?)[\"']?[ \\t\\r]*$"), 1)
    inline = F.regexp_extract(block, f"(?m)^{name}:[ \\t]*\\[([^\\]]*)\\]", 1)
    parts = F.transform(F.split(inline, ","), lambda x: F.regexp_replace(trimmed(x), "^[\"']|[\"']$", ""))
    return F.when(many != "", lines).otherwise(F.filter(parts, lambda x: x != ""))


def items(content: Column, name: str) -> Column:
    """A list, as lines or inline; empty if missing."""
    return _items(block(content), name)


def sources(content: Column) -> Column:
    """The sources; a page without front matter is searched as a whole."""
    b = block(content)
    return _items(F.when(b != "", b).otherwise(content), "sources")


def with_sources(content: Column, values: Column) -> Column:
    """The page with that list of sources; unchanged without front matter."""
    line = F.concat(F.lit("sources: ["), F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", "), F.lit("]"))
    safe = F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    old = block(content)
    listed = old.rlike("(?m)^sources:")
    new = F.when(listed, F.regexp_replace(old, F.lit("(?m)^sources:(?:[ \\t]*\\[[^\\]]*\\][^\\n]*|[ \\t]*(?:\\n[ \\t]+-[^\\n]*)*|[^\\n]*)"), safe)).otherwise(F.concat(old, F.lit("\n"), line))
    rest = F.substr(content, F.length(old) + 5)
    return F.when(old == "", content).otherwise(F.concat(F.lit("---\n"), new, rest))


def merged(old: Column, new: Column) -> Column:
    """Both lists; of values equal but for case the first."""
    both = F.concat(old, new)
    low = F.transform(both, lambda v: F.lower(v))
    return F.filter(both, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def body(content: Column) -> Column:
    """Without front matter."""
    return F.regexp_replace(content, "^---\\r?\\n[\\s\\S]*?\\r?\\n---[ \\t]*\\r?\\n?", "")
