"""Scalar text functions as native column expressions.

Patterns that several engines read differently live here: white space as the reference means
it, ASCII word bounds, punctuation of queries. Offsets and lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, punctuation between query words, and words that queries ignore.
WHITE = "\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
PUNCTUATION = WHITE + ",，。！？、；：\"“”'‘’（）()\\-_/\\\\·~～…"
STOP_WORDS = (
    "的", "是", "了", "什么", "在", "有", "和", "与", "对", "从",
    "the", "is", "a", "an", "what", "how", "are", "was", "were",
    "do", "does", "did", "be", "been", "being", "have", "has", "had",
    "it", "its", "in", "on", "at", "to", "for", "of", "with", "by",
    "this", "that", "these", "those",
)
CJK = "\\u4e00-\\u9fff\\u3400-\\u4dbf"
# Suffixes of Chinese organisations, of which names lose one.
ORG_SUFFIX = "(有限公司|股份公司|集团|控股|公司|集团|保险|金融|银行|科技)$"
# Prefixes of review titles.
REVIEW_PREFIX = "(?i)^(missing[\\s-]?page[:：]\\s*|duplicate[\\s-]?page[:：]\\s*|possible[\\s-]?duplicate[:：]\\s*|缺失页面[:：]\\s*|缺少页面[:：]\\s*|重复页面[:：]\\s*|疑似重复[:：]\\s*)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row, also where use has it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def word_bounded(alternatives: str) -> str:
    """A pattern for the words, bounded as \\b does where word characters are ASCII."""
    bound = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return f"{bound}({alternatives}){bound}"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def tokenize(query: Column) -> Column:
    """Distinct tokens in order; words in CJK become bigrams, characters and themselves."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    raw = F.filter(F.split(F.lower(query), f"[{PUNCTUATION}]+"), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))

    def parts(t: Column) -> Column:
        chars = F.split(t, "")
        chars = F.filter(chars, lambda c: c != "")
        pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        cjk = F.concat(pairs, F.filter(chars, lambda c: ~F.array_contains(stop, c)), F.array(t))
        return F.when(t.rlike(f"[{CJK}]") & (F.length(t) > 2), cjk).otherwise(F.array(t))

    return F.array_distinct(F.flatten(F.transform(raw, parts)))


def phrase(query: Column) -> Column:
    """The query in lower case without punctuation at its ends."""
    return F.regexp_replace(F.lower(trimmed(query)), f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")


def tokens_in(text: Column, tokens: Column) -> Column:
    """How many of the tokens the text contains."""
    low = F.lower(text)
    return F.size(F.filter(tokens, lambda t: F.contains(low, t)))


def occurrences(haystack: Column, needle: Column) -> Column:
    """Non-overlapping; 0 for an empty needle."""
    n = F.length(needle)
    return F.when(n > 0, ((F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))) / n).cast("int")).otherwise(0)


def snippet(content: Column, anchor: Column, context: int = 80) -> Column:
    """The text around the anchor's first place, or the beginning; line feeds become spaces."""
    at = F.position(F.lower(anchor), F.lower(content))
    start = F.greatest(at - 1 - context, F.lit(0))
    end = F.least(F.length(content), at - 1 + F.length(anchor) + context)
    around = F.concat(
        F.when(start > 0, "...").otherwise(""),
        F.replace(F.substr(content, start + 1, end - start), F.lit("\n"), F.lit(" ")),
        F.when(end < F.length(content), "...").otherwise(""),
    )
    return F.when(at > 0, around).otherwise(F.replace(F.substring(content, 1, 2 * context), F.lit("\n"), F.lit(" ")))


def normalize_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), f"[{WHITE}_\\-·•]", ""), ORG_SUFFIX, "")


def normalize_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), f"[{WHITE}\\-_]+", "")


def normalize_review_title(title: Column) -> Column:
    return F.lower(trimmed(F.regexp_replace(F.regexp_replace(title, REVIEW_PREFIX, ""), f"[{WHITE}]+", " ")))


def slug(name: Column) -> Column:
    """Lower case, runs of white space as one hyphen."""
    return F.regexp_replace(F.lower(name), f"[{WHITE}]+", "-")


def ascii_slug(topic: Column, most: int = 50) -> Column:
    """Letters, digits and hyphens only; other scripts vanish."""
    kept = F.regexp_replace(F.lower(topic), f"[^a-z0-9{WHITE}\\-]", "")
    return F.substring(F.regexp_replace(trimmed(kept), f"[{WHITE}]+", "-"), 1, most)


def stem(path: Column) -> Column:
    """The file name without its last extension, unless the dot comes first."""
    return F.regexp_replace(file_name(path), "(?<=.)\\.[^.]*$", "")


def file_name(path: Column) -> Column:
    return F.substring_index(normalize_path(path), "/", -1)


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def join_path(*parts: Column) -> Column:
    """Segments with forward slashes, one between two."""
    return F.regexp_replace(normalize_path(F.concat_ws("/", *parts)), "/+", "/")


def relative_path(path: Column, base: Column) -> Column:
    """path below base, or as it is if it isn't below it."""
    full, root = normalize_path(path), F.concat(F.regexp_replace(normalize_path(base), "/$", ""), F.lit("/"))
    return F.when(F.startswith(full, root), F.substr(full, F.length(root) + 1)).otherwise(full)


def is_absolute_path(path: Column) -> Column:
    """On any system; false for null."""
    return F.coalesce(path.rlike("^(/|[A-Za-z]:[\\\\/]|\\\\\\\\)"), F.lit(False))


def truncated(text: Column, most: int, mark: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def without_thinking(text: Column) -> Column:
    """Without closed or unclosed think blocks."""
    closed = F.regexp_replace(text, "(?is)<think(?:ing)?>.*?</think(?:ing)?>\\s*", "")
    return trimmed(F.regexp_replace(closed, "(?is)<think(?:ing)?>.*$", ""))


def thinking(text: Column) -> Column:
    return trimmed(F.regexp_extract(text, "(?is)<think(?:ing)?>(.*?)(?:</think(?:ing)?>|\\z)", 1))


def image_refs(content: Column) -> Column:
    """Structs of alt and url; of equal urls the first."""
    pattern = F.lit("!\\[([^\\]]*)\\]\\(([^)\\s]+)\\)")
    both = F.arrays_zip(F.regexp_extract_all(content, pattern, 1).alias("alt"), F.regexp_extract_all(content, pattern, 2).alias("url"))
    return F.filter(both, lambda x, i: F.array_position(F.transform(both, lambda y: y["url"]), x["url"]) == i + 1)


def safe_page_id(page_id: Column) -> Column:
    return page_id.rlike("^[A-Za-z0-9_.-]{1,256}$") & ~F.contains(page_id, F.lit(".."))


def safe_wiki_path(path: Column) -> Column:
    """Relative, below wiki/, without steps up."""
    p = normalize_path(path)
    return p.startswith("wiki/") & ~p.rlike("(^|/)\\.\\.(/|$)") & ~p.rlike("^[A-Za-z]:") & ~F.contains(p, F.lit("\u0000"))


def version_parts(version: Column) -> Column:
    """Three numbers; what isn't a number counts as 0."""
    parts = F.split(F.regexp_replace(trimmed(version), "^[vV]", ""), "\\.")
    return F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.coalesce(F.try_element_at(parts, i).try_cast("int"), F.lit(0)))


def is_greeting(text: Column) -> Column:
    """Whether a short text is only a greeting."""
    end = "[\\s!！。.？?~,，、;；:：]+$"
    plain = F.lower(trimmed(F.regexp_replace(trimmed(text), end, "")))
    any_of = F.lit(False)
    for p in GREETINGS:
        any_of = any_of | plain.rlike(p)
    return F.coalesce((F.length(plain) > 0) & (F.length(plain) <= 20) & any_of, F.lit(False))


# What counts as a greeting.
GREETINGS = (
    "^(hi|hello|hey|yo|sup|howdy|hiya|heya|hullo)( there| y'all| you| folks| everyone)?$",
    "^good (morning|afternoon|evening|day|night)$",
    "^(what'?s up|wassup|whaddup)$",
    "^greetings$",
    "^(你好|您好|大家好|嗨|哈喽|哈啰|哈囉|哈罗|喂)[啊呀吖呢么呗哦哈]?$",
    "^(早|早啊|早安|早上好|中午好|下午好|晚上好|晚安)[啊呀吖呢么呗哦哈]?$",
    "^(在吗|在嗎|在不在|有人吗|有人嗎|有人在吗|有人在嗎)$",
    "^(こんにちは|こんばんは|おはよう|おはようございます|やあ|どうも|はじめまして)$",
    "^(안녕|안녕하세요|안녕하십니까)$",
    "^(hola|bonjour|salut|coucou|hallo|servus|hej|hejsan|ciao|saluton|ola|olá|privet|привет)$",
)
