"""Language of a text by scripts, then by marks and frequent words, all native."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import word_bounded

# Code point ranges of scripts; an earlier one wins where they overlap.
SCRIPTS = (
    ("Chinese", "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{F900}-\\x{FAFF}"),
    ("Japanese", "\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{31F0}-\\x{31FF}\\x{FF65}-\\x{FF9F}"),
    ("Korean", "\\x{AC00}-\\x{D7AF}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}"),
    ("Arabic", "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}"),
    ("Hebrew", "\\x{0590}-\\x{05FF}\\x{FB1D}-\\x{FB4F}"),
    ("Thai", "\\x{0E00}-\\x{0E7F}"),
    ("Hindi", "\\x{0900}-\\x{097F}"),
    ("Bengali", "\\x{0980}-\\x{09FF}"),
    ("Tamil", "\\x{0B80}-\\x{0BFF}"),
    ("Telugu", "\\x{0C00}-\\x{0C7F}"),
    ("Kannada", "\\x{0C80}-\\x{0CFF}"),
    ("Malayalam", "\\x{0D00}-\\x{0D7F}"),
    ("Gujarati", "\\x{0A80}-\\x{0AFF}"),
    ("Punjabi", "\\x{0A00}-\\x{0A7F}"),
    ("Burmese", "\\x{1000}-\\x{109F}"),
    ("Khmer", "\\x{1780}-\\x{17FF}"),
    ("Lao", "\\x{0E80}-\\x{0EFF}"),
    ("Georgian", "\\x{10A0}-\\x{10FF}\\x{2D00}-\\x{2D2F}"),
    ("Armenian", "\\x{0530}-\\x{058F}"),
    ("Amharic", "\\x{1200}-\\x{137F}"),
    ("Tibetan", "\\x{0F00}-\\x{0FFF}"),
    ("Sinhala", "\\x{0D80}-\\x{0DFF}"),
    ("Russian", "\\x{0400}-\\x{04FF}\\x{0500}-\\x{052F}"),
    ("Greek", "\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}"),
)
# Rules in order: language, marks, words; then what must hold besides. "and" asks for both of the
# first two, "or" for either.
LATIN = (
    ("Vietnamese", "ảạắằẳẵặấầẩẫậđẻẽẹếềểễệỉĩịỏọốồổỗộơớờởỡợủũụưứừửữựỷỹỵ", "", "or", "", ""),
    ("Turkish", "ğış", "bir|ve|için|ile|bu|da|de|değil|ama", "and", "", ""),
    ("Polish", "ąćęłńóśźż", "", "or", "", ""),
    ("Czech", "ěšžřďťňů", "", "or", "", ""),
    ("Romanian", "ăâîșț", "și|este|sau|care|pentru", "and", "", ""),
    ("Hungarian", "őű", "", "or", "", ""),
    ("German", "äöüß", "und|der|die|das|ist|nicht|ein|eine", "or", "und|der|die|das|ist", ""),
    ("French", "àâçéèêëïîôùûüÿœæ", "le|la|les|de|des|est|et|un|une|du|au", "or", "le|la|les|est|une|des", ""),
    ("Portuguese", "ãõç", "o|a|os|as|de|do|da|é|em|um|uma|não|que", "and", "", ""),
    ("Spanish", "áéíóúñ¿¡", "el|la|los|las|de|del|es|en|por|que|un|una", "or", "el|los|las|del|por", "ñ¿¡"),
    ("Italian", "", "il|lo|la|gli|le|di|del|della|è|e|un|una|che|non|per", "or", "il|della|gli|che|è", ""),
    ("Dutch", "", "het|de|een|van|en|in|is|dat|op|te|met", "or", "het|een|van|dat", ""),
    ("Swedish", "åäö", "och|att|det|en|ett|är|för|med", "and", "", ""),
    ("Norwegian", "åæø", "og|er|det|en|et|for|med|på", "and", "", ""),
    ("Danish", "åæø", "og|er|det|en|et|til|med|af", "and", "", ""),
    ("Finnish", "äö", "ja|on|ei|se|että|tai|kun|niin", "and", "", ""),
    ("Indonesian", "", "dan|yang|di|dari|untuk|dengan|ini|itu|adalah|tidak|ada", "or", "yang|dari|untuk|dengan|adalah", ""),
    ("Swahili", "", "na|ya|wa|ni|kwa|katika|hii|hiyo", "or", "", ""),
)


_WORDS = sorted({w for rule in LATIN for w in (*rule[2].split("|"), *rule[4].split("|")) if w})
_PLAIN = [w for w in _WORDS if w.isascii()]
_MARKED = [w for w in _WORDS if not w.isascii()]


def _latin(words: Column, marks: Column) -> Column:
    """By the words of the rules that a text has, and the characters beyond ASCII that it has."""
    has = lambda listed: F.arrays_overlap(words, F.array(*map(F.lit, listed.split("|"))))
    marked = lambda listed: F.arrays_overlap(marks, F.array(*map(F.lit, listed)))
    out = None
    for name, listed, by_word, how, also, also_marks in LATIN:
        tests = [marked(listed)] * bool(listed) + [has(by_word)] * bool(by_word)
        rule = tests[0] if len(tests) == 1 else tests[0] & tests[1] if how == "and" else tests[0] | tests[1]
        besides = [has(also)] * bool(also) + [marked(also_marks)] * bool(also_marks)
        if besides:
            rule = rule & reduce(lambda a, b: a | b, besides)
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise("English")


def _by_script(rest: Column) -> Column:
    """By the counts of characters of each script; null if none has two."""
    left, counts = [], {}
    for name, ranges in SCRIPTS:
        shadowed = "".join(f"&&[^{r}]" for n, r in SCRIPTS if n in left and _overlap(r, ranges))
        counts[name] = f"[{ranges}{shadowed}]"
        left.append(name)
    found = F.array(*(F.struct(F.regexp_count(rest, F.lit(p)).alias("n"), (-F.regexp_instr(rest, F.lit(p))).alias("place"), F.lit(name).alias("name")) for name, p in counts.items()))
    most = F.array_max(found)
    japanese = rest.rlike(counts["Japanese"]) & rest.rlike(counts["Chinese"])
    any_script = rest.rlike("[" + "".join(r for _, r in SCRIPTS) + "]")
    return F.when(any_script, F.when(japanese, F.lit("Japanese")).when(most["n"] >= 2, most["name"]))


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def detect(text: Column) -> Column:
    """The language's English name; English if nothing tells.

    Of scripts with equal counts the one that comes first in the text wins. A text is cut into
    words once, and its characters beyond ASCII are taken out once; the rules look at these only.
    """
    low = F.lower(text)
    plain = F.array_intersect(F.split(low, "[^A-Za-z0-9_]+"), F.array(*map(F.lit, _PLAIN)))
    bounded = [F.when(F.contains(low, F.lit(w)) & low.rlike(word_bounded(w)), F.lit(w)) for w in _MARKED]
    words = F.when(F.octet_length(text) == F.length(text), plain).otherwise(F.concat(plain, F.array_compact(F.array(*bounded))))
    rest = F.regexp_replace(text, "[\\x00-\\x7F]+", "")

    def told(s: Column) -> Column:
        marks = F.split(F.lower(s["rest"]), "")
        return F.coalesce(_by_script(s["rest"]), F.transform(F.array(marks), lambda m: _latin(s["words"], m))[0])

    return F.when(text.isNotNull(), _with(F.struct(words.alias("words"), rest.alias("rest")), told)).otherwise("English")


def _ranges(text: str) -> list[tuple[int, int]]:
    import re

    return [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", text)]


def _overlap(a: str, b: str) -> bool:
    return any(x <= w and v <= y for x, y in _ranges(a) for v, w in _ranges(b))


_CJK = ("Chinese", "Japanese", "Korean")
_FAR = ("Arabic", "Hindi", "Thai", "Hebrew")


def fits(content: Column, target: Column, sample: int = 1500) -> Column:
    """Whether a page is in the language asked for, or at least in none of quite another script."""
    plain = F.regexp_replace(content, "^---\\n[\\s\\S]*?\\n---\\n?", "")
    plain = F.regexp_replace(F.regexp_replace(plain, "```[\\s\\S]*?```", ""), "\\$\\$[\\s\\S]*?\\$\\$|\\$[^$\\n]*\\$", "")
    part = F.substring(F.trim(plain), 1, sample)
    found = detect(part)
    wrong = (found.isin(*_CJK) != target.isin(*_CJK)) | (found.isin(*_FAR) & ~target.isin(*_CJK, *_FAR))
    return (F.length(part) < 20) | ~wrong
