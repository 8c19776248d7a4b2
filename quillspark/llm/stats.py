"""Statistics of whole texts, for the quality rules and the quality classifier.

Words are runs of other characters than space and \\x09 to \\x0D. Null texts count as empty.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

_WORD = re.compile("[^\x20\x09-\x0d]+")
# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOLS = list(SYMBOLS.encode())
WINDOW = 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "shout_rate", "pipe_rate", "distinct_rate", "short_rate", "stop_rate", "line_words", "non_ascii_rate")


def repeated(words: list[str]) -> int:
    """Words in runs of five that the text has twice or more."""
    runs = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(runs)) == len(runs):
        return 0
    times, end, n = Counter(runs), 0, 0
    for i, r in enumerate(runs):
        if times[r] > 1:
            n += i + WINDOW - max(i, end)
            end = i + WINDOW
    return n


def of(text: str | None) -> tuple:
    """BASE, then RATES."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    raw = text.encode("utf-8", "surrogatepass")
    byte = np.bincount(np.frombuffer(raw, "uint8"), minlength=256)
    symbols = int(byte[_SYMBOLS].sum())
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line in seen:
            lines += 1
            dup += 1
        elif _WORD.search(line):
            lines += 1
            seen.add(line)
    again = repeated(words)
    w, c = max(1, n), max(1, chars)
    return (
        n,
        chars,
        symbols,
        dup,
        again,
        chars / w,
        symbols / w,
        dup / max(1, lines),
        again / w,
        float(byte[65:91].sum()) / c,
        float(byte[48:58].sum()) / c,
        float(byte[33]) / w,
        float(byte[124]) / w,
        len(set(words)) / w,
        sum(len(x) < 4 for x in words) / w,
        float(byte[46]) / w,
        n / max(1, lines),
        float(byte[128:].sum()) / max(1, len(raw)),
    )
