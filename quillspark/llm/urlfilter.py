"""URL filter: host and path rules first, else naive Bayes on segmented words.

A url's host is split at its dots and signs, and each run of letters into words by the most
likely split under a unigram model (Viterbi). The model's words are a seed list and those of a public
tokenizer's vocabulary, whose order tells how frequent they are; the urls themselves take no part in it, so a
joined name is no word because it stands in a url, and a split doesn't depend on the table. Tokens of host and path
then score by multinomial naive Bayes. Its labels are hosts': a host is an example of the blocked kind
if at least half of its urls have a seed word of that kind, and so are all of its urls, with or without one. What
stands in such urls is learned, and a single seed word on another host is outweighed by the rest. All tokens
count; the weights of frequent ones go to the workers, the others' are joined.

Null urls and those without :// have an empty host and path, and are allowed. Repeated rows
give repeated results. No rows give no rows. Other columns stay as they are, whatever their names,
but for host, path, rule and verdict, which are replaced.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import appended, stashed, tokenizer_path

# Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Words of hosts that are to be blocked, and some that aren't.
BLOCKED = tuple(
    """adult ads adserver advert affiliate bet bets betting bingo bonus cams casino cheap cialis clickbait crack dating doorway
    escort farm fake free gamble gambling hack jackpot keygen loan loans lottery malware payday phish phishing pills poker
    porn pharma pharmacy replica seo sex sexy slots spam spyware torrent track tracker tracking viagra virus warez win
    winner xxx nude nudes naked erotic erotica fetish hentai hookup milf escorts singles webcam webcams camgirls stripper
    roulette blackjack baccarat sportsbook wager prize prizes giveaway earn cash instant millionaire forex viagras levitra
    steroids diet slimming counterfeit cracked serials keylogger rootkit botnet ransomware scam scams spammer popups""".split()
)
ALLOWED = tuple(
    """about academy archive art article articles blog book books city code community data doc docs edu education family food
    forum garden gov guide health help history home house image images info journal law learn library local mail map maps
    media museum music nature news online open page paper people photo photos post project recipe recipes research
    review school science shop site sport sports store story study support tech travel university video water weather
    web wiki world""".split()
)
#: A token is frequent if it is so small a part of all; there can't be more of them.
VOCABULARY = 20_000
#: What the counts of the vocabulary's words add up to in the unigram model, and all counts at least.
WORDS, TOTAL = 20_000, 60_000
#: Added to the counts of seed words in the unigram model.
SEED_COUNT = 20
#: Logarithm of the odds that a seed word gives for its kind.
SEED_ODDS = 3.0
#: Words longer than this aren't tried in a split.
LONGEST = 24
SMOOTH = 0.5
CACHE = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, verdict: bool) -> Column:
    """The longest fitting rule, or what it says."""
    out = None
    for h, p, says in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.lit(says if verdict else h + p)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


class Unigrams:
    """Splits runs of letters into the likeliest words."""

    def __init__(self, counts: dict[str, float], least: float = 1):
        self.total = max(sum(counts.values()), least)
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items() if n > 0}
        self.known: dict[str, list[str]] = {}

    def unknown(self, n: int) -> float:
        """The cost of a word of n letters that isn't in the model."""
        return math.log(self.total) + 1.0 + 2.5 * n

    def split(self, run: str) -> list[str]:
        if run in self.known:
            return self.known[run]
        best = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            options = []
            for begin in range(max(0, end - LONGEST), end):
                word = run[begin:end]
                options.append((best[begin][0] + self.cost.get(word, self.unknown(end - begin)), begin))
            best.append(min(options))
        out, end = [], len(run)
        while end:
            begin = best[end][1]
            out.append(run[begin:end])
            end = begin
        if len(self.known) > CACHE:
            self.known.clear()
        self.known[run] = out[::-1]
        return self.known[run]


_RUNS = re.compile(r"[^\W\d_]+|\d+")


def tokens(host: str, path: str, unigrams: Unigrams) -> list[str]:
    """Words of the host, h:, and of the path, p:, each once, so that no url outweighs others; numbers as 0."""
    out = []
    for mark, part in (("h:", host), ("p:", path)):
        for run in _RUNS.findall(part.lower()):
            out += [mark + "0"] if run[0].isdigit() else [mark + w for w in unigrams.split(run)]
    return list(dict.fromkeys(out))


_SEEDS = frozenset(BLOCKED)
#: A word of a vocabulary: its first character stands for the space before it.
_WORD = re.compile("\u0120[A-Za-z]{3,24}")


class Bayes:
    """Multinomial naive Bayes of two classes over tokens; seed words have SEED_ODDS for or against, besides what their counts tell.

    rest are the number and both counts of the tokens, none a seed word, that aren't in counts.
    """

    def __init__(self, counts: dict[str, tuple[int, int]], urls: tuple[int, int], rest: tuple[int, int, int] = (0, 0, 0)):
        self.sums = sums = [sum(n[k] for n in counts.values()) + rest[1 + k] + SMOOTH * (len(counts) + rest[0] + 1) for k in (0, 1)]
        self.weight = {w: math.log((n[1] + SMOOTH) / sums[1]) - math.log((n[0] + SMOOTH) / sums[0]) for w, n in counts.items()}
        for words, odds in ((BLOCKED, SEED_ODDS), (ALLOWED, -SEED_ODDS)):
            for w in words:
                for mark in ("h:", "p:"):
                    self.weight[mark + w] = self.weight.get(mark + w, 0.0) + odds
        self.other = 0.0  # what neither class has tells nothing
        self.prior = math.log((urls[1] + 1) / (urls[0] + 1)) if sum(urls) > 1 else 0.0

    def odds(self, found: list[str]) -> float:
        return self.prior + sum(self.weight.get(t, self.other) for t in found)


def _distant(found: list[str]) -> bool:
    return any(t[2:] in _SEEDS for t in found)


def split_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[str, float]:
    """Words of a tokenizer's vocabulary, and the share of each by Zipf's law of their places in it."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shares: dict[str, float] = {}
    for token, place in vocabulary.items():
        if _WORD.fullmatch(token):
            shares[token[1:].lower()] = shares.get(token[1:].lower(), 0.0) + 1 / (1 + place)
    every = sum(shares.values())
    return {w: x / every for w, x in shares.items()}


def unigrams_of(urls: DataFrame | None = None, path: str | None = None) -> Unigrams:
    """The model of all words; the same for any urls."""
    counts = {w: WORDS * share for w, share in _ranks(tokenizer_path(path)).items()}
    for w in (*BLOCKED, *ALLOWED):
        counts[w] = counts.get(w, 0.0) + SEED_COUNT
    return Unigrams(counts, TOTAL)


def tokens_of(urls: DataFrame, unigrams: Unigrams) -> DataFrame:
    """token and its numbers of urls, a of other hosts and b of blocked ones; '' counts the urls.

    Urls of one host with the same tokens, as numbers are all the same, are counted together first.
    """

    def make():
        def work(keys):
            found = [tokens(*k.split("\n", 1), unigrams) for k in keys]
            return {"tokens": found, "seeded": [_distant(f) for f in found]}

        return work

    fields = [T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("seeded", T.BooleanType())]
    found = appended(urls.select("host", F.concat_ws("\n", "host", "path").alias("key")), "key", make, fields, without=("key",))
    own = stashed(found.groupBy("host", "tokens", "seeded").agg(F.count(F.lit(1)).alias("n")))
    hosts = own.groupBy("host").agg((2 * F.sum(F.when(F.col("seeded"), F.col("n")).otherwise(0)) >= F.sum("n")).alias("blocked"))
    each = own.join(stashed(hosts), "host").select(F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token"), "blocked", "n")
    of = lambda kind: F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0))
    return stashed(each.groupBy("token").agg(of(~F.col("blocked")).alias("a"), of(F.col("blocked")).alias("b")))


def bayes_of(counts: DataFrame) -> tuple[Bayes, DataFrame | None]:
    """The classifier with the frequent tokens, and token and weight of the others, if any."""
    n = F.col("a") + F.col("b")
    every = counts.where("token <> ''").agg(F.sum(n)).first()[0] or 0
    seeds = [mark + w for mark in ("h:", "p:") for w in (*BLOCKED, *ALLOWED)]
    kept = (n * VOCABULARY >= every) | F.col("token").isin("", *seeds)
    frequent = {r["token"]: (r["a"], r["b"]) for r in counts.where(kept).collect()}
    others = counts.where(~kept)
    rest = others.agg(F.count(F.lit(1)), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    bayes = Bayes(frequent, frequent.pop("", (0, 0)), tuple(rest))
    if not rest[0]:
        return bayes, None
    own = [F.col(c) + F.lit(SMOOTH) for c in ("a", "b")]
    return bayes, others.select("token", (F.log(own[1] / bayes.sums[1]) - F.log(own[0] / bayes.sums[0])).alias("weight"))


def judged(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict."""
    # names that no column of pages has
    key, odds, rare, bag, more = (next(n for k in range(len(pages.columns) + 1) if (n := f"{name}{k}") not in pages.columns) for name in ("key", "odds", "rare", "bag", "more"))
    urls = split_urls(pages, url)
    unigrams = unigrams_of()
    bayes, others = bayes_of(tokens_of(urls, unigrams))

    def make():
        def work(keys):
            found = [[] if k == "\n" else tokens(*k.split("\n", 1), unigrams) for k in keys]
            return {odds: [0.0 if k == "\n" else bayes.odds(f) for k, f in zip(keys, found)], rare: [sorted(t for t in f if t not in bayes.weight) for f in found]}

        return work

    fields = [T.StructField(odds, T.DoubleType()), T.StructField(rare, T.ArrayType(T.StringType()))]
    scored = appended(urls.withColumn(key, F.concat_ws("\n", "host", "path")), key, make, fields, without=(key,))
    if others is not None:
        scored = stashed(scored)
        # rows without rare tokens have keys of their own, which meet nothing
        scored = scored.withColumn(bag, F.when(F.size(rare) > 0, F.array_join(rare, " ")).otherwise(F.monotonically_increasing_id().cast("string")))
        each = scored.where(F.size(rare) > 0).select(bag, rare).distinct().select(bag, F.explode(rare).alias("token"))
        sums = each.join(others, "token").groupBy(bag).agg(F.sum("weight").alias(more))
        scored = scored.join(sums, bag, "left").withColumn(odds, F.col(odds) + F.coalesce(more, F.lit(0.0))).drop(bag, more)
    method = F.when(F.col(odds) > 0, F.lit("block")).otherwise(F.lit("allow"))
    found = scored.withColumn("rule", rule(F.col("host"), F.col("path"), False))
    return found.withColumn("verdict", F.coalesce(rule(F.col("host"), F.col("path"), True), method)).drop(odds, rare)
