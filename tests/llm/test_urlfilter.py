import itertools
import math

import pytest

from quillspark.llm import urlfilter
from quillspark.llm.common import table


def split_by_hand(run, unigrams):
    """The cheapest of all splits."""
    best = None
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        words, word = [], run[0]
        for c, cut in zip(run[1:], cuts):
            if cut:
                words.append(word)
                word = c
            else:
                word += c
        words.append(word)
        cost = sum(unigrams.cost.get(w, unigrams.unknown(len(w))) for w in words)
        if best is None or cost < best[0] - 1e-12:
            best = (cost, words)
    return best[0]


@pytest.mark.parametrize("run", ["freebets", "cheappills", "xqzt", "newsblog", "a"])
def test_viterbi_finds_the_cheapest_split(run):
    u = urlfilter.Unigrams({w: 20 for w in (*urlfilter.BLOCKED, *urlfilter.ALLOWED)})
    got = u.split(run)
    assert "".join(got) == run
    assert sum(u.cost.get(w, u.unknown(len(w))) for w in got) == pytest.approx(split_by_hand(run, u))


def test_known_words():
    u = urlfilter.Unigrams({w: 20 for w in (*urlfilter.BLOCKED, *urlfilter.ALLOWED)})
    assert u.split("cheappillsonline") == ["cheap", "pills", "online"]


def by_hand(url):
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", "", None, None
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = ["http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "https://xwww.example.com/en/1", "http://com/", "http://com", "http://a.net/es/1", "http://net/fr", "ftp://x.org?a=/en/", "no url", "", None, "a://b://c/d", "http://casino-win.example.org/en/1", "http://freebets.example.org/", "http://news.example.org/en/3", "http://é.com/ü#", "http://x.net/fr/" + "y" * 100_000]


def test_rules_and_method(spark):
    known = [(i + 100, f"http://tion{i % 7}sh.example.org/en/{i}") for i in range(200)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0])] + known, "page_id bigint, url string").selectExpr("*", "'x' AS host", "'y' AS verdict")
    out = urlfilter.judged(pages).collect()
    assert len(out) == len(URLS) + 201
    for r in out:
        host, path, rule, verdict = by_hand(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if verdict:
            assert r.verdict == verdict
    verdict = {r.url: r.verdict for r in out}
    assert verdict["http://casino-win.example.org/en/1"] == verdict["http://freebets.example.org/"] == "block"
    assert verdict["http://news.example.org/en/3"] == verdict[known[0][1]] == verdict["no url"] == verdict[None] == "allow"
    assert urlfilter.judged(pages.where("false")).count() == 0


def test_generated_pages(spark):
    rows = urlfilter.judged(table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url")).where("rule IS NULL").collect()
    spam = ("casino", "pills", "bets", "spam", "adult", "ads-")
    assert all((r.verdict == "block") == any(s in r.host for s in spam) for r in rows)


def test_bayes_by_hand():
    b = urlfilter.Bayes({}, (0, 0))
    assert b.weight["h:casino"] > 0 > b.weight["h:news"]
    assert b.odds([]) == 0.0 and not math.isnan(b.odds(["h:zzz"]))


def test_bayes_is_that_of_plain_counts(spark):
    """Weights of every token of real urls, counted url by url."""
    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url")
    more = [(-k, f"http://{'casino' if k % 3 else 'garden'}-zorblax{k % 7}.example.org/{'free/quuxbet' if k % 3 else 'plants'}") for k in range(1, 60)]
    pages = pages.unionByName(spark.createDataFrame(more, "page_id bigint, url string"))
    urls = urlfilter.split_urls(pages)
    unigrams = urlfilter.unigrams_of(urls)
    bayes, _ = urlfilter.bayes_of(urlfilter.tokens_of(urls, unigrams))
    found = [urlfilter.tokens(r.host, r.path, unigrams) for r in urls.collect()]
    kinds = [any(t[2:] in urlfilter.BLOCKED for t in f) for f in found]  # which all urls of a host here have in common
    n = len(found)
    counts = {}
    for f, kind in zip(found, kinds):
        for t in f:
            counts.setdefault(t, [0.0, 0.0])[kind] += 1
    sums = [sum(c[k] for c in counts.values()) + urlfilter.SMOOTH * (len(counts) + 1) for k in (0, 1)]
    want = {t: math.log((c[1] + urlfilter.SMOOTH) / sums[1] * sums[0] / (c[0] + urlfilter.SMOOTH)) for t, c in counts.items()}
    for words, odds in ((urlfilter.BLOCKED, urlfilter.SEED_ODDS), (urlfilter.ALLOWED, -urlfilter.SEED_ODDS)):
        for w in words:
            for t in (f"h:{w}", f"p:{w}"):
                want[t] = want.get(t, 0.0) + odds
    assert bayes.weight == pytest.approx(want)
    assert bayes.prior == pytest.approx(math.log((sum(kinds) + 1) / (n - sum(kinds) + 1)))
    # words that only stand beside blocked ones are learned
    assert bayes.weight["p:free"] > 0 and max(bayes.weight[t] for t in bayes.weight if "quux" in t) > 0


JOINED = ["http://freecasino.example.org/en/1", "http://cheappills.example.org/de/2.html", "https://www.onlinecasino.example.org/fr/3", "http://pokerbonus.example.org/en/4"]


def test_joined_names_in_the_table_are_split(spark):
    pages = table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url")
    own = spark.createDataFrame([(-k - 100 * i, u) for i, u in enumerate(JOINED) for k in (range(1, 60) if i == 0 else (1,))] + [(-1000, "http://sussex.example.org/en/1")], "page_id bigint, url string")
    pages = pages.unionByName(own)
    unigrams = urlfilter.unigrams_of(urlfilter.split_urls(pages))
    assert [unigrams.split(w) for w in ("freecasino", "cheappills", "onlinecasino", "sussex")] == [["free", "casino"], ["cheap", "pills"], ["online", "casino"], ["sussex"]]
    got = {r.page_id: r.verdict for r in urlfilter.judged(pages).where("page_id < 0").collect()}
    assert got.pop(-1000) == "allow" and set(got.values()) == {"block"}


def test_rare_tokens_count(spark, monkeypatch):
    rows = [(i, f"http://{'abcdefghij'[i % 10]}qx{'klmnopqrst'[i // 10 % 10]}.example.org/en/{'casino' if i % 10 < 4 else 'zzyx'}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    urls = urlfilter.split_urls(pages)
    unigrams = urlfilter.unigrams_of(urls)
    counts = urlfilter.tokens_of(urls, unigrams)
    whole, none = urlfilter.bayes_of(counts)
    assert none is None
    monkeypatch.setattr(urlfilter, "VOCABULARY", 20)
    few, others = urlfilter.bayes_of(counts)
    rare = {r.token: r.weight for r in others.collect()}
    assert len(rare) >= 100 and not rare.keys() & few.weight.keys()
    assert {**few.weight, **rare} == pytest.approx(whole.weight)
    got = {r.page_id: r.verdict for r in urlfilter.judged(pages).collect()}
    assert got == {i: "block" if whole.odds(urlfilter.tokens(*u.split("://")[1].split("/", 1), unigrams)) > 0 else "allow" for i, u in rows}
    assert set(got.values()) == {"allow", "block"}


def test_words_of_joined_names():
    u = urlfilter.unigrams_of()
    runs = {"nudegirlsvideos": "nude girls videos", "hotsinglegirls": "hot single girls", "earnmoneyfast": "earn money fast", "blackdragonresearch": "black dragon research", "weatherforecast": "weather forecast", "therapist": "therapist"}
    assert {r: " ".join(u.split(r)) for r in runs} == runs


def test_held_out_hosts(spark):
    """Hosts without any seed word, known by what stands in urls of others; and clean hosts with one."""
    rows = []
    seeds = ("casino", "poker", "viagra", "lottery", "porn", "roulette")
    spam, clean = ("lucky", "reels", "spin", "royal", "vegas"), ("garden", "plants", "botany", "roses", "soil")
    for k in range(120):
        name = f"{spam[k % 5]}{seeds[k % 6]}{k % 11}"
        rows += [(f"http://www.{name}.example.org/{spam[(k + 1) % 5]}/{spam[(k + 2) % 5]}-{k}.html", "block")]
        rows += [(f"http://{clean[k % 5]}{clean[(k + 1) % 5]}.example.org/{clean[(k + 2) % 5]}/{clean[(k + 3) % 5]}-{k}.html", "allow")]
        if k % 2:  # no seed word
            rows += [(f"http://{spam[k % 5]}{spam[(k + 1) % 5]}{k}.example.org/{spam[(k + 3) % 5]}/{k}", "block")]
        elif k % 6 == 0:  # a seed word
            rows += [(f"http://{clean[k % 5]}{clean[(k + 1) % 5]}.example.org/{clean[(k + 2) % 5]}/free/{clean[(k + 4) % 5]}/{k}", "allow")]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judged(pages).collect()}
    right = [got[i] == want for i, (_, want) in enumerate(rows)]
    u = urlfilter.unigrams_of()
    seeded = [any(t[2:] in urlfilter.BLOCKED for t in urlfilter.tokens(*by_hand(url)[:2], u)) for url, _ in rows]
    differ = [(got[i] == "block") != s for i, s in enumerate(seeded)]
    assert sum(right) >= 0.95 * len(rows)
    assert sum(d and ok for d, ok in zip(differ, right)) >= 0.2 * len(rows)


def test_columns_with_any_name_stay(spark):
    names = ["odds", "rare", "bag", "more", "key", "filter_key", "tokens", "seeded", "blocked", "n", "odds0"]
    pages = spark.createDataFrame([(1, "http://casino.example.org/x"), (2, None)], "page_id bigint, url string").selectExpr("*", *(f"'{n}' AS {n}" for n in names))
    out = urlfilter.judged(pages)
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    assert all(r[n] == n for r in out.collect() for n in names)
