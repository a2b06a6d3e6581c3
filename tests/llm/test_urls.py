import math
import random
import re
from collections import defaultdict
from itertools import combinations

from tailcast.llm import queries, urls
from tailcast.llm.queries import URL_RULES

URLS = [
    "https://a.example.org/es/7", "http://EXAMPLE.org/en/1", "http://example.org/en/2?x=1#y", "http://notexample.org/es/", "http://m.site.com/fr/8", "http://site.com/de/", "http://site.com/de", "http://com/de/9",
    "http://org", "org/", None, "", "http://x.net/a://b/c", "ftp://U:p@h.com:80/fr/?q", "http://h.com?x=/de/", "://h.com/de/", "http://a\nb.org/x", "http://site.com/FR/8",
]


def brute(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, None
    rest = url[at + 3 :]
    end = min([i for i in map(rest.find, "/?#") if i >= 0] or [len(rest)])
    host, tail = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:end]), rest[end:]
    path = re.split("[?#]", tail)[0]
    fits = [(len(r), r, v) for v, r in URL_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def none(spark):
    return spark.createDataFrame([], "token string, items array<string>")


def test_fixed_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judged(df, none(spark), URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow"), u


def lowest(bad, n):
    z, p = urls.SURE, bad / n
    return (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def brute_rules(held, confidence=0.75, least=5, lift=1.5, longest=3):
    """Rules of (tokens, blocked) by counting all combinations; tokens of the same URLs are one item."""
    cover = defaultdict(set)
    for i, (t, _) in enumerate(held):
        for x in t:
            cover[x].add(i)
    classes = defaultdict(set)
    for x, c in cover.items():
        classes[frozenset(c)].add(x)
    rate = sum(b for _, b in held) / len(held)
    good = {}
    for k in range(1, longest + 1):
        for parts in combinations(classes, k):
            urls_ = frozenset.intersection(*parts)
            bad = sum(held[i][1] for i in urls_)
            if bad >= least and lowest(bad, len(urls_)) >= max(confidence, lift * rate):
                good[frozenset(parts)] = lowest(bad, len(urls_)), bad, len(urls_)
    return {frozenset().union(*(classes[c] for c in parts)): v for parts, v in good.items() if not any(o < parts and w[0] >= v[0] for o, w in good.items())}


def test_mining_and_matching_against_brute_force(spark):
    rng = random.Random(0)
    seen = {}
    for k in range(700):
        sub, word, top, path, sect = rng.choice(["www.", "shop.", "m.", ""]), rng.choice("abcdef"), rng.choice(["net", "org", "com"]), rng.choice(["win", "news", "de", "en"]), rng.choice(["", "/x", "/y"])
        bad = 0.95 if sub == "shop." and path == "win" else 0.97 if top == "com" and path == "de" else 0.1
        seen[f"http://{sub}{word}.{top}/{path}{sect}/{k}{rng.choice(['', '?page=2', '#top'])}"] = rng.random() < bad
    df = spark.createDataFrame(list(seen.items()), "url string, blocked boolean")
    held = [(frozenset(r["t"]), r["blocked"]) for r in df.select(urls.tokens(df["url"]).alias("t"), "blocked").collect()]
    want = brute_rules(held)
    mined = urls.mine(df)
    got = {frozenset(r["items"]): (r["confidence"], r["blocked"], r["urls"]) for r in mined.collect()}
    assert got.keys() == want.keys() and len(got) >= 2
    assert all(math.isclose(got[k][0], want[k][0]) and got[k][1:] == want[k][1:] for k in got)
    judged = urls.judged(df.selectExpr("row_number() over (order by url) as page_id", "url"), mined, [])
    hits = sorted((r["host"], r["path"], r["mined_rules"], r["verdict"]) for r in judged.collect())
    tokens_of = df.select("url", urls.host_of(df["url"]).alias("h"), urls.path_of(df["url"]).alias("p"), urls.tokens(df["url"]).alias("t")).collect()
    counts = [(r["h"], r["p"], sum(k <= set(r["t"]) for k in want)) for r in tokens_of]
    assert hits == sorted((h, p, n, "block" if n else "allow") for h, p, n in counts)
    assert 20 < sum(n > 0 for _, _, n in counts) < 400


def test_long_and_repeated_urls(spark):
    """Equal URLs count once, tokens of the same URLs are one item, and a URL's combinations are bounded."""
    long = "http://a.b.net/" + "/".join(f"p{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    rows = [(long, True)] * 25 + [(f"{long}/{k}", True) for k in range(25)] + [(f"http://s{k}.org/{k}", False) for k in range(80)]
    parts = [f"q{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    rows += [("http://c.com/" + "/".join(p for p in parts if rng.random() < 0.9) + f"/{k}", True) for rng in [random.Random(1)] for k in range(25)]
    mined = urls.mine(spark.createDataFrame(rows, "url string, blocked boolean")).collect()
    assert any("path=paa" in r["items"] and r["urls"] == 26 for r in mined)
    assert not urls.mine(spark.createDataFrame(rows[:25] + rows[50:130], "url string, blocked boolean")).count()


def test_mines_combinations(spark):
    """Neither the host part nor the section is blocked alone; both together are."""
    rows = []
    for k in range(60):
        rows += [(f"http://s{k}.net/news/{k}", False), (f"http://shop.s{k}.net/about/{k}", False), (f"http://s{k}.net/win/{k}", False), (f"http://shop.s{k}.net/win/{k}", True)]
    mined = urls.mine(spark.createDataFrame(rows + [(None, True), ("http://x.net", None)], "url string, blocked boolean"))
    rules = [tuple(r["items"]) for r in mined.collect()]
    assert ("host=shop", "path=win") in rules
    assert all({"host=shop", "path=win"} <= set(r) for r in rules)
    pages = spark.createDataFrame([(1, "https://shop.new.org/win/77"), (2, "https://new.org/win/77"), (3, "https://shop.new.org/a"), (3, "https://shop.new.org/a"), (None, None)], "page_id long, url string")
    got = sorted((str(r["page_id"]), r["verdict"]) for r in urls.judged(pages, mined, []).collect())
    assert got == [("1", "block"), ("2", "allow"), ("3", "allow"), ("3", "allow"), ("None", "allow")]
    held = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", urls.tokens(pages["url"]).alias("t")).collect()}
    assert any(set(i) <= held[1] for i in rules)


def test_no_labels(spark):
    df = spark.createDataFrame([("http://a.b/c", False)], "url string, blocked boolean")
    assert urls.mine(df).count() == 0 and urls.mine(df.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert urls.judged(pages.limit(0), none(spark), URL_RULES).count() == 0


def test_support_is_a_count(spark):
    """Ten blocked URLs of a host suffice among 6,000 labelled ones as among few; three don't."""
    rows = [(f"http://bad.net/{k}", True) for k in range(10)] + [(f"http://s{k}.org/{k}", False) for k in range(5980)] + [(f"http://rare.net/{k}", True) for k in range(3)]
    mined = [r["items"] for r in urls.mine(spark.createDataFrame(rows, "url string, blocked boolean")).collect()]
    assert ["host=bad"] in mined and not any("host=rare" in m for m in mined)


def test_labels_of_pages(spark):
    """A fixed rule decides before a document's label."""
    pages = spark.createDataFrame([(1, "http://a.com/de/5"), (2, "http://a.org/en/6"), (3, "http://a.net/en/7.html"), (4, "http://a.net/en/8"), (5, None)], "page_id long, url string")
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (7, 1, 1), (9, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in queries.labelled_urls(pages, labels).collect()} == {("http://a.com/de/5", True), ("http://a.org/en/6", False), ("http://a.net/en/7.html", True)}


def test_long_urls_are_mined_whole(spark):
    """A rule of the tokens of the smallest share, beyond the most that a basket holds, is found too."""
    rng = random.Random(4)
    seen = {}
    for k in range(260):
        words = [w for w in "abcdefgh" if rng.random() < 0.6]
        seen[f"http://x.net/{'/'.join(words)}/{k}"] = rng.random() < (0.97 if {"b", "g", "h"} <= set(words) else 0.25)
    df = spark.createDataFrame(list(seen.items()), "url string, blocked boolean")
    held = [(frozenset(r["t"]), r["blocked"]) for r in df.select(urls.tokens(df["url"]).alias("t"), "blocked").collect()]
    want = brute_rules(held)
    assert any(len(r) >= 3 for r in want)
    for widest in (3, 5, 12):
        got = {frozenset(r["items"]): (r["blocked"], r["urls"]) for r in urls.mine(df, widest=widest).collect()}
        assert got == {r: v[1:] for r, v in want.items()}, widest
