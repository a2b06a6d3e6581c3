import random
import re
import time

import numpy as np

from tailcast.llm import language

SYLLABLES = {"aa": ["the", "ing", "and", "wh"], "bb": ["sch", "ung", "ein", "ö"], "cc": ["que", "eau", "oi", "é"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=2)) for _ in range(n))


def page(rng, i, lang, said=None, host=None, n=40):
    return (i, f"http://{host or lang + '.example.' + lang}/{lang}/{i}", f'<!DOCTYPE html><html lang="{said or lang}"><head><script>the and the</script><style>que</style></head><body><!-- ung --><p>{text(rng, lang, n)}</p></body></html>')


def model(spark):
    rng = random.Random(0)
    docs = [(i, text(rng, lang), lang) for i in range(60) for lang in SYLLABLES] + [(999, None, "aa"), (998, "x", None)]
    return language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))


def test_visible_and_declared():
    html = b"<HTML class=x LANG='de-AT'><style>a{}</style><script>let a=1</script ><!-- x --><b>Text</b> here"
    assert language.visible(html).split() == [b"Text", b"here"]
    assert language.declared(html) == "de" and language.declared(b"<p lang=fr>") == "" and language.declared(b"") == ""
    assert not language._pairs(b"").any() and not language._pairs(b"  .,9").any()


def test_markup_of_any_length_and_shape():
    """As the patterns that define both, and in time that grows with the size only."""
    markup = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    said = re.compile(rb"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})")
    rng = random.Random(0)
    parts = [b"<", b">", b"<script ", b"</script", b"</script >", b"<style>", b"</style>", b"<!--", b"-->", b"text", b"<html ", b"<HTML", b" lang = 'DE", b" lang=fr", b"<b>", b" ", b"</", b"<scripts>"]
    for _ in range(3000):
        html = b"".join(rng.choices(parts, k=rng.randrange(14)))
        assert language.visible(html) == markup.sub(b" ", html), html
        found = said.search(html)
        assert language.declared(html) == (found[1].decode().lower() if found else ""), html
    began = time.time()
    for x in (b"<script ", b"<html ", b"<!--", b"</script ", b"<script>x</script ", b"<", b"lang ", b"<html lang " + b" " * 50):
        language.visible(x * 100_000), language.declared(x * 100_000)
    assert time.time() - began < 20


def test_posterior_against_brute_force(spark):
    """Every page's probabilities, with priors counted over all other pages one by one."""
    rng = random.Random(3)
    m = model(spark)
    langs, table = m
    rows = [page(rng, i, lang, said=rng.choice([lang, lang, "aa"]), host=rng.choice(["x.y.aa", "y.cc", lang + ".bb"]), n=rng.choice([0, 1, 3])) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=90))]
    got = {r["page_id"]: r for r in language.identified(spark.createDataFrame(rows, "page_id long, url string, html string"), m).collect()}
    p, keys = {}, {}
    for i, url, html in rows:
        log = table @ language._pairs(language.visible(html.encode())) / language.PAIRS_A_WITNESS
        p[i] = np.exp(np.maximum(log - log.max(), -30))
        p[i] /= p[i].sum()
        host, path = url.split("/")[2:4]
        keys[i] = (host,), (host, path), ("said", language.declared(html.encode())), ("suffix", host.split(".")[-1])
    corpus = (sum(p.values()) + 1) / (len(rows) + len(langs))
    share = lambda x: x / x.sum()

    def others(i, k, prior):
        return share(sum((p[j] for j in p if j != i and keys[j][k] == keys[i][k]), np.zeros(3)) + language.PRIOR * prior)

    for i, *_ in rows:
        prior = others(i, 1, others(i, 0, corpus))
        whole = share(p[i] * prior * others(i, 2, corpus) / corpus * others(i, 3, corpus) / corpus)
        assert abs(got[i]["probability"] - whole.max()) < 1e-6
        assert whole[langs.index(got[i]["lang"])] > whole.max() - 1e-6


def test_held_out_pages(spark):
    rng = random.Random(1)
    m = model(spark)
    assert m[0] == ["aa", "bb", "cc"]
    np.testing.assert_allclose(np.exp(m[1]).sum(1), 1)
    rows = [page(rng, i, lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [page(rng, 500 + i, "aa", said="bb") for i in range(10)]  # wrongly declared
    rows += [page(rng, 600 + i, "bb", n=0) for i in range(5)]  # no text: host, suffix and markup tell
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in language.identified(df, m).collect()}
    want = {i: u.split("/")[3] for i, u, _ in rows}
    assert all(got[i]["lang"] == want[i] for i in want)
    assert all(0 < r["probability"] <= 1 for r in got.values())


def test_sparse_host_leans_on_the_corpus(spark):
    """One short, doubtful page: a host full of one language decides, an unknown host doesn't."""
    rng = random.Random(2)
    m = model(spark)
    rows = [page(rng, i, "cc", host="full.example.org") for i in range(40)] + [page(rng, 100 + i, "aa", host=f"h{i}.example.org") for i in range(40)]
    blank = "<html><body>xx</body></html>"
    rows += [(900, "http://full.example.org/cc/1", blank), (901, "http://new.example.org/q/1", blank)]
    got = {r["page_id"]: r for r in language.identified(spark.createDataFrame(rows, "page_id long, url string, html string"), m).collect()}
    assert got[900]["lang"] == "cc"
    assert got[901]["probability"] < got[900]["probability"]


def test_odd_rows(spark):
    rows = [(1, None, None, 1.0), (1, None, None, 1.0), (None, "http://a.b/c", "", 2.0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, p0 double")
    assert language.identified(df, model(spark)).count() == 3
    assert language.identified(df.limit(0), model(spark)).count() == 0
    empty = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r["lang"] for r in language.identified(df, empty).collect()] == [None] * 3
