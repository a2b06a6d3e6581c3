import random
import re
import string
from collections import Counter

from tailcast.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        within = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in within.items() if n >= least]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            over = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(over, 1)]
    return sorted(out)


def cases():
    rng, rows = random.Random(5), []
    for lang, sources in (("en", ["a", "b", "c", "d", None]), (None, ["a", "é"]), ("xx", ["lone"]), ("de", ["a", "b"])):
        vocabulary = [f"{x}{y}" for x in ("Ze", "ka", "ö", "mu", "日") for y in "abcdefgh"]
        for k, source in enumerate(sources):
            for _ in range(rng.randint(5, 30) if lang != "de" else 2):
                rows.append((" ".join(rng.choices(vocabulary[k * 3 :], k=rng.randint(0, 60))) + rng.choice([".", " 12 x1y", ""]), lang, source))
    rows += [(None, "en", "empty"), ("...", "en", "marks"), ("Zea zea", "new", "n1"), (None, None, None), (rows[0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "t") for r in rows], "text string, lang string, source string, n int, term string")


def test_against_brute_force(spark):
    rows = cases()
    for least, top in ((3, 6), (1, 50), (12, 50)):
        got = sorted(tuple(r) for r in divergence.audited(frame(spark, rows), least=least, top=top).collect())
        assert got == brute(rows, least, top)


def test_types_and_empty_tables(spark):
    out = divergence.audited(frame(spark, cases()))
    assert dict(out.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert divergence.audited(frame(spark, cases()).limit(0)).count() == 0


def test_groups_without_kept_terms(spark):
    rows = [("alpha", "en", "a"), (None, "en", "b"), ("", "en", None)]
    got = sorted(tuple(r) for r in divergence.audited(frame(spark, rows)).collect())
    assert got == brute(rows, 30, 50) and {r[4] for r in got} == {0} and len(got) == 6


def test_shares_are_exact_for_large_counts(spark):
    big = 9 * 10**17
    df = spark.createDataFrame([(big, 4 * big, 10**6), (0, 10**18, 3)], "c long, t long, v long")
    got = [r[0] for r in df.select(divergence.share("c", "t", "v")).collect()]
    assert got == [1 + 10**9 * (big + 5) // (4 * big + 5 * 10**6), 1 + 10**9 * 5 // (10**18 + 15)]


def test_a_very_long_text(spark):
    text = "many words make one long text " * 50_000
    rows = [(text, "en", "a"), ("many other words", "en", "b"), ("one", "en", "b")]
    got = sorted(tuple(r) for r in divergence.audited(frame(spark, rows), least=1).collect())
    assert got == brute(rows, 1, 50)
