import random
import re

from tailcast.llm import graph, near
from tailcast.llm.buckets import link
from tailcast.llm.common import saved
from tailcast.llm.graph import components


def brute(rows, shingle, percent):
    """{id: (number of shingles, component)} by all pairs."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} - {()}
    name = {i: i for i in sets}

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                name[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def corpus(seed, groups=12, copies=12, words=120):
    """Originals with copies of 0 to 12 % edited words, copies of copies, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for _ in range(groups):
        text = [word() for _ in range(words)]
        for _ in range(copies):
            t = text.copy()
            for _ in range(rng.randrange(12)):
                t[rng.randrange(words)] = word()
            if rng.random() < 0.3:
                text = t
            rows.append(" ".join(t).upper() if rng.random() < 0.2 else "  ".join(t))
    rows += [passage + " " + " ".join(word() for _ in range(40)) for _ in range(25)]
    rows += ["", None, "one", "one", "ONE", "two", " \n ", "one two", "\tone  two\n", "x" * 30000, " ".join(["again"] * 3000)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_all_pairs(spark):
    for shingle in (2, 5):
        rows = corpus(shingle)
        want = brute(rows, shingle, 80)
        got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=shingle).collect()
        assert len(got) == len(rows)
        wrong = [r for r in got if (r["n_shingles"], r["component_id"]) != want[r["doc_id"]]]
        assert not wrong
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_across_components_is_exact(spark):
    """With every text in a component of its own, the prefix join alone finds all links."""
    rows = [(i, t) for i, t in corpus(7, groups=6) if t and t.strip()]
    df = spark.createDataFrame(rows, "id long, text string")
    pairs = near.across_components(df.selectExpr("id", "id as component"), df, 2, 80)
    links = near.verified(pairs, df, 2, 80).collect()
    found = {i: i for i, _ in rows} | {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {i: c for i, (_, c) in brute(rows, 2, 80).items()} == found


def test_odd_rows(spark):
    cols = "doc_id long, text string, id long, component long, digest string"
    rows = [(1, "a b c", 9, 9, "z"), (1, "a b c", 9, 9, "z"), (None, "a b c", 9, 9, "z"), (None, None, None, None, None), (5, "", 1, 1, "")]
    df = spark.createDataFrame(rows, cols)
    got = sorted(map(tuple, near.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 1, 1, False), (None, 0, None, False), (5, 0, 5, True)], key=str)
    assert near.near_duplicates(df.limit(0)).count() == 0
    kept = near.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 5


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    name = {}
    edges = [(a, b) for a, b in edges if a is not None and a != b]
    for a, b in edges:
        name.setdefault(a, a), name.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    assert got == name
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_mode(spark):
    """With one table, which misses much, the prefix join finds the rest."""
    rows = corpus(7, groups=6, copies=8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: c for i, (_, c) in brute(rows, 5, 80).items()}
    few = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df, tables=1).collect()}
    assert few != want
    assert {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df, tables=1, exact=True).collect()} == want


def _reachable(edges):
    name = {}
    for a, b in edges:
        x, y = name.get(a, {a}), name.get(b, {b})
        for i in x | y:
            name[i] = x | y
    return {i: min(s) for i, s in name.items()}


def test_components_end_as_soon_as_edges_are_stars(spark, monkeypatch):
    """A star forest needs no round; joins with few and with many ids name paths, circles and equal edges alike."""
    rng, made = random.Random(3), []
    monkeypatch.setattr(graph, "saved", lambda df: made.append(saved(df)) or made[-1])
    stars = [(k * 100, k * 100 + i) for k in range(5) for i in range(1, 9)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame([e[::-1] if rng.random() < 0.5 else e for e in stars], "a long, b long")).collect()}
    assert got == _reachable(stars) and len(made) == 2
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i * 7 + 1) % 30) for i in range(30)] + [(rng.randrange(200, 320), rng.randrange(200, 320)) for _ in range(70)]
    edges += [(b, a) for a, b in edges[::3]] + [(-5, 7), (900, 900)]
    wanted = _reachable([e for e in edges if e[0] != e[1]])
    for most in (50_000, 0):
        monkeypatch.setattr(graph, "BROADCAST_ROWS", most)
        assert {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == wanted


def test_later_links_join_components(spark):
    """Links found across components put these together whole, single members too, as links of all pairs of a bucket would."""
    rng = random.Random(5)
    rows = sorted({(rng.randrange(25), rng.randrange(1000, 1090)) for _ in range(160)})
    ids = {}
    for key, i in rows:
        ids.setdefault(key, []).append(i)
    good = lambda a, b: (a * 7 + b * 13) % 5 == 0
    members = spark.createDataFrame([(k, i, 1, len(ids[k])) for k, i in rows], "key long, id long, attr int, members long")
    keep = lambda pairs: pairs.where("(a * 7 + b * 13) % 5 = 0")
    got = link(members, lambda x, y: x == y, keep, lambda placed: placed.selectExpr("id as a", "id as b").limit(0), 1000)
    assert {r["id"]: r["component"] for r in got.collect()} == _reachable([(a, b) for v in ids.values() for a in v for b in v if a < b and good(a, b)])
