import numpy as np
from pyspark.sql import functions as F

from tailcast.llm import quality


def test_features():
    f = quality.features([b"", "Aé 1!*\n".encode(), b"abc"])
    assert f.shape[0] == 3 and not f[0, :14].any()
    np.testing.assert_allclose(f[1, :7], np.array([1, 2, 1, 2, 1, 0, 1]) / 8)
    assert f[2, 1] == 1
    g = quality.features([b"", b"a a b b b", b"one", b"b c", b"c c", b""])
    np.testing.assert_allclose(g[:, 14], [0, 3 / 4, 0, 0, 1, 0])


def docs(spark):
    good = [(i, f"plain words of ordinary text number {i} and more of it", "h1" if i % 2 else "h2", "en") for i in range(80)]
    bad = [(100 + i, f"buy*** now$$$ {i}### cheap%%% pills&&& {i}@@@", "h3", "en") for i in range(40)]
    return spark.createDataFrame(good + bad, "doc_id long, text string, source string, lang string")


def test_parts_good_from_bad(spark):
    d = docs(spark)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 80, 3)] + [(100 + i, 0) for i in range(0, 40, 3)] + [(5, None), (None, 1)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.kept(d, labels).collect()}
    assert kept == set(range(80))
    assert quality.kept(d, labels).columns == d.columns


def plain_strength(groups, rate):
    """Pseudo-counts by the method of moments, from lists of evidence by site."""
    n = np.array([len(g) for g in groups], dtype=float)
    if len(n) < 2:
        return 100.0
    mean = np.array([np.mean(g) for g in groups])
    inner = sum(((np.array(g) - m) ** 2).sum() for g, m in zip(groups, mean, strict=True)) / max(n.sum() - len(n), 1)
    spread = ((n * (mean - rate) ** 2).sum() - (len(n) - 1) * inner) / max(n.sum() - (n**2).sum() / n.sum(), 1e-9)
    return float(np.clip(rate * (1 - rate) / max(spread, 1e-6) - 1, 1, 1e4))


def test_posterior_against_brute_force(spark):
    """Every document's posterior, worked out from all others one by one."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        host, path = f"h{rng.integers(9) ** 2 // 8}", rng.choice(["en", "de", "x"])
        bad = rng.random() < (0.8 if host == "h0" else 0.5 if path == "x" else 0.1)
        rows.append((i, f"buy*** {i}### %%% now" if bad else f"plain words of text number {i} and more", host, str(path), not bad))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, good boolean")
    labels = d.where("doc_id % 3 = 0").selectExpr("doc_id", "int(good) as quality")
    out = {r["doc_id"]: r for r in quality.classified(d, labels).collect()}
    p = {i: out[i]["_p"] for i in out}
    hosts, paths = {}, {}
    for i, _, h, l, _ in rows:
        hosts.setdefault(h, []).append(i), paths.setdefault((h, l), []).append(i)
    rate = np.mean(list(p.values()))
    of_host, of_path = (plain_strength([[p[i] for i in g] for g in groups.values()], rate) for groups in (hosts, paths))
    for i, _, h, l, _ in rows:
        others, near = ([p[j] for j in g if j != i] for g in (hosts[h], paths[h, l]))
        parent = (sum(others) + of_host * rate) / (len(others) + of_host)
        site = (sum(near) + of_path * parent) / (len(near) + of_path)
        odds = p[i] / (1 - p[i]) * site / (1 - site) / (rate / (1 - rate))
        np.testing.assert_allclose([out[i]["_site"], out[i]["_quality"]], [site, odds / (1 + odds)], rtol=1e-6)
    narrow = quality.classified(d, labels, whole=False)
    assert "text" not in narrow.columns
    assert all(abs(r["_quality"] - out[r["doc_id"]]["_quality"]) < 1e-9 for r in narrow.collect())


def test_clashing_names_and_repeated_ids(spark):
    names = ["_p", "_n", "_sum", "_parent", "_strength", "_site", "_quality", "_host", "_path", "_host_n", "__P"]
    d = docs(spark)
    clash = d.select("*", *[F.lit("own").alias(c) for c in names[:-1]])
    labels = spark.createDataFrame([(i, 1) for i in range(0, 80, 3)] + [(100 + i, 0) for i in range(0, 40, 3)], "doc_id long, quality int")
    kept = quality.kept(clash, labels)
    assert kept.columns == clash.columns
    assert {tuple(r[5:]) for r in kept.select("doc_id", "text", "source", "lang", "_p", *names[:-1]).collect()} == {("own",) * 10}
    made = quality.classified(clash, labels)
    assert made.columns == [c for c in clash.columns if c not in ("_p", "_site", "_quality")] + ["_p", "_site", "_quality"]
    assert made.count() == 120
    many = spark.range(3000).selectExpr("7L as doc_id", "concat('word ', id) as text")
    taken = []
    whole = quality.fit
    quality.fit = lambda x, y: taken.append(len(x)) or whole(x, y)
    try:
        quality.train(many, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int"), most=10)
    finally:
        quality.fit = whole
    assert taken == [1]


def test_shrinks_sparse_sites(spark):
    """A lone document of a site leans on the corpus, not on itself."""
    d = spark.createDataFrame([(i, "some ordinary words", "big", "en") for i in range(50)] + [(99, "some ordinary words", "tiny", "x")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.classified(d, labels).collect()}
    assert abs(rows[99]["_site"] - rows[0]["_site"]) < 0.05


def test_odd_rows(spark):
    d = spark.createDataFrame([(None, None, None, None, 1.0), (1, "", "h", None, 2.0), (1, "", "h", None, 2.0)], "doc_id long, text string, source string, lang string, _x double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.classified(d, none)
    assert out.count() == 3 and quality.kept(d, none).count() == 3
    assert quality.classified(d.limit(0), none).count() == 0
