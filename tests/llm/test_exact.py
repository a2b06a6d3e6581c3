import hashlib
import random
import re

from tailcast.llm import exact


def test_against_brute_force(spark):
    rng = random.Random(0)
    texts = ["a  b", "a b", "a\n\tb", " a b", "", None, " ", "\n", "x" * 100_000, "x" * 100_000 + " ", "é b", "é\x0bb"]
    same_start = ["start " * 20 + str(i % 7) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(rng.choices(texts, k=300) + same_start)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = {}
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups.setdefault(plain(t), []).append(i)
    want = {(i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in exact.exact_groups(df).collect()} == want
    kept = exact.deduplicate(df).collect()
    assert {r["doc_id"] for r in kept} == {min(g) for g in groups.values()}
    assert len(kept) == len(groups)
    assert {(r["doc_id"], r["text"]) for r in kept} <= set(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(3, "t", "x", 1), (3, "t", "x", 1), (None, "t", "x", 1), (None, "u", None, None)], "doc_id long, text string, keep_id string, kept int")
    got = sorted((tuple(r)[:4] for r in exact.exact_groups(df).collect()), key=str)
    assert got == sorted([(3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (None, None, 1, False)], key=str)
    kept = exact.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"]) == [(3, "t")] and kept.count() == 2
    assert exact.exact_groups(df.limit(0)).count() == 0 and exact.deduplicate(df.limit(0)).count() == 0


def test_clashing_names(spark):
    names = ["_head", "_group_size", "_sha256", "_HEAD_", "keep_id"]
    df = spark.createDataFrame([(3, "t", *names), (2, "t", *names)], ["doc_id", "text", *names])
    kept = exact.deduplicate(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(2, "t", *names)]
    made = exact.content_groups(df)
    assert made.columns == ["doc_id", "text", "_head", "_HEAD_", "keep_id", "_group_size", "_sha256"] and made.first()["_group_size"] == 2
    assert exact.exact_groups(df).count() == 2
