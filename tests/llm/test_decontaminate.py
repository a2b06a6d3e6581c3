import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from tailcast.llm import decontaminate as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def brute(docs, items, size=10):
    """(n_words, n_hit, items) of each document, and the words that are hit."""
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for _, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    named |= grams[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(named), hit))
    return out


def cases():
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["Alpha", "beta", "gamma", "delta", "Äther", "x9", "eps"]) for _ in range(n))
    items = [(i, some(rng.choice([11, 14, 25]))) for i in range(12)] + [(20, some(4)), (21, "solo"), (22, ""), (23, None), (24, "  .,"), (None, some(13)), (0, some(12))]
    items.append((30, items[2][1]))
    docs = [(1, None), (2, ""), (3, "..."), (4, "SOLO"), (5, "nothing here"), (None, "solo"), (None, items[0][1]), (7, items[0][1]), (7, items[0][1]), (7, items[1][1] + " solo")]
    for k in range(60):
        parts = [some(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items[:12])[1]).split()
            cut = rng.randint(0, 6)
            parts += [rng.choice([" ".join(w), " ".join(w).upper().replace(" ", ", "), " ".join(w[cut:]), " ".join(w[: len(w) - cut])]), some(rng.randint(0, 5))]
        docs.append((100 + k, "\n".join(parts)))
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, gram string, pos int")
    return d, spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, hash string")


@pytest.mark.parametrize("held", [None, 7])
def test_against_brute_force(spark, monkeypatch, held):
    """Also with more windows than one hash set holds."""
    if held:
        monkeypatch.setattr(dec, "SET_WINDOWS", held * 10)
    docs, items = cases()
    d, b = frames(spark, docs, items)
    got = sorted(tuple(r) for r in dec.judged(d.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))), b).collect())
    want = sorted((-1 if i is None else i, n, h, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), h > 0) for (i, _), (n, h, named, _) in zip(docs, brute(docs, items), strict=True))
    assert got == want


def test_null_ids_and_repeated_rows(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    rows = dec.judged(d, b).collect()
    assert len(rows) == len(docs) and sum(r["doc_id"] is None for r in rows) == 2
    assert all(r["contaminated"] for r in rows if r["doc_id"] is None)
    assert sorted(r["n_hit"] for r in rows if r["doc_id"] == 7)[1:] == sorted(h for (i, _), (_, h, _, _) in zip(docs, brute(docs, items), strict=True) if i == 7)[1:]


def test_spans_are_cut_out(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    d = d.withColumn("n", F.monotonically_increasing_id())
    before = {r["n"]: r for r in d.collect()}
    after = {r["n"]: r for r in dec.decontaminated(d, b, remove="spans").collect()}
    assert set(before) == set(after) and dec.decontaminated(d, b, remove="spans").columns == d.columns
    for n, r in before.items():
        ((_, _, _, hit),) = brute([(r["doc_id"], r["text"])], items)
        left = after[n]["text"]
        assert words(left) == [x for i, x in enumerate(words(r["text"])) if i not in hit]
        assert hit or left == r["text"]
    kept = dec.decontaminated(d, b)
    assert {r["n"] for r in kept.collect()} == {n for n, r in before.items() if not brute([(0, r["text"])], items)[0][3]}
    with pytest.raises(ValueError):
        dec.decontaminated(d, b, remove="lines")


def test_what_stands_around_a_run_stays(spark):
    d, b = frames(spark, [(1, "(Go) one two, three! stop."), (2, "one two three"), (3, "one two three four one two three")], [(1, "one two three")])
    got = dec.decontaminated(d, b, remove="spans").orderBy("doc_id")
    assert [r["text"] for r in got.collect()] == ["(Go) ! stop.", "", " four "]


def test_empty_tables(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    assert dec.judged(d.limit(0), b).count() == 0
    none = dec.judged(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)
    assert dec.decontaminated(d, b.limit(0)).count() == len(docs)


def test_a_very_long_text(spark):
    item = " ".join(f"q{k}" for k in range(30))
    text = "so many plain words " * 100_000 + item + " and more " * 100_000
    d, b = frames(spark, [(1, text)], [(5, item)])
    (row,) = dec.judged(d, b).collect()
    assert (row["n_words"], row["n_hit"], row["n_items"]) == (600_030, 30, 1)
    assert words(dec.decontaminated(d, b, remove="spans").first()["text"]) == words(text.replace(item, ""))


def test_stays_native(spark):
    d, b = frames(spark, *cases())
    for df in (dec.judged(d, b), dec.decontaminated(d, b), dec.decontaminated(d, b, remove="spans")):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
