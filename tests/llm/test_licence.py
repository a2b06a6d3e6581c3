import random
import re
import string

from tailcast.llm import licence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def base(text):
    w = words(text)
    places = [(i, label) for phrase, label in licence.PHRASES.items() for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


def notices(text):
    """Labels of the notices that a stretch of the text holds most of, more than any other notice does."""
    w, found = words(text), []
    for number, (notice, label) in enumerate(licence.NOTICES.items()):
        p = notice.split()
        at = {}
        for i in range(len(p) - 2):
            at.setdefault(tuple(p[i : i + 3]), []).append(i)
        hits = [(k - i, i, k) for k in range(len(w) - 2) for i in at.get(tuple(w[k : k + 3]), [])]
        for d in {d for d, _, _ in hits}:
            own = [(i, k) for e, i, k in hits if d <= e <= d + licence.SLACK]
            found.append((min(k for _, k in own), max(k for _, k in own) + 2, (len({i for i, _ in own}) / (len(p) - 2), len(p), -number, -d), label))
    return {label for lo, hi, value, label in found if value[0] >= licence.COVER and value == max(v for a, b, v, _ in found if a <= hi and b >= lo)}


def cases():
    rng = random.Random(0)
    filler = lambda n: " ".join(rng.choice(["the", "of", "software", "license", "mit", "under", "cc", "by", "nc", "version", "2", "é", "x9"]) for _ in range(n))
    out = ["", None, "Licensed under the Apache License, Version 2.0.", "UNDER THE MIT-license; under the MIT License", "cc by nc by nc cc by-nc", "mit", "under the mit", "İ under\x00the mit\x7flicense ß"]
    for notice in licence.NOTICES:
        w = notice.split()
        out += [notice, notice.upper() + "!", filler(50) + " " + notice + " " + filler(30), " ".join(w[:-6]), " ".join(w[: len(w) // 2])]
        gone = w.copy()
        del gone[len(w) // 2]
        out += [" ".join(gone), " ".join(w[:8] + ["inserted", "words"] + w[8:])]
    w = next(n for n, label in licence.NOTICES.items() if label == "bsd").split()
    out += [" ".join(w + w[-3:] * times) for times in (1, 8, 20)] + [" ".join((w + ["so"] * 5) * 3)]
    return out + [filler(200) for _ in range(40)] + [filler(40_000)]


def test_against_brute_force(spark):
    texts = cases()
    got = {r["doc_id"]: r for r in licence.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert tuple(r)[1:6] == base(text), text
        assert r["labels"] == ",".join(sorted(set(filter(None, r["base_labels"].split(","))) | notices(text))), text
        if text in licence.NOTICES:
            assert r["labels"].split(",")[-1:] == [licence.NOTICES[text]] or licence.NOTICES[text] in r["labels"], text
        assert 0 <= r["score"] <= 1 and bool(r["score"]) == bool(r["labels"])


def test_spans_and_odd_rows(spark):
    rows = [(1, "so cc by nc it is", "a", 5), (1, "so cc by nc it is", "a", 5), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, pos int")
    assert licence.scanned(df).count() == 3
    found = licence.spans(df).where("template is not null").select("label", "first", "last", "cover").collect()
    assert [tuple(r) for r in found] == [("cc-by-nc", 1, 3, 1.0)] * 2
    assert licence.scanned(df.limit(0)).count() == 0


def test_a_repeated_end_hides_nothing(spark):
    notice = next(n for n, label in licence.NOTICES.items() if label == "bsd")
    df = spark.createDataFrame([(n, " ".join([notice, *notice.split()[-3:] * n])) for n in (0, 1, 8, 20)], "doc_id long, text string")
    assert {(r["labels"], r["score"]) for r in licence.scanned(df).collect()} == {("bsd", 1.0)}


def test_long_templates_and_families(spark):
    """Templates of more than 64 words; of one family's notices only the one that is there."""
    mine = " ".join(f"w{k}" for k in range(300))
    texts = [mine, mine.replace("w150", "x y z"), *[n for n, label in licence.NOTICES.items() if "gpl" in label or "cc-" in label]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["labels"] for r in licence.scanned(df, notices={mine: "own", **licence.NOTICES}).orderBy("doc_id").collect()]
    assert got == ["own", "own"] + [licence.NOTICES[t] for t in texts[2:]]


def test_neighbours_hide_nothing(spark):
    """Notices back to back, or a few words apart, each count: all pairs of the table, and three in a row."""
    table = list(licence.NOTICES.items())
    texts = [f"{a}{gap}{b}" for a, _ in table for b, _ in table if a != b for gap in (" ", " or at choice ")]
    texts += [" ".join(x for x, _ in table[k : k + 3]) for k in range(len(table) - 2)]
    wanted = [{la, lb} for a, la in table for b, lb in table if a != b for _ in range(2)] + [{label for _, label in table[k : k + 3]} for k in range(len(table) - 2)]
    got = licence.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    lost = [(text, w, r["labels"]) for text, w, r in zip(texts, wanted, got, strict=True) if not w <= set(r["labels"].split(","))]
    assert not lost, lost[:3]


def test_a_very_long_text(spark):
    notice = next(n for n, label in licence.NOTICES.items() if label == "cc0")
    text = "plain words of no licence " * 60_000 + notice + " more of the same" * 60_000
    (row,) = licence.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["labels"] == "cc0" and row["n_words"] == len(words(text))
