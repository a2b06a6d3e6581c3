import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tailcast.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def lines():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def known(lines):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", " ", "\n\n\n  x", "Hello world's it'll 12345", "<|endoftext|> is text", "naïve Straße ñandú 日本語 текст 🙂🙂",
    "a" * 5000, " " * 300, "ab" * 2000, "  mixed\tspace\r\n", "é" * 777, "x\x00y\x7f", "!!??***" * 50,
]


def test_like_tiktoken(spark, known):
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice("abcdeéß 🙂'\n19.") for _ in range(rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        text = r["text"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == known.encode_ordinary(text)
        assert r["n_tokens"] * 4 == len(r["ids"])
        assert bytes(r["decoded"]) == text.encode()


def test_appends_and_edits(lines):
    v, rng = bpe.load(lines)[0], random.Random(1)
    for _ in range(60):
        data = bytes(rng.choice(b"thern aeio") for _ in range(rng.randrange(400)))
        cut = rng.randrange(len(data) + 1)
        p = bpe.Prefixes(v, data[:cut])
        p.append(data[cut:])
        assert p.last == bpe.Prefixes(v, data).last
        start = rng.randrange(len(data) + 1)
        stop = rng.randrange(start, len(data) + 1)
        new = bytes(rng.choice(b"thern aeio") for _ in range(rng.randrange(20)))
        p.replace(start, stop, new)
        assert p.data == data[:start] + new + data[stop:]
        assert p.last == bpe.Prefixes(v, p.data).last
    p = bpe.Prefixes(v, b"then an other " * 2000)
    assert p.replace(5, 6, b"x") < 2000


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab", "old", 7)], "doc_id long, text string, ids string, extra long")
    row = bpe.encode(df, PATH, public_tokenizers.PATTERN).first()
    assert row["extra"] == 7 and row["n_tokens"] == 1
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, tmp_path, known):
    from tailcast.llm.queries import op1_bpe

    spark.createDataFrame([(1, "one two"), (1, "one two"), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted(op1_bpe(spark, str(tmp_path)).collect(), key=str)
    ids = known.encode_ordinary("one two")
    assert [r["doc_id"] for r in out] == [1, 1, None]
    assert out[0]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert out[0]["decoded_sha256"] == hashlib.sha256(b"one two").hexdigest()
    assert out[2]["n_tokens"] == 0
