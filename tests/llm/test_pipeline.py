import base64

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tailcast.llm import mixing
from tests.llm.test_near import brute


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, f"plain words {i} " + " ".join(f"w{i}x{k}" for k in range(40)), "en", f"src{i % 3}", 100) for i in range(60)]
    rows += [(100 + i, f"buy*** now$$$ {i}### " + " ".join(f"c{i}heap%%%{k}" for k in range(30)), "en", "src1", 100) for i in range(30)]
    rows += [(200 + i, rows[i][1].replace(" ", "  "), "en", "src2", 100) for i in range(5)]  # exact copies
    rows += [(300 + i, rows[20 + i][1] + " more", "en", "src0", 100) for i in range(5)]  # near copies
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 0, 0) for i in range(0, 30, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, {r[0]: r for r in rows}


def test_run(spark, tables):
    root, rows = tables
    out = corpus_pipeline.run(spark, root).collect()
    good = [(i, r[1]) for i, r in rows.items() if i < 60 or i >= 300]
    want = {i for i, (_, c) in brute(good, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in out} == want == set(range(60))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in out:
        assert np.frombuffer(r["ids"], "<u4").tolist() == known.encode_ordinary(rows[r["doc_id"]][1])


def test_run_keeps_the_order_of_the_mix(spark, tables, monkeypatch):
    """Over several files, with splits that pack files by size."""
    root, _ = tables
    monkeypatch.setattr(corpus_pipeline, "BLOCK_ROWS", 2)
    mixed = []

    def in_files(placed, keep):
        mixed.extend(placed.select("doc_id", "_cycle", "_slot", "_rank").collect())
        order = ["_cycle", "_slot", "_rank"]
        return placed.repartitionByRange(7, *order).sortWithinPartitions(*order).select(*keep)

    monkeypatch.setattr(mixing, "in_order", in_files)
    out = corpus_pipeline.run(spark, root).select("doc_id", "position").collect()
    want = [r["doc_id"] for r in sorted(mixed, key=lambda r: (r["_cycle"], r["_slot"], r["_rank"]))]
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in out) == list(range(60))


def test_stages(spark, tables):
    """All but the last return the columns of documents; the mix comes in schedule order."""
    root, _ = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = stage(spark, docs, root)
        assert made.columns == docs.columns, names[k]
        assert stage(spark, docs.limit(0), root).count() == 0
        made.write.parquet(f"{root}/stage{k}")
        docs = spark.read.parquet(f"{root}/stage{k}")
    placed = mixing.mixed(docs, {"src0": 6, "src1": 4, "src2": 4, "src3": 3}, 2, 64)
    want = [r["doc_id"] for r in placed.orderBy("_cycle", "_slot", "_rank").collect()]
    order = docs.select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect()
    assert [r["doc_id"] for r in sorted(order, key=lambda r: (r["f"], r["i"]))] == want


@pytest.mark.parametrize("name", ["op2_licence", "op5_mixing", "op7_exact_dedup", "op9_near_dedup"])
def test_like_sql(spark, tables, name):
    import duckdb

    from tailcast.llm import queries

    root, _ = tables
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{root}/documents.parquet/*.parquet')")
    df = queries.QUERIES[name](spark, root)
    names = sorted(df.columns)
    found = c.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    want = sorted((tuple(r[columns.index(n)] for n in names) for r in found.fetchall()), key=str)
    assert sorted(columns) == names
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == want


def test_stages_pass_columns_of_any_name(spark, tables):
    """Columns named as those that operators use inside come through every stage as they are."""
    root, _ = tables
    names = ["_p", "_site", "_quality", "_host", "_head", "_group_size", "_sha256", "_gone", "_source", "_block", "_cycle", "_slot", "_rank", "_mark", "id", "digest", "row", "component", "key", "_file", "_row", "_before"]
    docs = spark.read.parquet(f"{root}/documents.parquet").select("*", *[F.lit("own").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, root)
        assert made.columns == docs.columns, name
        kept = made.select(*names).distinct().collect()
        assert [tuple(r) for r in kept] == [("own",) * len(names)], name
    last = corpus_pipeline.STAGES[-1][1]
    docs.write.parquet(f"{root}/named")
    made = last(spark, spark.read.parquet(f"{root}/named"), root)
    assert [tuple(r) for r in made.select(*names).distinct().collect()] == [("own",) * len(names)]
