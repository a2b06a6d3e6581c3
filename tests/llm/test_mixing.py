import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tailcast.llm import mixing


def test_plan_is_earliest_deadline_first(spark):
    shares = {"a": 5, "b": 3, "c": 1, "d": 2}
    got = [r["source"] for r in mixing.plan(spark.createDataFrame(list(shares.items()), "source string, share long")).orderBy("slot").collect()]
    d, done, want = sum(shares.values()), Counter(), []
    for t in range(d):
        ready = [(-(-(done[s] + 1) * d // q), s) for s, q in shares.items() if done[s] < q and done[s] * d // q <= t]
        want.append(min(ready)[1])
        done[want[-1]] += 1
    assert got == want
    assert mixing.plan(spark.createDataFrame([], "source string, share long")).count() == 0


def test_less_than_a_block_from_target(spark):
    shares = {"a": 5, "b": 3}
    rows = [(i, "abc"[i % 3]) for i in range(900)] + [(1000 + i, "a") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = sorted(mixing.mixed(df, shares, other=2, block_rows=10).collect(), key=lambda r: (r["_cycle"], r["_slot"], r["_rank"]))
    assert sorted((r["doc_id"], r["source"]) for r in out) == sorted(rows)
    blocks = list(dict.fromkeys((r["_source"], r["_block"]) for r in out))
    left = Counter(s for s, _ in blocks)
    had, q = Counter(), {"a": 5, "b": 3, "c": 2}
    for n, (s, k) in enumerate(blocks, 1):
        assert k == had[s]
        had[s] += 1
        assert all(abs(had[x] - n * q[x] / 10) < 1 for x in q)
        if any(had[x] == left[x] for x in q):
            break
    assert n > 60


def test_ranks_and_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 10)
    rows = [(i, None if i % 5 else "s", "old") for i in range(400)] + [(None, "s", "old"), (7, "s", "old"), (7, "s", "old")]
    df = spark.createDataFrame(rows, "doc_id long, source string, _x string")
    out = mixing.mixed(df, {"s": 2}, block_rows=7)
    assert out.count() == len(rows)
    for source in ("", "s"):
        own = sorted((r["_rank"], r["doc_id"]) for r in out.where(out["_source"] == source).select("_rank", "doc_id").collect() if r["doc_id"] is not None)
        marks = [hashlib.md5(str(i).encode()).hexdigest() for _, i in own]
        assert marks == sorted(marks)
    files = mixing.in_order(out, df.columns)
    assert files.columns == df.columns and files.count() == len(rows)
    assert mixing.mixed(df.limit(0), {"s": 2}).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(df, {"s": 0})


def test_no_python_on_executors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    plan = mixing.mixed(df, {"a": 2})._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_plan_of_many_sources(spark, monkeypatch):
    """As slot by slot, with ties to the smaller name, named sources among many of one share."""
    import heapq

    shares = {f"s{k:03}": 2 for k in range(300)} | {"s050x": 7, "s200": 5, "s200x": 4, "a": 3, "z": 4}
    got = [r["source"] for r in mixing.plan(spark.createDataFrame(list(shares.items()), "source string, share long").repartition(7)).orderBy("slot").collect()]
    d, want, ready = sum(shares.values()), [], []
    jobs = sorted((k * d // q, -(-(k + 1) * d // q), s) for s, q in shares.items() for k in range(q))
    for t in range(d):
        while jobs and jobs[0][0] <= t:
            heapq.heappush(ready, jobs.pop(0)[1:])
        want.append(heapq.heappop(ready)[1])
    assert got == want
    monkeypatch.setattr(mixing, "MOST_TURNS", 20)
    with pytest.raises(ValueError):
        mixing.plan(spark.createDataFrame(list(shares.items()), "source string, share long"))


def test_many_sources_one_large_and_null_ids(spark):
    """20,000 sources, one of a third of the rows, and many rows without an id."""
    df = spark.range(300_000).selectExpr("if(id % 5 = 0, null, id) as doc_id", "if(id % 3 = 0, 'big', concat('host', id % 20000)) as source")
    out = mixing.mixed(df, {"big": 500}, other=1, block_rows=8)
    got = out.groupBy("_source").agg(F.count("*").alias("n"), F.countDistinct("_rank").alias("d"), F.max("_rank").alias("last")).where("n != d or last != n - 1")
    assert out.count() == 300_000 and got.count() == 0
    blocks = out.select("_cycle", "_slot", "_source").distinct()
    assert blocks.count() == blocks.select("_cycle", "_slot").distinct().count() == out.select("_source", "_block").distinct().count()


def test_clashing_names(spark):
    names = ["_source", "_mark", "_part", "_in", "_rank", "_block", "_cycle", "_turn", "_before", "_slot", "_share", "_b", "_run", "row", "r"]
    df = spark.range(50).selectExpr("id as doc_id", "concat('s', id % 3) as source", *[f"'own' as {c}" for c in names])
    out = mixing.mixed(df, {"s1": 2}, block_rows=4)
    results = ["_source", "_block", "_cycle", "_slot", "_rank"]
    kept = [c for c in df.columns if c not in results]
    assert out.columns == kept + results
    assert {tuple(r) for r in out.select(*kept[2:]).collect()} == {("own",) * len(kept[2:])}
    stage = dict(corpus_pipeline.STAGES)["mixing sources to target weights"](spark, df, "")
    assert stage.columns == df.columns and {tuple(r) for r in stage.select(*names).collect()} == {("own",) * len(names)}
