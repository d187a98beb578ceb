"""Running values: plain windows, chunks for some keys, chunks for all keys."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import scan
from tracelake.functions.scan import Running, chunk_of, hot_keys, running
from tracelake.operators.metrics import rtt_lists
from tracelake.operators.traffic import running_totals


def wanted():
    return [
        Running("total", F.col("v"), "sum"),
        Running("total_before", F.col("v"), "sum", "before"),
        Running("high", F.col("v"), "max"),
        Running("high_before", F.col("v"), "max", "before"),
        Running("latest", F.struct("v"), "last"),
        Running("known", F.col("v"), "last", "before"),
        Running("final", F.col("v"), "last", "whole"),
    ]


def by_hand(rows):
    result = []
    for key in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == key)
        values = [v for _, _, v in mine]
        last = [v for v in values if v is not None]
        for i, (_, n, v) in enumerate(mine):
            seen = [x for x in values[: i + 1] if x is not None]
            before = [x for x in values[:i] if x is not None]
            result.append(
                (key, n, v, sum(seen), sum(before), max(seen, default=None), max(before, default=None), v)
                + (before[-1] if before else None, last[-1] if last else None)
            )
    return sorted(result, key=str)


@pytest.mark.parametrize("chunk_rows, broadcast_keys", [(1 << 20, 100), (20, 100), (5, 100), (5, 0)])
def test_running(spark, monkeypatch, chunk_rows, broadcast_keys):
    monkeypatch.setattr(scan, "BROADCAST_KEYS", broadcast_keys)
    rng = random.Random(1)
    rows = [
        ("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", n, rng.choice([None, rng.randrange(100)]))
        for n in rng.sample(range(900), 300)
    ]
    df = spark.createDataFrame(rows, "k string, n bigint, v bigint").withColumn("c", chunk_of("n", chunk_rows))
    hot = hot_keys(df, ["k"], chunk_rows)
    assert (hot.table is None) == (chunk_rows > 300)
    assert hot.table is None or hot.broadcast == (broadcast_keys > 0)
    found = running(df, ["k"], ["n"], ["c"], wanted(), hot).withColumn("latest", F.col("latest.v")).drop("c")
    assert sorted((tuple(r) for r in found.collect()), key=str) == by_hand(rows)


def test_running_totals_of_a_large_trace(spark):
    packets = spark.range(1, 301).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("trace_file"),
        F.col("id").alias("frame_no"),
        F.when(F.col("id") % 7 == 0, 6).otherwise(4).alias("ip_version"),
        (F.col("id") % 11).cast("int").alias("ip_total_len"),
    )
    columns = ("trace_file", "frame_no", "bytes", "packets")
    plain = sorted(tuple(r) for r in running_totals(packets).select(*columns).collect())
    assert sorted(tuple(r) for r in running_totals(packets, 16).select(*columns).collect()) == plain
    totals, want = {}, []
    for no in range(1, 301):
        if no % 7:
            trace = "a" if no % 3 == 0 else "b"
            size, count = totals.get(trace, (0, 0))
            totals[trace] = (size + no % 11, count + 1)
            want.append((trace, no, *totals[trace]))
    assert plain == sorted(want)


@pytest.mark.parametrize("chunk_rows", [1 << 20, 3])
def test_rtt_lists_are_cut_into_parts(spark, chunk_rows):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randint(-6, 12)) for _ in range(200)] + [(9, 4)] * 25
    samples = spark.createDataFrame(rows, "sec bigint, rtt_ms bigint")
    found = {(r.sec, r.part): r.rtts for r in rtt_lists(samples, 10, chunk_rows).collect()}
    want = {}
    for sec in {s for s, _ in rows}:
        values = sorted(v for s, v in rows if s == sec)
        for part in range(0, len(values), 10):
            some = values[part : part + 10]
            want[sec, part // 10] = f"({len(some)})[" + "".join(f"{v} " for v in some) + "]"
    assert found == want


@pytest.mark.parametrize("chunk_rows, broadcast_keys", [(1 << 20, 9), (10, 9), (10, 0)])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_by_key_is_the_join(spark, monkeypatch, how, chunk_rows, broadcast_keys):
    """Whether no, few or many keys are hot, the rows are those of a plain join."""
    monkeypatch.setattr(scan, "BROADCAST_KEYS", broadcast_keys)
    rng = random.Random(chunk_rows)
    many = spark.createDataFrame([(f"s{rng.randrange(2)}", rng.choice("aaaaaabcd"), i) for i in range(200)], "s string, k string, n int")
    one = spark.createDataFrame([("s0", "a", 1), ("s1", "a", 2), ("s0", "b", 3), ("s1", "z", 4)], "s string, k string, m int")
    hot = scan.hot_keys(many, ["s", "k"], chunk_rows)
    got = scan.join_by_key(many, one, ["s", "k"], hot, how)
    want = many.join(one, ["s", "k"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_beyond_the_most_keys_only_the_largest_are_sent_around(spark, monkeypatch):
    """The other hot keys have few of all rows each: they meet in a shuffle, and no row is repeated for them."""
    monkeypatch.setattr(scan, "BROADCAST_KEYS", 2)
    rows = [(f"k{i}", n, n % 7) for i in range(6) for n in range(5 + 10 * i)]
    df = spark.createDataFrame(rows, "k string, n bigint, v bigint").withColumn("c", chunk_of("n", 4))
    hot = hot_keys(df, ["k"], 4)
    assert not hot.broadcast and hot.table.count() == 6
    assert sorted(r.k for r in hot.largest.collect()) == ["k4", "k5"]
    one = spark.createDataFrame([(f"k{i}", i) for i in range(1, 7)], "k string, m int")
    joined = scan.join_by_key(df, one, ["k"], hot, "left")
    assert "Generate" not in joined._jdf.queryExecution().toString()
    assert sorted(map(str, joined.collect())) == sorted(map(str, df.join(one, ["k"], "left").collect()))
    found = running(df, ["k"], ["n"], ["c"], wanted(), hot).withColumn("latest", F.col("latest.v")).drop("c")
    assert sorted((tuple(r) for r in found.collect()), key=str) == by_hand(rows)
