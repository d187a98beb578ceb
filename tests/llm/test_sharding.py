import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import plain
from tests.llm.conftest import ODD, documents
from tracelake.llm.sharding import jump_hash, shard_rows


def test_published_values_and_many_shards(spark):
    keys = [0, 1, 5, 42, -1, 2**62, -(2**63), *range(1000, 1100)]
    table = spark.createDataFrame([(k,) for k in keys], "k bigint")
    counts = (1, 2, 16, 17, 1000)
    row = table.select("k", *[jump_hash(F.col("k"), n).alias(f"s{n}") for n in counts]).collect()
    for r in row:
        assert [r[f"s{n}"] for n in counts] == [plain.jump(r["k"], n) for n in counts]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(1, 50))
def test_plain_rule_moves_rows_only_into_the_new_shard(key, shards):
    assert plain.jump(key, shards + 1) in (plain.jump(key, shards), shards)


def test_odd_rows(spark, odd):
    rows = shard_rows(odd, 4).collect()
    assert len(rows) == len(ODD)
    slots = {}
    for row in rows:
        slots.setdefault(row["shard"], []).append(row["slot"])
        assert row["shard"] == plain.jump(row["doc_id"] or 0, 4)
        assert row["grown_shard"] == plain.jump(row["doc_id"] or 0, 5)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    texts = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in ODD)
    assert sorted((row["size"], row["text_crc32"]) for row in rows) == texts


def test_even_and_native(spark):
    docs = documents(spark, [(i, "t") for i in range(4000)])
    placed = shard_rows(docs, 16)
    counts = [row["count"] for row in placed.groupBy("shard").count().collect()]
    assert len(counts) == 16 and min(counts) > 190 and max(counts) < 310
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_empty_table(empty):
    assert shard_rows(empty, 16).collect() == []
