import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import plain
from tests.llm.conftest import documents, prose
from tracelake.llm import mixing



def words():
    return F.regexp_count(F.col("text"), F.lit(mixing.WORD.pattern))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
def test_even_counts(sizes):
    for total in sizes:
        counts = mixing.even_counts(total, len(sizes))
        assert counts.sum() == total and np.ptp(counts) <= 1


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = rng.sample([None, "", "a", "Z", "ä", "z", "\U0001f600", "\uffee", *(f"s{i}" for i in range(60))], rng.choice([1, 3, 40]))
    sizes = [rng.choice([0, 1, 7, 7, 100, 3000, rng.randrange(10_000)]) for _ in names]
    rows = [(i, name, part) for i, (name, n) in enumerate(zip(names, sizes, strict=True)) for part in (n // 3, n - n // 3)]
    sized = spark.createDataFrame(rows, "key int, source string, size bigint")
    share, most = rng.choice([(1.5, 2.0), (0.3, 1.0), (5.0, 2.0)])
    weights = rng.choice([(3.0, 1.0, 2.0), (1.0,), (0.5, 0.0, 0.25, 4.0)])
    got = mixing.source_table(sized, weights, share, most).orderBy("source_no").collect()
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    assert [(r["source_no"], r["source"], r["source_size"]) for r in got] == [(k, names[i], sizes[i]) for k, i in enumerate(order)]
    own = [weights[k % len(weights)] for k in range(len(order))]
    taking = [k for k in range(len(order)) if own[k] > 0 and got[k]["source_size"] > 0]
    total = share * sum(sizes) / max(1, sum(got[k]["source_size"] for k in taking))
    wanted = plain.targets([got[k]["source_size"] for k in taking], [own[k] for k in taking], total, most)
    want = dict(zip(taking, wanted, strict=True))
    assert np.allclose([r["target"] for r in got], [want.get(k, 0.0) for k in range(len(got))])


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation(size, seed):
    index = np.arange(size)
    got = mixing.permuted(index, np.full(size, size), np.full(size, seed))
    assert sorted(got.tolist()) == index.tolist()


def test_draws_sum_up():
    owed = np.array([1000, 0, 37, 5])
    counts = mixing.draw_counts(owed, 7, 1)
    assert counts.sum(axis=0).tolist() == owed.tolist()
    assert np.ptp(counts.sum(axis=1)) <= 1
    assert (mixing.draw_counts(owed, 7, 1) == counts).all()


def rows_of(seed):
    sources = ["b", "a", None, "ä", "Z", ""]
    rows = [(i, text, "en", sources[i % 3 if i % 2 else i % 6]) for i, text in prose(seed, 300)]
    return rows + [(900, None, "en", "a"), (901, "", "en", None), (902, " ", "en", "only"), (900, None, "en", "a")]


def test_targets_are_met(spark):
    rows = rows_of(2)
    docs = documents(spark, rows)
    got = mixing.taken(mixing.mix_sources(docs, words(), block=8)).collect()
    assert len(got) == len(rows)
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(plain.measures(r[1])[0] for r in rows if r[3] == name) for name in names]
    wanted = dict(zip(names, plain.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    for name, size in zip(names, sizes, strict=True):
        mine = [row for row in got if row["source"] == name]
        assert all(row["source_size"] == size and abs(row["target"] - wanted[name]) < 1e-6 for row in mine)
        assert abs(sum(row["taken"] for row in mine) - wanted[name]) <= 0.51
    assert all(0 <= row["taken"] <= 2 * row["size"] for row in got)
    again = mixing.taken(mixing.mix_sources(docs.repartition(7), words(), block=8)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_spans_lie_in_shards(spark):
    docs = documents(spark, rows_of(3))
    mixed = mixing.mix_sources(docs, words(), block=8, shards=4).where("shard is not null").collect()
    assert {row["shard"] for row in mixed} == {0, 1, 2, 3}
    passes = {}
    for row in mixed:
        for word in range(row["start"], row["start"] + row["length"]):
            place = (row["doc_id"], row["source"], row["row"], row["copy"], word)
            passes[place] = passes.get(place, 0) + 1
            assert word < row["size"]
    assert set(passes.values()) == {1}


def test_mixed_documents_hold_the_words_taken(spark):
    rows = rows_of(4)
    docs = documents(spark, rows)
    out = mixing.mix_documents(docs, block=8)
    assert out.columns == docs.columns
    got = out.collect()
    texts = {r[0]: r[1] or "" for r in rows}
    held = {}
    for row in got:
        assert row["text"] in texts[row["doc_id"]] and row["n_chars"] == len(row["text"])
        held[row["doc_id"]] = held.get(row["doc_id"], 0) + plain.measures(row["text"])[0]
    taken = mixing.taken(mixing.mix_sources(docs, words(), block=8)).collect()
    assert sum(held.values()) == sum(row["taken"] for row in taken)
    assert all(held[i] <= 2 * plain.measures(texts[i])[0] for i in held)


def test_small_sources_give_their_targets(spark):
    """Sources far below a block give what they owe, too."""
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 40:02d}") for i in range(200)] + [(999, "w " * 5000, "en", "large")]
    got = mixing.taken(mixing.mix_sources(documents(spark, rows), words(), block=64)).collect()
    sums = {}
    for row in got:
        taken, _ = sums.get(row["source"], (0, 0))
        sums[row["source"]] = taken + row["taken"], row["target"]
        assert 0 <= row["taken"] <= 2 * row["size"]
    assert len(sums) == 41 and all(abs(taken - target) <= 0.51 for taken, target in sums.values())


def test_more_sources_than_any_driver_plan(spark):
    """200,000 sources, a third of them with one document; the hot one holds a third of all rows."""
    docs = spark.range(400_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 200_000)).alias("source"),
        F.lit("a b c").alias("text"),
    )
    mixed = mixing.mix_sources(docs, words(), block=64)
    sums = mixing.taken(mixed).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum("size"))
    assert sums.count() > 190_000
    assert sums.where("abs(taken - target) > 0.51 or taken > 2 * `sum(size)`").count() == 0


def test_groups_of_sources_draw_like_one(spark, monkeypatch):
    """Drawn in few groups, every shard still gets the same number of slots, and every source gives what it owes."""
    monkeypatch.setattr(mixing, "DRAWN_TOGETHER", 3)
    docs = documents(spark, rows_of(5))
    got = mixing.taken(mixing.mix_sources(docs, words(), block=8)).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"))
    assert all(abs(row["n"] - row["t"]) <= 0.51 for row in got.collect())
    mixed = mixing.mix_sources(docs, words(), block=8, shards=5).where("shard is not null")
    slots = mixed.select("shard", "place").distinct().groupBy("shard").count().collect()
    assert len(slots) == 5 and max(r["count"] for r in slots) - min(r["count"] for r in slots) <= 1


def test_odd_rows_and_empty_table(odd, empty):
    got = mixing.taken(mixing.mix_sources(odd, words())).collect()
    assert len(got) == odd.count()
    assert mixing.taken(mixing.mix_sources(empty, words())).collect() == []
    assert mixing.mix_documents(empty).collect() == []
    assert mixing.mix_documents(odd).columns == odd.columns


def test_texts_are_cut_in_the_jvm(spark):
    """No whole text goes through Python, where a batch of them takes several times its size."""
    plan = mixing.mix_documents(documents(spark, rows_of(6)), block=8)._jdf.queryExecution().optimizedPlan().toString()
    python = [line for line in plan.splitlines() if "EvalPython" in line]
    assert python and not any("text" in line for line in python)


def test_stretches_hold_what_stands_between(spark):
    """All stretches of a text, however odd its white space is, are what Python's pattern finds."""
    rng = random.Random(7)
    texts = [
        "".join(rng.choice([" ", "\t\n", "\x0b\x0c\r", "\u00a0", "\u2003", "a", "Bc", "\U0001f600", "\u6f22"]) for _ in range(200))
        for _ in range(40)
    ] + ["x " * 30_000 + " " * 200_000]
    rows = []
    for i, text in enumerate(texts):
        n = len(mixing.WORD.findall(text))
        cuts = sorted(rng.sample(range(n + 1), 6))
        rows.append((i, text, [{"start": a, "end": b} for a, b in zip(cuts[::2], cuts[1::2], strict=True)]))
    frame = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:bigint,end:bigint>>")
    found = frame.select("i", mixing._stretches(F.col("text"), F.col("spans")).alias("cut")).collect()
    got = {row["i"]: row["cut"] for row in found}
    for i, text, spans in rows:
        places = [match.span() for match in mixing.WORD.finditer(text)]
        assert got[i] == [text[places[s["start"]][0] : places[s["end"] - 1][1]] for s in spans]


def test_counts_of_groups_need_no_python_rows(spark):
    sources = spark.range(5).selectExpr("id as source_no", "id + 3 as blocks", "id + 3 as whole", "id + 1 as owed", "id * 0 as cut")
    drawn, owed = mixing._drawn(sources, 4, 1, 5)
    assert owed == 15 and drawn.agg(F.sum("n")).first()[0] == 15
    assert "ExistingRDD" not in drawn._jdf.queryExecution().sparkPlan().toString()
