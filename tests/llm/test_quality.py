import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import plain
from tests.llm.conftest import ODD, documents, prose
from tracelake.llm import quality


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#|é\x0b\x1c"), max_size=120))
def test_measures(text):
    assert quality.measure(text, quality.Hashes()) == plain.measures(text)


def assessed(docs, trusted):
    model = quality.fit_ratio_model(docs, trusted)
    found = F.col("found")
    rows = docs.select("doc_id", "text", quality.assess(model, F.col("text")).alias("found"))
    return rows.select("doc_id", "text", "found.*", quality.base_failed(found).alias("failed"), quality.kept(model, found).alias("kept"))


def test_odd_rows(spark, odd):
    rows = assessed(odd, F.col("doc_id") == 9).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        assert tuple(row[name] for name in quality.MEASURES) == plain.measures(row["text"])
        assert not (row["failed"] and row["kept"])
        if not row["text"]:
            assert row["ratio"] == 0 and row["failed"]


def test_empty_table(empty):
    assert assessed(empty, F.lit(True)).collect() == []


def test_counts_are_of_all_documents(spark):
    rows = prose(3, 60)
    docs = documents(spark, rows)
    got = {r["bucket"]: (r["corpus"], r["trusted"]) for r in quality.count_ngrams(docs, F.col("doc_id") % 3 == 0, 8).collect()}
    want = {}
    hashes = quality.Hashes()
    for doc, text in rows:
        for bucket in quality.ngram_buckets(text, hashes, 8).tolist():
            corpus, trusted = want.get(bucket, (0, 0))
            want[bucket] = (corpus + 1, trusted + (doc % 3 == 0))
    assert got == want


@pytest.mark.parametrize("filter_bits", [6, 9, 24])
def test_counts_by_ids_are_those_by_a_flag(spark, filter_bits):
    rows = [*prose(4, 300), (None, "a b c"), (None, None), (7, "again and again"), (7, "again and again"), (5000, "")]
    docs = documents(spark, rows)
    good = [i for i, _ in rows if i is not None and i % 3 == 0] + [7, 7, None, 99999]
    ids = spark.createDataFrame([(i, "x") for i in good], "doc_id bigint, text string")
    counts = quality.count_by_ids(docs, ids, 8, "doc_id", filter_bits=filter_bits)
    flag = F.coalesce(F.col("doc_id").isin([i for i in good if i is not None]), F.lit(False))
    key = lambda r: r["bucket"]
    assert sorted(counts.collect(), key=key) == sorted(quality.count_ngrams(docs, flag, 8).collect(), key=key)


def test_counts_by_ids_of_empty_tables(spark, empty, odd):
    ids = spark.createDataFrame([(1,)], "doc_id bigint")
    assert quality.count_by_ids(empty, ids, 8, "doc_id").collect() == []
    assert all(r["trusted"] == 0 for r in quality.count_by_ids(odd, ids.limit(0), 8, "doc_id").collect())


def test_score_is_the_mean_ratio(spark):
    """The score and the verdict, from counted buckets by the definition."""
    rows = prose(8, 120)
    docs = documents(spark, rows)
    got = {row["doc_id"]: row for row in assessed(docs, F.col("doc_id") % 2 == 0).collect()}
    hashes = quality.Hashes()
    found = {doc: quality.ngram_buckets(text, hashes, 13).tolist() for doc, text in rows}
    corpus = Counter(b for buckets in found.values() for b in buckets)
    target = Counter(b for doc, buckets in found.items() if doc % 2 == 0 for b in buckets)
    total = sum(corpus.values()) + 8192
    share = {b: (corpus[b] + 1) / total for b in range(8192)}
    raised = {b: target[b] + share[b] * 8192 * 4.0 for b in share}
    whole = sum(raised.values())
    ratio = {b: math.log(raised[b] / whole / share[b]) for b in share}
    for doc, buckets in found.items():
        want = sum(ratio[b] for b in buckets) / len(buckets) if buckets else 0.0
        assert math.isclose(got[doc]["ratio"], want, abs_tol=1e-9)
        if abs(want + 0.15) > 1e-9:
            assert got[doc]["kept"] == (not got[doc]["failed"] and want > -0.15)


def test_junk_goes_and_clean_text_stays(spark):
    good = [(i, text) for i, text in prose(5, 300) if len(text.split()) > 20]
    junk = [(1000 + i, " ".join(f"{word}%%%" for word in text.split())) for i, text in good[:40]]
    rows = assessed(documents(spark, good + junk), F.col("doc_id") < 200).collect()
    clean = [row for row in rows if row["doc_id"] < 1000 and not row["failed"]]
    assert all(row["kept"] for row in clean)
    assert not any(row["kept"] for row in rows if row["doc_id"] >= 1000)


def test_without_trusted_text_nothing_is_judged(spark):
    rows = assessed(documents(spark, prose(6, 30)), F.lit(False)).collect()
    assert all(row["ratio"] == 0 and row["kept"] != row["failed"] for row in rows)
