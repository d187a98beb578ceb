import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import plain
from tracelake.functions.staging import new_path, staged

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, FOLDER), "step")
        found.append((name, docs, out))
        docs = out
    return found


def test_columns_stay_but_for_the_last(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns


def test_filters_take_rows_as_they_are(steps):
    for _, before, after in steps[:3]:
        assert after.exceptAll(before).count() == 0 and after.count() > 0


def test_toxic_documents_go_and_clean_ones_stay(steps, spark):
    _, before, after = steps[1]
    toxic = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    left = {row["doc_id"] for row in after.collect()}
    labelled = before.join(toxic, "doc_id").collect()
    clean = [row["doc_id"] in left for row in labelled if not row["toxic"]]
    assert sum(clean) >= 0.97 * len(clean)


def test_one_of_each_group_is_left(steps):
    _, before, after = steps[2]
    rows = [(row["doc_id"], row["text"]) for row in before.collect()]
    members, _ = plain.components(rows, 5, 80)
    want = {min(rows[i][0] for i in group) for group in members.values()}
    assert {row["doc_id"] for row in after.collect()} == want


def test_mix_keeps_targets(steps):
    _, before, after = steps[3]
    size = lambda row: len(plain.WORD.findall(row["text"] or ""))
    sizes, taken = {}, {}
    for table, sums in ((before, sizes), (after, taken)):
        for row in table.collect():
            sums[row["source"]] = sums.get(row["source"], 0) + size(row)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = plain.targets([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    assert all(abs(taken.get(n, 0) - t) <= 256 for n, t in zip(names, wanted, strict=True))


def test_sequences_hold_all_pieces(steps):
    _, before, after = steps[4]
    assert after.where("piece = 0").count() == before.count()
    sums = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert sums.where("n != end or n > 1024").count() == 0


def test_odd_documents(spark, odd):
    """Nulls, empty and repeated rows and clashing columns go through every stage; so does an empty table."""
    folder = new_path(spark, "odd")
    odd.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0), (None, 1), (4, None)], "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() >= 0
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, folder)
            assert out.count() >= 0
            assert name == "best-fit packing" or out.columns == table.columns
