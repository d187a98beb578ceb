import random

import numpy as np
import pytest

from tests.llm import plain
from tests.llm.conftest import ODD, documents, prose
from tracelake.llm import jaccard


def check(spark, rows, size=4, percent=85):
    members, sizes = plain.components(rows, size, percent)
    want = sorted(
        (key, n, min((rows[j][0] for j in members[i]), default=None)) for i, ((key, _), n) in enumerate(zip(rows, sizes, strict=True))
    )
    got = sorted(tuple(row) for row in jaccard.jaccard_components(documents(spark, rows), size, percent).collect())
    assert got == want
    return want


@pytest.mark.parametrize("seed", [1])
def test_same_as_all_pairs(spark, seed):
    want = check(spark, prose(seed, 250))
    assert sum(key != component for key, _, component in want) > 30


def test_other_sizes(spark):
    check(spark, prose(4, 120), 2, 60)


def test_blocks_and_strays(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):  # one family whose members are linked through each other, some far from the others
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            words[rng.randrange(60)] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    check(spark, rows + [(100 + i, text) for i, (_, text) in enumerate(rows[:3])])


def test_odd_rows(spark, odd):
    rows = [tuple(row) for row in jaccard.jaccard_components(odd).collect()]
    assert len(rows) == len(ODD)
    found = {(key, n, component) for key, n, component in rows}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 0, None), (None, 4, 4), (4, 4, 4), (5, 1, 5), (6, 1, 6)} <= found


def test_empty_table(empty):
    assert jaccard.jaccard_components(empty).collect() == []
    assert jaccard.one_of_each(empty).collect() == []


def test_one_of_each(spark):
    rows = prose(8, 150) + [(200, None), (200, None), (201, ""), (None, "alone in the world it is")]
    rows += [(7000, "repeated row of six words")] * 3
    docs = documents(spark, rows)
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    members, _ = plain.components(rows, 5, 80)
    groups = {frozenset(m) for m in members.values()}
    kept = sorted((row["doc_id"] is None, row["doc_id"] or 0) for row in left.collect())
    want = sorted(min((rows[i][0] is None, rows[i][0] or 0) for i in group) for group in groups)
    assert kept == want


def test_linked_labels_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sets, base = [], rng.integers(0, 500, 40)
        for _ in range(25):
            keep = base[rng.random(40) > rng.choice([0.0, 0.05, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(500, 9000, rng.integers(0, 5))])).astype(np.uint64))
        label = jaccard.linked_labels(sets, 85)
        want = np.arange(25)
        for i in range(25):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    want[want == max(want[i], want[j])] = min(want[i], want[j])
        assert label.tolist() == want.tolist()


def test_nodes_that_share_many_keys_meet_once(spark):
    """Signatures are sent once for each set of nodes, not once for each key that they share."""
    rows = [(key, node) for key in range(50) for node in (1, 2)] + [(key, node) for key in (90, 91) for node in (2, 1, 3)]
    met = {}
    for row in jaccard._met_together(spark.createDataFrame(rows, "key bigint, node bigint")).collect():
        met.setdefault(row["met"], []).append(row["node"])
    assert sorted(sorted(nodes) for nodes in met.values()) == [[1, 2], [1, 2, 3]]


def test_marks_spare_no_row_that_is_asked_for(spark):
    """Marks are at most 2^16 rows, not a number for each print in the driver, and texts are told by them without Python."""
    edges = [(-(1 << 63),), (-1,), (0,), (63,), (64,), ((1 << 63) - 1,)]
    prints = spark.createDataFrame(edges, "print bigint").union(spark.range(300_000).selectExpr("xxhash64(id) as print"))
    marks = jaccard._marks(prints)
    assert marks.count() <= 1 << 16
    others = spark.range(300_000, 310_000).selectExpr("xxhash64(id) as print")
    plan = jaccard._marked(others, marks, "print", "marked")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan
    assert jaccard._marked(prints, marks, "print", "marked").where("not marked").count() == 0
    few = jaccard._marked(others, jaccard._marks(prints.limit(1000)), "print", "marked").where("marked")
    assert few.count() < 100
