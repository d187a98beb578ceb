import numpy as np
import pytest

from tracelake.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, rank int"


def exact(rows, every, k):
    """{query: [(vec_id, score)]} by comparing everything."""
    found = {}
    for key, vector in rows:
        if key % every == 0:
            q = np.array(vector, dtype=np.float32).astype(float)
            near = [(other, float((np.array(v, dtype=np.float32).astype(float) * q).sum())) for other, v in rows if other != key]
            found[key] = sorted(near, key=lambda x: (-x[1], x[0]))[:k]
    return found


def table(spark, rows):
    return spark.createDataFrame([(k, v, 0, 1.0, 2) for k, v in rows], SCHEMA)


def asked(spark, rows, **settings):
    found = {}
    for row in ann.nearest(table(spark, rows), **settings).orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    for near in found.values():
        assert [rank for rank, _, _ in near] == list(range(1, len(near) + 1))
    return {q: [(key, score) for _, key, score in near] for q, near in found.items()}


@pytest.mark.parametrize("unit", [True, False])
def test_recall(spark, unit):
    rng = np.random.default_rng(5)
    points = rng.normal(0, 1, (1500, 24)) + rng.normal(0, 2, (12, 24))[rng.integers(0, 12, 1500)]
    points = points / np.linalg.norm(points, axis=1, keepdims=True) * (1 if unit else rng.uniform(0.5, 3, (1500, 1)))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    got, want = asked(spark, rows, shard_rows=400, block=30), exact(rows, 20, 20)
    assert set(got) == set(want)
    recall = [len({k for k, _ in got[q]} & {k for k, _ in want[q]}) / 20 for q in want]
    assert np.mean(recall) >= 0.97
    for q in want:
        known = {k: s for k, s in exact([(q, dict(rows)[q]), *[r for r in rows if r[0] in dict(got[q])]], q or 1, 99)[q]}
        assert all(abs(known[k] - s) < 1e-12 for k, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_few_rows_are_exact_with_copies_and_ties(spark):
    rng = np.random.default_rng(6)
    common = rng.normal(0, 1, 8).tolist()
    rows = [(i, common if i % 3 else rng.normal(0, 1, 8).tolist()) for i in range(120)]
    got, want = asked(spark, rows, every=5, k=7, shard_rows=50), exact(rows, 5, 7)
    assert set(got) == set(want)
    for q in want:
        assert [k for k, _ in got[q]] == [k for k, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_odd_rows(spark):
    good = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(1, 30)]
    bad = [(20, None), (40, [0.0, 0.0, 0.0]), (60, [1.0, None, 2.0]), (80, [1.0, float("nan"), 1.0]), (100, [float("inf"), 1.0, 1.0])]
    bad += [(None, [1.0, 1.0, 1.0]), (120, []), (140, [1.0, 2.0])]
    good = [r for r in good if r[0] != 20] + [(200, [1.0, 1.0, 1.0])]
    got, want = asked(spark, good + bad + [good[0], good[-1]]), exact(good, 20, 20)
    assert set(got) == set(want) == {200}
    assert [k for k, _ in got[200]] == [k for k, _ in want[200]]
    assert [len(x) for x in asked(spark, good[:5] + [(0, [2.0, 1.0, 1.0])]).values()] == [5]


def test_empty_and_lonely(spark):
    assert asked(spark, []) == {}
    assert asked(spark, [(0, [1.0, 2.0])]) == {}


def test_graph_is_flat_and_walks_reach_it():
    rng = np.random.default_rng(7)
    v = rng.normal(0, 1, (700, 10)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    levels = np.sort(rng.geometric(0.9, 700) - 1)[::-1]
    graph = ann.build(v, levels, 8, 32)
    assert graph.links.shape == (700, 16) and [len(t) for t in graph.upper] == [int((levels >= i + 1).sum()) for i in range(levels.max())]
    for i, near in enumerate(graph.links):
        near = near[near >= 0]
        assert i not in near and len(set(near.tolist())) == len(near) > 0
    found = ann.search(graph, v, 32)
    assert (found[:, 0] == np.arange(700)).mean() > 0.99


@pytest.mark.parametrize("factor, extra", [(1.0, [4e6]), (1e200, []), (1e-200, []), (1.0, [1e150, 1e-150, 300.0])])
def test_numbers_of_any_size(spark, factor, extra):
    """Neither long vectors among short ones nor very large or small numbers cost recall."""
    rng = np.random.default_rng(8)
    points = rng.normal(0, 1, (800, 16))
    points = np.vstack([points / np.linalg.norm(points, axis=1, keepdims=True), *(rng.normal(0, size, (1, 16)) for size in extra)])
    data = [(i, (p * factor).tolist()) for i, p in enumerate(points)]
    wide = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = {}
    for row in ann.nearest(wide, shard_rows=400).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    sims = points @ points.T
    np.fill_diagonal(sims, -np.inf)
    want = {q: set(np.argsort(-sims[q], kind="stable")[:20].tolist()) for q in range(0, len(points), 20)}
    assert set(got) == set(want)
    assert np.mean([len(got[q] & want[q]) / 20 for q in want]) >= 0.97


def test_rows_of_one_key_are_rows_of_their_own(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(60)]
    rows.append((20, rng.normal(0, 1, 8).tolist()))
    found = ann.nearest(table(spark, rows), k=60).where("query_id = 20").collect()
    values = [np.array(v, dtype=np.float32).astype(float) for _, v in rows]
    want = []
    for at in (20, 60):
        near = sorted((-float((values[i] * values[at]).sum()), rows[i][0]) for i in range(61) if i != at)
        want += [(rank, name) for rank, (_, name) in enumerate(near, 1)]
    assert sorted((r["rank"], r["vec_id"]) for r in found) == sorted(want)
