import random
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, documents
from tests.llm.plain import WORD
from tracelake.llm import audit, queries

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def plain_failures(rows):
    """{position: letters of the failed filters} of (key, text) rows."""
    first = {}
    for key, text in rows:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    failed = []
    for key, text in rows:
        text = text or ""
        words = WORD.findall(text)
        tests = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": key is not None and key > first[text],
        }
        failed.append("".join(letter for letter, fails in tests.items() if fails))
    return failed


def plain_audit(documents, names):
    """Rows of COLUMNS from (part, failed letters, good, toxic), one filter after the other."""
    found = {}
    for part in {d[0] for d in documents}:
        mine = [d for d in documents if d[0] == part]
        for order in permutations(names):
            left = mine
            for step, name in enumerate(order, 1):
                gone, left = [d for d in left if name in d[1]], [d for d in left if name not in d[1]]
                failing = sum(name in d[1] for d in mine)
                unique = sum(d[1] == name for d in mine)
                lost = sum(d[2] for d in gone), sum(d[3] for d in gone)
                found[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), unique, *lost]
        for name in names:
            steps = [key for key in found if key[0] == part and key[1][key[2] - 1] == name]
            total = sum(found[key][1] for key in steps)
            for key in steps:
                found[key].append(total)
    return sorted((*key, *counts) for key, counts in found.items())


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in audit.neighbour_swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n))))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5).flatmap(lambda k: st.tuples(st.just(k), st.lists(st.tuples(st.integers(0, 2**k - 1), st.booleans()), min_size=1, max_size=30))))
def test_diagram_against_filtering(case):
    k, rows = case
    names = "ABCDE"[:k]
    counts = {}
    for mask, good in rows:
        n, g = counts.get(mask, (0, 0))
        counts[mask] = (n + 1, g + good)
    want = plain_audit([("p", "".join(names[i] for i in range(k) if m >> i & 1), g, 0) for m, g in rows], names)
    got = [("p", o, s, kept, gone, again, unique, good, 0, sh) for o, s, kept, gone, again, unique, sh, good in audit.audited(names, counts)]
    assert sorted(got) == want


def test_a_swap_keeps_the_diagram_reduced():
    rng = random.Random(3)
    diagram = audit.Diagram(5, {rng.randrange(32): (rng.randint(1, 3),) for _ in range(6)})
    total = diagram.root.weight
    for at in audit.neighbour_swaps(5):
        diagram.swap(at)
        assert diagram.root.weight == total
        for level, nodes in enumerate(diagram.levels):
            assert 1 <= len(nodes) <= 2**level
            assert len({(id(n.passes), id(n.fails)) for n in nodes.values()}) == len(nodes)
            assert all(tuple(map(sum, zip(n.passes.weight, n.fails.weight))) == n.weight for n in nodes.values())


def made_up(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "d#lta", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([0, 3, 100, 200, 260]))]
        text = rng.choice([" ".join(words), " ".join(f"w{j}" for j in range(220)), rows[-1][1] if rows else None])
        rows.append((rng.choice([i, i, i, None, i - 1]), text, "en", rng.choice(["a", "a", "b", None])))
    return rows


def table_of(spark, rows, marks):
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int, source string, mask int")
    return documents(spark, rows), labels


@pytest.mark.parametrize("seed", [1, 2])
def test_made_up_documents_against_filtering(spark, seed, tmp_path):
    odd = [(key, text, None, "odd") for key, text in ODD]
    rows = [*made_up(seed, 120), *odd]
    rng = random.Random(seed)
    marks = [(rng.choice([i, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x", 3) for i in range(-1, 100)]
    marks += marks[:20] + [(i, 1, 1, "y", 4) for i in range(5)]
    docs, labels = table_of(spark, rows, marks)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    result = queries.op11_filter_audit(spark, str(tmp_path))
    good = {m[0] for m in marks if m[1] == 1 and m[0] is not None}
    toxic = {m[0] for m in marks if m[2] == 1 and m[0] is not None}
    failed = plain_failures([row[:2] for row in rows])
    want = plain_audit([(r[3] or "", f, r[0] in good, r[0] in toxic) for r, f in zip(rows, failed)], "ABCDE")
    assert sorted(map(tuple, result.select(COLUMNS).collect())) == want
    types = dict(result.dtypes)
    assert types.pop("part") == types.pop("filter_order") == "string" and types.pop("step") == "int"
    assert set(types.values()) == {"bigint"}


def test_masks_of_any_filters(spark):
    masks = spark.createDataFrame(
        [(1, 0, 5, 1), (1, 3, 2, 2), (None, 1, 4, 0), (None, None, 1, None)], "site int, mask int, rows bigint, n bigint"
    )
    got = audit.filter_interactions(masks, "site", "xy", {"n_lost": "n"}).orderBy("site", "filter_order", "step").collect()
    assert [tuple(r) for r in got if r["site"] is None][:2] == [(None, "xy", 1, 1, 4, 0, 4, 8, 0), (None, "xy", 2, 1, 0, 0, 0, 0, 0)]
    assert [tuple(r) for r in got if r["site"] == 1][:2] == [(1, "xy", 1, 5, 2, 0, 0, 2, 2), (1, "xy", 2, 5, 0, 2, 0, 2, 0)]
    assert audit.filter_interactions(masks.limit(0), "site", "xy", {}).collect() == []
    with pytest.raises(ValueError):
        audit.filter_interactions(masks, "site", "xx", {})


def test_empty_table_and_clashing_columns(spark, empty):
    docs, labels = table_of(spark, [(1, "a"), (2, "a")], [(1, 1, 0, "z", 1)])
    assert audit.document_masks(empty, labels).collect() == []
    for name in ("id", "part", "mask", "print", "rows", "first", "deal", "good", "toxic"):
        docs, labels = docs.withColumn(name, F.lit("mine")), labels if name in ("toxic", "mask") else labels.withColumn(name, F.lit("mine"))
    masks = audit.document_masks(docs, labels).collect()
    assert sorted((r["part"], r["mask"], r["rows"], r["good"]) for r in masks) == [("a", 1, 1, 1), ("a", 17, 1, 0)]
