import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.conftest import ODD, documents
from tests.llm.plain import LOWER
from tracelake.llm import lines, queries

BLANKS = " \t\n\x0b\x0c\r"


def plain_dedup(rows, min_chars=40, min_documents=5):
    """[(key, text left, lines, lines dropped)] of (key, text) rows."""
    keyed = [(i, (text or "").split("\n")) for i, text in rows]
    holders = defaultdict(set)
    for i, found in keyed:
        for line in found:
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= min_chars:
                holders[key] |= {i} - {None}
    out = []
    for i, found in keyed:
        left = []
        for line in found:
            ids = holders.get(line.strip(BLANKS).translate(LOWER), ())
            if len(ids) < min_documents or i == max(ids):
                left.append(line)
        out.append((i, "\n".join(left), len(found), len(found) - len(left)))
    return out


def made_up(seed, n):
    rng = random.Random(seed)
    common = [" ".join(rng.choice("Ab cD éü \U0001f600 好x".split()) for _ in range(rng.randint(5, 30))) for _ in range(12)]
    rows = []
    for i in range(n):
        found = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(common) if rng.random() < 0.6 else f"line {rng.random()} " * rng.randint(1, 4)
            found.append(rng.choice(["", " ", "\t", " "]) + rng.choice([line, line.lower()]) + rng.choice(["", "\r", "  "]))
        rows.append((rng.choice([i, i, i, None, i - 1]), "\n".join(found)))
    return [*rows, *rows[:3], *ODD]


def found(df):
    return sorted(map(repr, df.select("doc_id", "text", "n_lines", "n_dropped").collect()))


def expected(rows, **settings):
    return sorted(f"Row(doc_id={i!r}, text={t!r}, n_lines={n}, n_dropped={d})" for i, t, n, d in plain_dedup(rows, **settings))


def test_made_up_rows_against_the_plain_rule(spark):
    for seed in range(3):
        rows = made_up(seed, 60)
        assert found(lines.dedup_lines(documents(spark, rows))) == expected(rows)
        few = {"min_chars": 10, "min_documents": 2}
        assert found(lines.dedup_lines(documents(spark, rows), **few)) == expected(rows, **few)


def test_the_largest_holder_keeps_every_copy(spark):
    notice = "All rights reserved, and so on and so forth, for ever."
    rows = [(i, f"own text {i}\n{notice}\n {notice.upper()}\t") for i in range(5)]
    left = {r["doc_id"]: r for r in lines.dedup_lines(documents(spark, rows)).collect()}
    assert left[4]["text"] == rows[4][1] and left[4]["n_dropped"] == 0
    assert all(left[i]["text"] == f"own text {i}" and left[i]["n_dropped"] == 2 for i in range(4))
    assert found(lines.dedup_lines(documents(spark, rows[:4]))) == expected(rows[:4])  # four documents are too few


def test_hot_and_seldom_lines_take_both_ways(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_SHARE", 4)
    often, seldom = "a line in every document of the table, " * 2, "a line in a few documents of the table, " * 2
    rows = [(i, f"{often}\n{seldom if i % 9 == 0 else f'own {i} ' * 9}\nend") for i in range(90)]
    assert found(lines.dedup_lines(documents(spark, rows))) == expected(rows)


def test_long_text_keeps_all_other_lines(spark):
    notice = "this very same line stands in all of the documents"
    body = "\n".join(f"{notice}\nline {i} of the document that is a long one" for i in range(30_000))
    rows = [(0, body), *((i, notice) for i in range(1, 5))]
    left = {r["doc_id"]: r for r in lines.dedup_lines(documents(spark, rows)).collect()}
    assert left[0]["n_lines"] == 60_000 and left[0]["n_dropped"] == 30_000
    assert left[0]["text"].count("\n") == 29_999 and notice not in left[0]["text"]
    assert [left[i]["text"] for i in range(1, 5)] == ["", "", "", notice]


def test_clashing_columns_are_kept_or_replaced(spark, empty):
    rows = [(1, "a"), (None, None)]
    clashing = documents(spark, rows)
    for name in ("lines", "line", "print", "place", "dropped", "id", "row", "largest", "uses", "N_LINES"):
        clashing = clashing.withColumn(name, F.lit("mine"))
    cleaned = lines.dedup_lines(clashing)
    assert found(cleaned) == expected(rows)
    assert all(r["print"] == r["largest"] == r["row"] == "mine" for r in cleaned.collect())
    assert lines.dedup_lines(empty).collect() == []


def test_native_plan(spark):
    plan = lines.dedup_lines(documents(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_query_has_the_contracts_columns(spark, tmp_path):
    rows = made_up(7, 40)
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    result = queries.op12_line_dedup(spark, str(tmp_path))
    assert result.dtypes == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in plain_dedup(rows)]
    assert sorted(map(repr, map(tuple, result.collect()))) == sorted(map(repr, want))
