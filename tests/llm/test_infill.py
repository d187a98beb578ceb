import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.conftest import ODD, documents
from tracelake.llm import infill, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(key, text, seed=42, rate=50, spm_rate=80):
    """(output, n, form, prefix_chars, middle_chars) by the rule."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return text, len(units), "plain", None, None
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", len(units), "spm", len(prefix), len(middle)
    return f"<P>{prefix}<S>{suffix}<M>{middle}", len(units), "psm", len(prefix), len(middle)


def made_up(seed, n):
    rng = random.Random(seed)
    pieces = ["a", "Bc", "é", "\U0001f600", "你好", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", " ", "<", "<P", "S>", "M>", "$1", "\\", "{2}"]
    return [(rng.choice([i, i, -i, None]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for i in range(n)]


MARKED = [(100, "has <P> in it"), (101, "<S>"), (102, "x<M>"), (103, "<p> <s> <m> are no sentinels"), (104, "<<P <S <M")]


def test_made_up_texts_against_the_plain_rule(spark):
    rows = [*made_up(1, 300), *ODD, *MARKED]
    for settings in ({}, {"seed": 7, "rate": 100, "spm_rate": 0}, {"rate": 100, "spm_rate": 100}, {"rate": 0}):
        made = infill.infill(documents(spark, rows), **settings)
        got = made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars").collect()
        want = [(key, *plain_infill(key, text, **settings)) for key, text in rows]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_every_output_gives_its_text_back(spark):
    rows = [(i, text) for i, (_, text) in enumerate([*made_up(2, 400), *ODD, *MARKED])]
    made = infill.infill(documents(spark, rows), rate=100, spm_rate=50)
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = made.select("doc_id", infill.restored(F.col("text"), F.col("form")).alias("back")).collect()
    assert {r["doc_id"]: r["back"] for r in back} == {i: text or "" for i, text in rows}


def test_very_long_texts_neither_overflow_nor_get_lost(spark):
    texts = ["word \n" * 300_000, "x" * 2_000_000, " " * 1_000_000, "你" * 500_000 + " a b" * 200_000]
    rows = [(i, texts[i % 4]) for i in range(12)]
    made = infill.infill(documents(spark, rows), rate=100)
    got = made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {key: plain_infill(key, text, rate=100) for key, text in rows}


def test_clashing_columns_and_an_empty_table(spark, empty):
    clashing = documents(spark, [(1, "a b c"), (2, None)])
    for name in ("content", "output", "h1", "a", "b", "row", "N", "Form"):
        clashing = clashing.withColumn(name, F.lit("mine"))
    rows = {r["doc_id"]: r for r in infill.infill(clashing).collect()}
    for key, text in ((1, "a b c"), (2, None)):
        assert tuple(rows[key][c] for c in ("text", "n", "form", "prefix_chars", "middle_chars")) == plain_infill(key, text)
        assert rows[key]["output"] == rows[key]["h1"] == rows[key]["row"] == "mine"
    assert infill.infill(empty).collect() == []


def test_query_has_the_contracts_columns(spark, tmp_path):
    rows = [*made_up(3, 50), *ODD, *MARKED]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    result = queries.op13_infill(spark, str(tmp_path))
    counts = [("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint")]
    assert result.dtypes == [("doc_id", "bigint"), *counts, ("output_sha256", "string"), ("restored_sha256", "string")]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for key, text in rows:
        output, *found = plain_infill(key, text)
        want.append((key, *found, sha(output), sha(text or "")))
    assert sorted(map(repr, map(tuple, result.collect()))) == sorted(map(repr, want))
