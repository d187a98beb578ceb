import random

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, documents
from tests.llm.plain import remainder
from tracelake.llm import language

SYLLABLES = {"xx": "an be co de er fi ga".split(), "yy": "schu keit ung ver lich".split(), "zz": "éau ment tion què oi".split()}


def made_up(n=240):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([3, 40, 200]))]
        rows.append((i, " ".join(words), lang, "s"))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    docs = documents(spark, made_up())
    kept = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    return language.fit_language_model(docs.where(kept), per_lang=80)


def predicted(docs, model):
    found = language.language(model, F.col("text"))
    return docs.select("doc_id", "text", "lang", found.alias("found")).select("doc_id", "text", F.col("lang").alias("truth"), "found.*").collect()


def test_held_out_documents(spark, model):
    rows = [r for r in predicted(documents(spark, made_up()), model) if remainder(r["doc_id"], 4) == 2]
    assert len(rows) > 30
    assert sum(r["lang"] == r["truth"] for r in rows) >= 0.97 * len(rows)
    assert sum(r["accepted"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(odd, model):
    rows = predicted(odd, model)
    assert len(rows) == len(ODD)
    for row in rows:
        if not any(char.isalpha() for char in row["text"] or ""):
            assert (row["lang"], row["score"], row["accepted"]) == ("und", 0.0, False)
        else:
            assert row["lang"] in SYLLABLES


def test_whole_text_counts(model):
    text = "an be co " * 10 + "schukeit ungver lichkeit " * 30_000
    assert model.predict([text])[0] == ["yy"]


def test_chunks_add_up(model, monkeypatch):
    text = made_up()[7][1] * 5
    whole = model.mean(text)
    monkeypatch.setattr(language, "_CHUNK", 37)
    assert abs(model.mean(text) - whole).max() < 1e-6


def test_empty_tables(empty, odd):
    model = language.fit_language_model(empty)
    assert predicted(empty, model) == []
    assert {r["lang"] for r in predicted(odd, model)} == {"und"}
