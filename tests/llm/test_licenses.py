import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, documents, prose
from tracelake.llm import licenses


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit_license_model(documents(spark, prose(11, 200)), paragraphs=600)


def scanned(docs, model):
    found = docs.select("doc_id", "text", licenses.scan_paragraphs(model, F.col("text")).alias("found"))
    return found, found.select("doc_id", "text", "found", *licenses.summary(found)).collect()


def alike(words, family):
    best, own = 0.0, set(words)
    for notice in licenses.NOTICES[family]:
        known = set(licenses.split_words(notice))
        met = len(own & known)
        best = max(best, met / max(4, len(own)), met / max(4, len(known)))
    return best


def test_columns_compute_what_the_model_says(spark, model):
    rng = random.Random(2)
    notices = [n for many in licenses.NOTICES.values() for n in many] + list(licenses.OTHERS)
    rows = [(i, "\n".join(rng.sample(notices, 3) + ["", text, text[: len(text) // 2]])) for i, text in prose(12, 60)]
    for row in scanned(documents(spark, rows), model)[1]:
        want = []
        for place, paragraph in enumerate((row["text"] or "").split("\n")):
            words = licenses.split_words(paragraph)
            if not words:
                continue
            name, score = model.classify(words)
            if name == licenses.NONE:
                continue
            near = 0.0 if name == licenses.OTHER else alike(words, name)
            sure = score >= model.least_score and near >= model.least_alike
            want.append((place, paragraph, name if sure else "unknown", score, near))
        got = [tuple(found) for found in row["found"]]
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(math.isclose(g[3], w[3], rel_tol=1e-9) and math.isclose(g[4], w[4]) for g, w in zip(got, want, strict=True))


def test_families_and_plain_text(spark, model):
    rows, truth = [], {}
    for family, notices in licenses.NOTICES.items():
        for notice in notices:
            truth[len(rows)] = family
            rows.append((len(rows), f"some plain words before it\n{notice}\nand after"))
    plain = [(1000 + i, text) for i, text in prose(13, 150)]
    got = {row["doc_id"]: row for row in scanned(documents(spark, rows + plain), model)[1]}
    assert sum(got[i]["license"] == family for i, family in truth.items()) >= 0.95 * len(truth)
    assert sum(got[i]["license"] != "none" for i, _ in plain) <= 2


def test_unknown_wording_is_no_family(spark, model):
    texts = ["All rights reserved. No part of this publication may be reproduced without prior written permission.", licenses.OTHERS[3]]
    got = scanned(documents(spark, list(enumerate(texts))), model)[1]
    assert {row["licenses"] for row in got} == {""}


def test_native(spark, model):
    found, _ = scanned(documents(spark, [(1, "a")]), model)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_odd_rows_and_empty_table(odd, empty, model):
    rows = scanned(odd, model)[1]
    assert len(rows) == len(ODD)
    assert {(row["license"], row["licenses"], row["n_license_paragraphs"], row["score"]) for row in rows} == {("none", "", 0, 0.0)}
    assert scanned(empty, licenses.fit_license_model(empty))[1] == []
