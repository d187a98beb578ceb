import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, documents
from tracelake.llm import toxicity


def edits(a, b):
    """Whether ``b`` can be had from ``a`` with at most one edit: 0, 1 or None."""
    if a == b:
        return 0
    letters = set(a + b)
    one = {a[:i] + a[i + 1 :] for i in range(len(a))}
    one |= {a[:i] + x + a[i:] for i in range(len(a) + 1) for x in letters}
    one |= {a[:i] + x + a[i + 1 :] for i in range(len(a)) for x in letters}
    return 1 if b in one else None


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.text("abc", min_size=2, max_size=6), min_size=1, max_size=5, unique=True),
    st.text("abcd", min_size=1, max_size=8),
    st.booleans(),
)
def test_automaton_against_all_edits(terms, word, ends):
    terms = [term + toxicity.END if ends else term for term in terms]
    got = toxicity.Automaton(terms).hits(word)
    marked, want = word + toxicity.END, {}
    for number, term in enumerate(terms):
        near = [e for n in range(len(marked) + 1) if (e := edits(term, marked[:n])) is not None]
        if near and (min(near) == 0 or len(term) >= toxicity.FUZZY_FROM):
            want[number] = min(near)
    assert got == want


ABUSE = ["grumblet", "snorkwit", "plodface", "dunderhat"]


def made_up(n=500, start=0):
    rng = random.Random(start + 4)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "en", "sa", "vu"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([8, 40, 200]))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(ABUSE) + rng.choice(["", "s", "!"]))
        rows.append((start + i, " ".join(text), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = made_up()
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")
    return toxicity.fit_toxicity_model(labels, documents(spark, [(i, text) for i, text, _ in rows]))


def test_new_documents(spark, model):
    rows = made_up(300, 10_000)
    truth = {i: t for i, _, t in rows}
    docs = documents(spark, [(i, text) for i, text, _ in rows])
    got = docs.select("doc_id", toxicity.toxicity(model, F.col("text")).alias("s")).collect()
    wrong = sum((row["s"] >= model.threshold) != truth[row["doc_id"]] for row in got)
    assert wrong <= 0.01 * len(rows)


def test_misspelled_terms_are_caught(model):
    base = made_up(1, 77_000)[0][1]
    for term in ABUSE:
        for wrong in (term[:3] + term[4:], term[:4] + "x" + term[4:], term[:2] + "z" + term[3:]):
            assert model.score(f"{base} you {wrong} and {wrong} {wrong}") > model.score(base)


def test_quoted_terms_count_less(model):
    base = "ka lo mi ter en sa vu " * 4
    plain, quoted = f"{base}you grumblet go {base}", f'{base}you "grumblet" go {base}'
    assert model.score(base) < model.score(quoted) < model.score(plain)


def test_odd_rows(odd, model):
    got = odd.select(toxicity.toxicity(model, F.col("text")).alias("s")).collect()
    assert len(got) == len(ODD)
    assert all(0 <= row["s"] < model.threshold for row in got)
    assert model.score(None) == model.score("")


def test_empty_tables(spark, empty, odd):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity_model(labels, empty)
    assert {row[0] for row in odd.select(toxicity.toxicity(model, F.col("text")) < 0.01).collect()} == {True}
    assert empty.select(toxicity.toxicity(model, F.col("text"))).collect() == []


def test_terms_after_punctuation_are_met(model):
    clean = made_up(1, 78_000)[0][1]
    for term in ABUSE:
        for text in (f"hey,{term}", f"you/{term}", f"ka...{term}...lo", f"{term},hey", f"ka_{term}", f"x-{term}s"):
            assert model.score(f"{clean} {text} {text}") >= model.threshold > model.score(clean)


@pytest.mark.parametrize("base", [0x4E00, 0x3041, 0x0E01])
def test_terms_in_scripts_without_blanks_are_met(base):
    rng = random.Random(base)
    letters = [chr(base + i) for i in range(40)]
    abuse = ["".join(letters[i : i + 3]) for i in (0, 3, 6)]
    others = letters[9:]

    def page(toxic):
        text = [rng.choice(others) for _ in range(60)]
        for _ in range(3 * toxic):
            text.insert(rng.randrange(1, len(text)), rng.choice(abuse))
        return "".join(text)

    model = toxicity.train([(i % 3 == 0, page(i % 3 == 0)) for i in range(300)])
    for _ in range(50):
        assert model.score(page(True)) >= model.threshold > model.score(page(False))


def test_marks_do_not_begin_a_word():
    assert toxicity.parts("\u092e\u0942\u0930\u094d\u0916") == [(0, 5)] and toxicity.parts("e\u0301te\u0301") == [(0, 5)]
    assert toxicity.parts("a,bc_d\u4f60\u597d") == [(0, 1), (2, 4), (5, 6), (6, 7), (7, 8)]


def swapped(a, b):
    return len(a) == len(b) and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.text("abc", min_size=2, max_size=6), min_size=1, max_size=5, unique=True),
    st.text("abcd", min_size=1, max_size=8),
    st.booleans(),
)
def test_a_swap_is_one_edit(terms, word, ends):
    terms = [term + toxicity.END if ends else term for term in terms]
    got = toxicity.Automaton(terms, swaps=True).hits(word)
    marked, want = word + toxicity.END, {}
    for number, term in enumerate(terms):
        starts = [marked[:n] for n in range(len(marked) + 1)]
        near = [e for x in starts if (e := 1 if swapped(term, x) and term != x else edits(term, x)) is not None]
        if near and (min(near) == 0 or len(term) >= toxicity.FUZZY_FROM):
            want[number] = min(near)
    assert got == want


def test_a_clean_neighbour_hides_only_itself():
    """'runtwik' is a clean word within one edit of the term 'gruntwik'; other misspellings keep their weight."""
    sample = [(t, text + (" runtwik" if not t else "")) for _, text, t in made_up() for text in [text.replace("grumblet", "gruntwik")]]
    model = toxicity.train(sample)
    base = made_up(1, 79_000)[0][1]
    clean = model.score(base)
    assert model.score(f"{base} runtwik runtwik") == pytest.approx(clean, abs=1e-9)
    for wrong in ("grvntwik", "grunntwik", "gruntwk", "grnutwik", "gruntwiks", "hey,gruntw1k"):
        assert model.score(f"{base} {wrong} {wrong}") > clean + 0.1, wrong


@pytest.mark.parametrize("unit", ["gru/mblet/", "snorkwti/", "\u6f22\u5b57snorkwt", "12/", "dunderhta,,,"])
def test_a_long_token_takes_time_in_proportion(model, unit):
    """A megabyte without a blank is one token; its misspelled terms are found without looking back and forth in it."""
    text = unit * (1_000_000 // len(unit.encode()))
    begin = time.perf_counter()
    assert 0 <= model.score(text) <= 1
    toxicity.begins(text)
    assert time.perf_counter() - begin < 10
    assert (model.score(unit * 50) >= model.threshold) == (unit != "12/")  # a sign within a term is an edit, too


def test_model_of_a_task_is_the_model_of_its_sample(spark):
    """Fitting in one task gives what training on the collected sample gives."""
    rows = made_up()
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] * 2, "doc_id bigint, toxic int")
    docs = documents(spark, [(i, text) for i, text, _ in rows])
    sample = toxicity.labelled_sample(labels, docs, "doc_id", F.col("toxic"), "text", 100, 2, 20_000)
    pairs = [tuple(row) for row in sample.collect()]
    assert len(pairs) == 200 and sum(label for label, _ in pairs) == 100
    own, fitted = toxicity.train(pairs), toxicity.fit_toxicity_model(labels, docs, per_label=100)
    assert own.terms == fitted.terms and own.clean == fitted.clean
    texts = [text for _, text, _ in made_up(50, 5000)]
    assert [own.score(text) for text in texts] == [fitted.score(text) for text in texts]
