import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import ODD, documents, prose
from tracelake.llm import packing
from tracelake.llm.queries import tokenizer_file


def unfolded(plan):
    """{sequence: [(offset, length)]} and the ranks used of every length."""
    sequences, ranks = {}, {}
    for length, first, count, many, at, offset in plan.uses:
        for i in range(count * many):
            sequences.setdefault(at + i // many, []).append((offset + i % many * length, length))
            ranks.setdefault(length, []).append(first + i)
    return sequences, ranks


def gapless(found, capacity):
    end = 0
    for offset, length in sorted(found):
        assert offset == end
        end += length
    assert end <= capacity


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plans_are_whole(case):
    capacity, lengths = case
    counts = {x: lengths.count(x) for x in lengths}
    plan = packing.pack_lengths(counts, capacity)
    sequences, ranks = unfolded(plan)
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items()}
    assert sorted(sequences) == list(range(plan.sequences))
    for found in sequences.values():
        gapless(found, capacity)


def fewest(lengths, capacity):
    """The least number of sequences, by trying everything."""
    best = [len(lengths)]

    def place(rest, rooms):
        if len(rooms) >= best[0]:
            return
        if not rest:
            best[0] = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= rest[0] and room not in rooms[:i]:
                place(rest[1:], [*rooms[:i], room - rest[0], *rooms[i + 1 :]])
        place(rest[1:], [*rooms, capacity - rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 20).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=9))))
def test_reduction_keeps_the_optimum(case):
    capacity, lengths = case
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = packing.Plan()
    packing.reduce_by_dominance(counts, capacity, plan)
    rest = [x for x in range(capacity + 1) for _ in range(int(counts[x]))]
    assert plan.sequences + fewest(rest, capacity) == fewest(lengths, capacity)


def test_large_instances_are_near_the_bound():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 1025, 50_000), np.minimum(1024, rng.geometric(0.004, 50_000))):
        plan = packing.pack_lengths(dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True)), strict=True)), 1024)
        assert plan.sequences <= 1.004 * lengths.sum() / 1024 + 1


def test_cut():
    assert packing.cut(3, 4) == [(0, 3)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.fixture(scope="module")
def tokens():
    return packing.Tokens(tokenizer_file())


def test_fast_ids_are_the_library_ids(tokens):
    texts = [t for _, t in prose(1, 80)] + [t for _, t in ODD if t]
    texts += ["I'll they've it's 12 345 x² ½ ß ÿ Ā ­ ɏ", "a  b   c\n\n d\t\te \r\n ", "<|endoftext|>", "a<|b", "€“”…", "\x00\x1f\x85"]
    for text in texts:
        assert tokens.ids(text) == tokens.exact.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x30FF, exclude_categories=["Cs"]), max_size=60))
def test_fast_ids_of_any_text(text):
    global _TOKENS
    try:
        known = _TOKENS
    except NameError:
        known = _TOKENS = packing.Tokens(tokenizer_file())
    assert known.ids(text) == known.exact.encode(text, add_special_tokens=False).ids


def test_documents(spark, tokens):
    rows = prose(2, 150) + ODD + [(i + 5000, "same text") for i in range(40)]
    got = packing.pack_documents(documents(spark, rows), tokenizer_file(), capacity=64).collect()
    want = []
    for key, text in rows:
        ids = np.array([*tokens.exact.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for piece, (start, length) in enumerate(packing.cut(len(ids), 64)):
            want.append((str(key), piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(want)
    sequences = {}
    for row in got:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for found in sequences.values():
        gapless(found, 64)
    assert len(sequences) <= 1.05 * sum(w[3] for w in want) / 64 + 1


def test_empty_table(empty):
    assert packing.pack_documents(empty, tokenizer_file()).collect() == []


def test_few_texts_are_python_values_at_once(spark, monkeypatch):
    """Texts reach Python in small batches, whatever the session's setting, which stays as it is."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(name), packing.staged
    monkeypatch.setattr(packing, "staged", lambda df, to: seen.append(int(spark.conf.get(name))) or write(df, to))
    docs = documents(spark, [(i, "some words", "en", "a") for i in range(1500)])
    out = packing.pack_documents(docs, tokenizer_file())
    assert out.count() == 1500 and seen == [1000] and spark.conf.get(name) == before
    plan = packing.cut_documents(docs, tokenizer_file(), 2, 1024)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
