import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """A documents table of (doc_id, text) or (doc_id, text, lang, source) rows, with columns whose names clash."""
    full = [(*row, None, "a") if len(row) == 2 else row for row in rows]
    known = [(i, t, lang, source, None if t is None else len(t), 1, "x", "y") for i, t, lang, source in full]
    clashing = "shard int, component_id string, score string"
    return spark.createDataFrame(known, f"{DOCUMENTS}, {clashing}").repartition(3)


#: Nulls, empty and blank texts, long ones, ties, repeated rows.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (None, "one two three four five six seven"),
    (None, None),
    (4, "one two three four five six seven"),
    (4, "one two three four five six seven"),
    (5, "word"),
    (6, "a b"),
    (7, "x y z w " * 4000),
    (8, "!!! ??? ---"),
    (9, "Été \U0001f600 你好 naïve"),
    (-5, "negative keys are keys"),
]


def prose(seed, n, words=400):
    """(doc_id, text) rows of made-up prose with copies and near copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            base = rng.choice(rows)[1].split(" ")
            if rng.random() < 0.7:
                for _ in range(rng.randint(1, 3)):
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                base += [rng.choice(vocabulary) for _ in range(rng.randint(1, 20))]
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 8, 30, 60, 150])))))
    rng.shuffle(rows)
    return rows


@pytest.fixture()
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture()
def empty(spark):
    return documents(spark, []).limit(0)
