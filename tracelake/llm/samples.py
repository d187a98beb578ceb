"""Bounded samples of labelled rows, and classifiers that one task fits on them."""

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(
    labels: DataFrame, documents: DataFrame, key: str, label: Column, text: str, per_label: int, most_labels: int, chars: int
) -> DataFrame:
    """(label, text) of at most ``per_label`` documents for each of the ``most_labels`` most frequent labels.

    Those with the smallest hash of their key are taken, so a sample is the same in every run, whatever the partitions.
    Hashes are even: a bound worked out from a label's rows leaves about twice as many as are wanted, and only these meet
    to be ranked, however many rows a label has. A key that is labelled alike more than once counts once.
    Texts are cut to ``chars`` characters from a place that the key's hash chooses. Null labels, keys and texts are left
    out. ``labels`` and ``documents`` may be the same table.
    """
    marks = labels.select(F.col(key).alias("key"), label.alias("label")).where("key is not null and label is not null")
    top = marks.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_labels)
    hashed = F.xxhash64("key", F.lit("sample"))
    place = (hashed.cast("double") + 2.0**63) / 2.0**64
    near = marks.join(F.broadcast(top), "label").where(place * F.col("count") <= 2 * per_label + 1000)  # top: most_labels rows
    order = F.expr("row_number() over (partition by label order by hashed, key)")
    chosen = (
        near.select("key", "label", hashed.alias("hashed"))
        .distinct()
        .withColumn("place", order)
        .where(F.col("place") <= per_label)
        .select("key", "label", "hashed")
    )
    content = F.col("text")
    start = F.pmod(F.col("hashed"), F.greatest(F.lit(1), F.length(content) - chars + 1)).cast("int") + 1
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    return (
        texts.join(F.broadcast(chosen), "key")  # at most per_label x most_labels rows of three columns
        .select("label", F.substring(content, start, F.lit(chars)).alias("text"), "hashed")
        .orderBy("hashed", "text", "label")
        .limit(per_label * most_labels)
        .select("label", "text")
    )


def fitted(sample: DataFrame, train: Callable, kind: type):
    """The model, an instance of the dataclass ``kind``, that ``train`` makes of a bounded sample's (label, text) pairs.

    One task reads the sample and trains; the driver gets only the finished model's fields (those that are compared).
    """

    def fit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [row for batch in batches for row in zip(batch["label"].tolist(), batch["text"].tolist())]
        model = train(rows)
        state = {f.name: getattr(model, f.name) for f in fields(model) if f.compare}
        yield pd.DataFrame({"model": [pickle.dumps(state)]})

    found = sample.coalesce(1).mapInPandas(fit, "model binary").collect()  # one row
    return kind(**pickle.loads(found[0]["model"])) if found else train([])
