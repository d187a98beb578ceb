"""Quality rules: a hashed n-gram likelihood ratio between trusted text and the whole corpus.

Tokens (runs of letters and digits, and runs of other visible characters) and pairs of neighbouring tokens are hashed into a
fixed number of buckets. Two multinomials are counted over them: one over the trusted documents, one over all. A document's
score is the mean over its n-grams of log(trusted share / corpus share), and every document is held against the same
threshold.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_REMEMBERED = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ASSESSED = T.StructType([*(T.StructField(name, T.LongType()) for name in MEASURES), T.StructField("ratio", T.DoubleType())])


class Hashes:
    """64-bit hashes of tokens; remembers a bounded number of them."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _REMEMBERED:
            known.clear()
        found = []
        for token in tokens:
            value = known.get(token)
            if value is None:
                known[token] = value = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
            found.append(value)
        return np.array(found, dtype=np.uint64)


def ngram_buckets(text: str, hashes: Hashes, bits: int) -> np.ndarray:
    """Buckets of all tokens and pairs of neighbouring tokens of a text, lower-cased."""
    one = hashes.of(_TOKEN.findall(text.lower()))
    shift = np.uint64(64 - bits)
    pairs = (one[:-1] * np.uint64(3) ^ (one[1:] >> np.uint64(7))) * _MIX
    return np.concatenate([(one * _MIX) >> shift, pairs >> shift]).astype(np.int64)


def repeated_words(words: list[str], hashed: np.ndarray, window: int) -> int:
    """How many words lie in a window of words that the text has twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        mixed = (mixed ^ hashed[i : n + i]) * _MIX
        mixed ^= mixed >> np.uint64(31)
    _, inverse, counts = np.unique(mixed, return_inverse=True, return_counts=True)
    alike = np.flatnonzero(counts[inverse] > 1)
    if not len(alike):
        return 0
    places: dict[tuple, list[int]] = {}
    for i in alike.tolist():
        places.setdefault(tuple(words[i : i + window]), []).append(i)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for found in places.values():
        if len(found) > 1:
            np.add.at(edges, found, 1)
            np.add.at(edges, np.array(found) + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None, hashes: Hashes, window: int = 5) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text; a null text has no words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            again += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), chars, symbols, again, repeated_words(words, hashes.of(words), window)


@dataclass
class RatioModel:
    """log(trusted share / corpus share) of every bucket."""

    ratios: np.ndarray
    bits: int
    threshold: float

    def score(self, text: str | None, hashes: Hashes) -> float:
        """The mean ratio over a whole text's n-grams; 0 for a text without any."""
        if not text:
            return 0.0
        buckets = ngram_buckets(text, hashes, self.bits)
        return float(self.ratios[buckets].mean()) if len(buckets) else 0.0


def count_ngrams(documents: DataFrame, trusted: Column, bits: int, text: str = "text") -> DataFrame:
    """bucket, corpus and trusted counts over all documents. A null ``trusted`` counts as false, a null text as empty.

    Every task adds its documents up in two arrays and hands on its buckets once, so the shuffle has at most 2^bits rows from
    a task, whatever it read.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, size = Hashes(), 1 << bits
        corpus, target = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for batch in batches:
            for content, good in zip(batch["text"], batch["good"], strict=True):
                if isinstance(content, str) and content:
                    buckets = ngram_buckets(content, hashes, bits)
                    found = np.bincount(buckets, minlength=size) if len(buckets) > 4096 else None
                    for counts, wanted in ((corpus, True), (target, good)):
                        if wanted and found is not None:
                            counts += found
                        elif wanted:
                            np.add.at(counts, buckets, 1)
        used = np.flatnonzero(corpus)
        yield pd.DataFrame({"bucket": used, "corpus": corpus[used], "trusted": target[used]})

    rows = documents.select(F.col(text).alias("text"), F.coalesce(trusted, F.lit(False)).alias("good"))
    partial = rows.mapInPandas(add, "bucket bigint, corpus bigint, trusted bigint")
    return partial.groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted"))


def count_by_ids(documents: DataFrame, ids: DataFrame, bits: int, key: str, text: str = "text", filter_bits: int = 24) -> DataFrame:
    """``count_ngrams`` of documents whose key is one of ``ids`` (one column of that name), without a shuffle of all texts.

    The ids become a bit set of fixed size (at most 2^(filter_bits - 6) broadcast rows of two numbers, however many ids there
    are). Documents that it lets pass are counted as trusted in the one pass over all texts. Those that it lets pass wrongly
    are counted again and taken off, so the result is exact: their keys come from a join of keys alone, and only texts that a
    second bit set, of these keys, lets pass are shuffled. Ids and keys that are null meet nothing; repeated ids count once,
    repeated documents each for itself.
    """
    wanted = ids.select(F.col(key).alias("key")).where("key is not null").distinct()
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    passed = _marked(rows, _bit_set(wanted, filter_bits, "first"), filter_bits, "first")
    keys = _marked(rows.select("key"), _bit_set(wanted, filter_bits, "first"), filter_bits, "first").where("marked").select("key")
    wrong = keys.distinct().join(wanted, "key", "left_anti")
    suspects = passed.where("marked").drop("marked")
    suspects = _marked(suspects, _bit_set(wrong, filter_bits, "second"), filter_bits, "second").where("marked")
    again = count_ngrams(suspects.join(wanted.hint("shuffle_hash"), "key", "left_anti"), F.lit(True), bits)
    both = count_ngrams(passed, F.col("marked"), bits).unionByName(
        again.select("bucket", F.lit(0).cast("bigint").alias("corpus"), (-F.col("trusted")).alias("trusted"))
    )
    return both.groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted"))


def _bit(salt: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("key", F.lit(salt)), 64 - bits)


def _bit_set(keys: DataFrame, bits: int, salt: str) -> DataFrame:
    """(word, mask): the bits of all keys' hashes, 64 to a row."""
    bit = _bit(salt, bits)
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))
    return keys.select(F.floor(bit / 64).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def _marked(rows: DataFrame, bit_set: DataFrame, bits: int, salt: str) -> DataFrame:
    """The rows with ``marked``: whether the bit of the row's key is set. A null key's is not."""
    bit = _bit(salt, bits)
    found = rows.withColumn("word", F.floor(bit / 64)).join(F.broadcast(bit_set), "word", "left")
    is_set = F.call_function("getbit", F.col("mask"), (bit % 64).cast("int")) == 1
    return found.select(*rows.columns, F.coalesce(F.col("key").isNotNull() & is_set, F.lit(False)).alias("marked"))


def fit_ratio_model(
    documents: DataFrame, trusted: Column, bits: int = 13, threshold: float = -0.15, prior: float = 4.0, text: str = "text"
) -> RatioModel:
    """Count both multinomials over all documents; the trusted one is smoothed by ``prior`` corpus n-grams a bucket.

    The driver gets 2^bits rows at most. Without trusted n-grams every ratio is 0.
    """
    return ratio_model(count_ngrams(documents, trusted, bits, text), bits, threshold, prior)


def fit_ratio_model_by_ids(
    documents: DataFrame,
    ids: DataFrame,
    key: str = "doc_id",
    bits: int = 13,
    threshold: float = -0.15,
    prior: float = 4.0,
    text: str = "text",
) -> RatioModel:
    """``fit_ratio_model`` where the trusted documents are those whose key is among ``ids``."""
    return ratio_model(count_by_ids(documents, ids, bits, key, text), bits, threshold, prior)


def ratio_model(counts: DataFrame, bits: int, threshold: float, prior: float) -> RatioModel:
    """The model of the counts that ``count_ngrams`` gives."""
    corpus, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for row in counts.toLocalIterator():
        corpus[row["bucket"]], target[row["bucket"]] = row["corpus"], row["trusted"]
    ratios = np.zeros(1 << bits, dtype=np.float64)
    if target.sum():
        raw = (corpus + 1) / (corpus + 1).sum()
        good = target + raw * len(raw) * prior
        ratios = np.log(good / good.sum() / raw)
    return RatioModel(ratios, bits, threshold)


def assess(model: RatioModel, text: Column) -> Column:
    """The measures of ``measure`` (bigint) and the ratio of a whole text, as a struct. Null and empty texts have 0 in all.

    Texts are read whole, however long; repeated rows are assessed each for itself, and other columns play no part.
    """

    @F.pandas_udf(ASSESSED)
    def assessed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in texts:
            known = [content if isinstance(content, str) else None for content in batch]
            found = pd.DataFrame([measure(content, hashes) for content in known], columns=MEASURES, dtype="int64")
            found["ratio"] = np.array([model.score(content, hashes) for content in known], dtype=np.float64)
            yield found

    return assessed(text)


def base_failed(found: Column) -> Column:
    """Too short to judge, or more than a fifth of its words repeated."""
    return (found["n_words"] < 10) | (100 * found["n_repeat_words"] > 20 * found["n_words"])


def kept(model: RatioModel, found: Column) -> Column:
    """Every document that passes the base rules is held against the model's threshold."""
    return ~base_failed(found) & (found["ratio"] >= model.threshold)
