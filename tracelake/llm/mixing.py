"""Mixing sources to target weights.

Every source's documents are laid end to end and packed into blocks of a fixed length. Each output shard draws how many
blocks it takes from every source, from a multinomial over what the sources still owe. A source's slots are numbered
over all shards and mapped to blocks by a pseudorandom permutation of the block numbers, once per pass over the source,
and the blocks are joined by their numbers. Of the last block that a source gives, only as much is taken as it still owes.
"""

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.staging import staged
from tracelake.llm.numbering import numbered_runs, running_before, runs_for

MIXED = 0x9E3779B97F4A7C15  # fixed value: the 64-bit golden ratio that is usual for spreading bits

SLOTS_PER_RUN = 1 << 16
#: Sources with more than this part of all documents meet them by a broadcast: there can be no more of them.
HOT_SHARE = 1000
#: Up to so many sources are drawn on the driver one by one, more in groups.
DRAWN_TOGETHER = 1024
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\t\n\x0b\x0c\r"
#: A word and what follows it up to the next; without a way back, so a run of white space is read once.
WORD_AND_SPACE = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def even_counts(total: int, shards: int) -> np.ndarray:
    """``total`` over the shards, equal but for one more or less."""
    return np.array([(total + shard) // shards for shard in range(shards)], dtype=np.int64)


def drawn_counts(owed: np.ndarray, wanted: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Slots by output shard and source: ``wanted`` of each shard, drawn by a multinomial whose weights are what the sources
    still owe. No source gives more than that, and together they owe just what is wanted, so the sums are exactly ``owed``."""
    owed = owed.astype(np.int64).copy()
    counts = np.zeros((len(wanted), len(owed)), dtype=np.int64)
    for shard, left in enumerate(wanted.tolist()):
        while left:
            drawn = np.minimum(random.multinomial(left, owed / owed.sum()), owed)
            counts[shard] += drawn
            owed -= drawn
            left -= int(drawn.sum())
    return counts


def draw_counts(owed: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """``drawn_counts`` for shards with equal numbers of slots, one more or less."""
    random = np.random.Generator(np.random.PCG64(seed))
    return drawn_counts(owed, even_counts(int(owed.sum()), shards), random)


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1 for every seed, by a four-round Feistel network over the next power
    of four; what falls outside is sent through again until it falls inside."""
    half = np.ones(len(size), dtype=np.uint64)
    bits = np.ceil(np.log2(np.maximum(size, 2).astype(np.float64))).astype(np.uint64)
    half = np.maximum(half, (bits + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, size, seed = index.astype(np.uint64), size.astype(np.uint64), seed.astype(np.uint64)
    todo = np.arange(len(value))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, s, v = half[todo], mask[todo], seed[todo], value[todo]
            left, right = v >> h, v & m
            for turn in range(4):
                f = (right + s + np.uint64(turn + 1) * np.uint64(MIXED)) * np.uint64(MIXED)
                f ^= f >> np.uint64(29)
                f *= np.uint64(MIXED)
                left, right = right, left ^ ((f >> np.uint64(32)) & m)
            value[todo] = left << h | right
            todo = todo[value[todo] >= size[todo]]
    return value.astype(np.int64)


@F.pandas_udf(T.LongType())
def _permuted(index: pd.Series, size: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), seed.to_numpy()))


def source_table(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source_no, source, source_size, uses, target) of every source; uses: its documents.

    Sources are numbered in the order of their names by code point, null last. Together they share ``share`` times all
    sizes by weight; a share stops at ``most`` times its source's size, and the excess is shared again by weight. Sources
    without a positive weight or size get 0. If all sources stop, the rest stays unshared.

    Sources stop in the order of size by weight. Running sums in that order tell for each whether it would stop if all
    before it had, and the first that would not gives the level of all that are left. However many sources there are, the
    driver sees only the sum of all sizes and that level.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"), F.count("*").alias("uses"))
    by_name = [F.col("source").isNull(), F.col("source")]
    named = staged(numbered_runs(sums.withColumn("one", F.lit(0)), by_name, "run"), "mix-sources")
    numbered = running_before(named, ["one"], F.col("run"), by_name, F.lit(1).cast("bigint"), "source_no")
    turn = (F.col("source_no") % len(weights)).cast("int")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    limit = F.lit(float(most)) * F.col("source_size")
    shares = (F.col("source_size") > 0) & (weight > 0)
    weighed = staged(
        numbered.select(
            "source_no", "source", "source_size", "uses", "one", turn.alias("turn"), weight.alias("weight"),
            F.when(shares, limit / weight).alias("stops_at"),
        ),
        "mix-weights",
    )
    of_turn = [F.sum(F.when(F.col("turn") == i, 1).otherwise(0)).alias(f"turn_{i}") for i in range(len(weights))]
    levels = weighed.where("stops_at is not null").groupBy("one", "stops_at").agg(F.sum("source_size").alias("size"), *of_turn)
    levels = staged(numbered_runs(levels, [F.col("stops_at")], "run"), "mix-levels")
    open_ = weighed.where("stops_at is not null").agg(F.sum("weight").alias("weight")).first()["weight"]
    total = weighed.agg(F.sum("source_size").alias("size")).first()["size"]
    for name in ("size", *(f"turn_{i}" for i in range(len(weights)))):
        levels = running_before(levels, ["one"], F.col("run"), [F.col("stops_at")], F.col(name), f"{name}_before")
    weight_before = sum((F.col(f"turn_{i}_before") * float(w) for i, w in enumerate(weights)), F.lit(0.0))
    shared, open_ = F.lit(share * float(total or 0)), F.lit(float(open_ or 0))
    level = ((shared - F.lit(float(most)) * F.col("size_before")) / (open_ - weight_before)).alias("level")
    found = levels.select("stops_at", level).where("level < stops_at").agg(F.min(F.struct("stops_at", "level")).alias("at"))
    at = found.first()["at"]
    stops = F.lit(True) if at is None else F.col("stops_at") < at["stops_at"]
    target = F.when(stops, limit).otherwise(F.lit(0.0 if at is None else at["level"]) * F.col("weight"))
    target = F.when(F.col("stops_at").isNull(), F.lit(0.0)).otherwise(target)
    return staged(weighed.select("source_no", "source", "source_size", "uses", target.alias("target")), "mix-targets")


def _planned(sources: DataFrame, block: int) -> DataFrame:
    """What each source gives: (source_no, blocks, whole, owed, cut).

    A pass over a source takes all its ``blocks`` once: the ``whole`` ones and then what is left at its end. ``owed`` counts
    the blocks of all passes; of the last one only the first ``cut`` units are taken, if that is not 0. So a source gives
    its target to the unit.
    """
    size, unit = F.col("source_size"), F.lit(block).cast("bigint")
    div = lambda a, b: F.call_function("div", a, b)
    wanted = F.round("target").cast("bigint")
    whole = div(size, unit)
    blocks = whole + (size % unit > 0).cast("bigint")
    rest = wanted % size
    owed = div(wanted, size) * blocks + div(rest, unit) + (rest % unit > 0).cast("bigint")
    giving = sources.where((size > 0) & (wanted > 0))
    return giving.select(
        "source_no", blocks.alias("blocks"), whole.alias("whole"), owed.alias("owed"), (rest % unit).alias("cut")
    )


def _drawn(planned: DataFrame, shards: int, seed: int, sources: int) -> tuple[DataFrame, int]:
    """(source_no, blocks, whole, owed, cut, shard, first, n): which slots of a source each shard takes; and all slots.

    Sources are dealt into groups, about as many as the root of their number. The driver draws the counts of the groups,
    and a task for each group those of its sources, so the counts are a multinomial over all sources. Up to
    ``DRAWN_TOGETHER`` sources are a group each.
    """
    groups = max(DRAWN_TOGETHER, math.isqrt(sources))
    grouped = planned.withColumn("group", F.pmod("source_no", F.lit(groups)))
    sums = sorted((r["group"], r["owed"]) for r in grouped.groupBy("group").agg(F.sum("owed").alias("owed")).collect())
    counts = draw_counts(np.array([owed for _, owed in sums], dtype=np.int64), shards, seed)
    totals = {"group": [group for group, _ in sums], "wanted": [counts[:, i].tolist() for i in range(len(sums))]}
    types = pa.schema([("group", pa.int64()), ("wanted", pa.list_(pa.int64()))])
    totals = planned.sparkSession.createDataFrame(pa.table(totals, schema=types))  # as rows it would go through Python workers
    columns = planned.columns

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_no", ignore_index=True)
        random = np.random.Generator(np.random.PCG64([seed, int(rows["group"][0])]))
        found = drawn_counts(rows["owed"].to_numpy(), np.array(rows["wanted"][0], dtype=np.int64), random)
        firsts = np.cumsum(found, axis=0) - found
        shard, row = np.nonzero(found)
        drawn = rows.loc[row, columns].reset_index(drop=True)
        return drawn.assign(shard=shard.astype(np.int32), first=firsts[shard, row], n=found[shard, row])

    schema = ", ".join(f"{c} bigint" for c in columns) + ", shard int, first bigint, n bigint"
    return grouped.join(totals, "group").groupBy("group").applyInPandas(draw, schema), sum(owed for _, owed in sums)


def mix_sources(
    documents: DataFrame,
    size: Column,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 64,
    shards: int = 16,
    seed: int = 20,
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """Every span of a document that the mix takes, once for each time it takes it; spans that it does not take, and
    documents without a size, have a row without a shard.

    Columns: key, size, source, source_size, target, row (tells rows with the same key apart; it is the document's place
    in its source), start and length (the span, in units of ``size``), shard, place (in the shard, together with other
    spans of the same block) and copy (0, 1, ...: which pass over the source).

    - ``size`` is a whole number of 0 or more; null counts as 0. ``weights`` repeat over the sources in the order of
      their names by code point, null last; together they share ``share`` times all sizes, each at most ``most`` times
      its source's size. A source gives its target to the unit, rounded, however small it is.
    - At most ceil(``most``) passes go over a source, so no document is taken more often.
    - A rerun over the same rows gives the same mix, in whatever order they are read. Rows that are equal in key and size
      are told apart only by place. Other columns play no part. An empty table gives an empty mix.
    - There may be as many sources as documents. Sources with more than one in ``HOT_SHARE`` of all documents, of which
      there are ``HOT_SHARE`` at most, meet their documents by a broadcast, all others in a shuffle.
    """
    sized = documents.select(
        F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size")
    )
    sized = staged(sized, "mix-sizes")
    sources = source_table(sized, weights, share, most)
    number = sources.count()
    numbered = _with_sources(sized, sources)
    run = F.pmod(F.xxhash64("key"), F.lit(runs_for(sized.count())))
    laid = running_before(numbered, ["source_no"], run, [F.col("key"), F.col("size")], F.col("size"), "row")

    ends = F.col("row") + F.col("size")
    first, final = F.floor(F.col("row") / block), F.floor((ends - 1) / block)
    pieces = (
        laid.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, final))))
        .withColumn("__from", F.greatest(F.col("row"), F.col("block") * block))
        .withColumn("__to", F.least(ends, (F.col("block") + 1) * block))
    )

    drawn, owed = _drawn(_planned(sources, block), shards, seed, number)
    drawn = staged(drawn, "mix-draws")
    ends_at = F.col("first") + F.col("n")
    runs = drawn.withColumn("at", F.explode(F.sequence(F.col("first"), ends_at - 1, F.lit(SLOTS_PER_RUN)))).withColumn(
        "until", F.least(ends_at, F.col("at") + SLOTS_PER_RUN) - 1
    )
    slots = runs.repartition(1 + owed // (8 * SLOTS_PER_RUN), "source_no", "at").select(
        "source_no", "blocks", "whole", "owed", "cut", "shard", F.explode(F.sequence("at", "until")).alias("slot")
    )
    copy, place = F.call_function("div", F.col("slot"), F.col("blocks")), F.col("slot") % F.col("blocks")
    pass_seed = F.hash("source_no", copy, F.lit(seed)).cast("bigint")
    among = F.greatest(F.col("whole"), F.lit(1))
    mapped = _permuted(F.least(place, among - 1), among, pass_seed)  # what is left at a source's end is the last of a pass
    partial = (F.col("slot") == F.col("owed") - 1) & (F.col("cut") > 0)
    picked = slots.select(
        "source_no",
        "shard",
        copy.alias("copy"),
        F.when(place < F.col("whole"), mapped).otherwise(F.col("whole")).alias("block"),
        F.when(partial, F.col("cut")).otherwise(block).alias("upto"),
        F.xxhash64("source_no", "slot", F.lit(seed)).alias("place"),
    )
    # Before they are counted out, slots look few enough to broadcast; they are as many as the mix has blocks.
    joined = pieces.join(picked.hint("merge"), ["source_no", "block"], "left")
    stop = F.least("__to", F.col("block") * block + F.coalesce("upto", F.lit(block)))
    is_taken = F.col("shard").isNotNull() & (F.col("__from") < stop)
    return joined.select(
        F.col("key").alias(key),
        "size",
        "source",
        "source_size",
        "target",
        "row",
        (F.col("__from") - F.col("row")).alias("start"),
        (F.when(is_taken, stop).otherwise(F.col("__to")) - F.col("__from")).alias("length"),
        *(F.when(is_taken, F.col(c)).alias(c) for c in ("shard", "place", "copy")),
    )


def _with_sources(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """The documents with number, size and target of their source."""
    known = sources.withColumnRenamed("source", "name")
    hot = F.col("uses") > F.lit(sized.count() / HOT_SHARE)
    often, seldom = F.broadcast(known.where(hot)), known.where(~hot)
    same = F.col("source").eqNullSafe(F.col("name"))
    columns = ["key", "size", "source", "source_no", "source_size", "target"]
    rest = sized.join(often, same, "left_anti")
    return sized.join(often, same).select(*columns).unionByName(rest.join(seldom, same).select(*columns))


def taken(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document of ``mix_sources``: key, size, source, source_size, target and the units taken.

    Documents of size 0 that are equal in key are one group with their number of rows kept.
    """
    used = F.when(F.col("shard").isNotNull(), F.col("length")).otherwise(0)
    columns = [key, "size", "source", "source_size", "target", "row"]
    sums = mixed.groupBy(*columns).agg(F.sum(used).alias("taken"), F.count("*").alias("__n"))
    copies = F.when(F.col("size") == 0, F.col("__n")).otherwise(1).cast("int")
    return sums.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).drop("__n", "__copy", "row")


def _stretches(text: Column, spans: Column) -> Column:
    """The texts of all ``spans`` (start and end, in words): from the first word to the last, with what stands between.

    The text is cut into words once for all of them, in the JVM: batches of texts as Python values would take the
    executor several times their size.
    """
    words = F.regexp_extract_all(text, F.lit(WORD_AND_SPACE), F.lit(0))

    def stretch(cut: Column, span: Column) -> Column:
        inside = F.slice(cut, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        return F.rtrim(F.array_join(inside, ""), F.lit(SPACE))

    # The outer function gives the words a name, or they would be found again for every span.
    return F.flatten(F.transform(F.array(words), lambda cut: F.transform(spans, lambda span: stretch(cut, span))))


def mix_documents(
    documents: DataFrame, block: int = 256, text: str = "text", length: str = "n_chars", **settings
) -> DataFrame:
    """The mix as documents, in the columns of ``documents``: a row for each pass over a document and each stretch of
    neighbouring blocks that the pass takes, with the words of that stretch.

    A document that is taken whole keeps its text as it is. ``length``, if there is such a column, is the new text's. Sizes
    are words; ``settings`` go to ``mix_sources``. Documents without words are not part of a mix.
    """
    hashed = documents.withColumn("__row", F.xxhash64(*[F.col(f"`{name}`") for name in documents.columns]))
    size = F.regexp_count(F.col(text), F.lit(WORD.pattern))
    mixed = mix_sources(hashed, size, block=block, key="__row", **settings).where("shard is not null")
    spans = F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"))).cast(
        "array<struct<start:bigint,end:bigint>>"
    )
    taken_spans = (
        mixed.groupBy("__row", "row", "copy", F.col("size").alias("__size"))
        .agg(spans.alias("spans"))
        .select("__row", "__size", F.aggregate("spans", F.slice(one, 1, 0), _joined_spans).alias("__spans"))
    )
    all_of_it = (F.col("__spans")[0]["start"] == 0) & (F.col("__spans")[0]["end"] == F.col("__size"))
    texts = F.when(all_of_it, F.array(text)).otherwise(_stretches(F.col(text), F.col("__spans")))
    whole = hashed.where(size > 0).dropDuplicates(["__row"])
    out = taken_spans.join(whole, "__row").withColumn("__texts", texts).drop(text).withColumn(text, F.explode("__texts"))
    if length in documents.columns:
        out = out.withColumn(length, F.length(text).cast(documents.schema[length].dataType))
    return out.select(*documents.columns)


def _joined_spans(done: Column, span: Column) -> Column:
    """Spans so far, with one more: it draws out the last one if it begins where that ends."""
    last = F.element_at(done, -1)
    longer = F.struct(last["start"].alias("start"), span["end"].alias("end"))
    touches = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] == span["start"])
    front = F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))
    return F.when(touches, F.concat(front, F.array(longer))).otherwise(F.concat(done, F.array(span)))
