"""How filters act on each other in every order: decision diagrams over the masks of failed filters.

Documents are counted by part and mask first; a part is then at most 2^k rows, which become one count-weighted decision
diagram. Swapping neighbouring levels leads from one order of the filters to the next, and the path on which every filter
passes tells what each step of that order removes.
"""

from collections.abc import Callable, Iterable, Iterator
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.staging import staged
from tracelake.llm.lines import fingerprint

#: k filters have k! orders, each of them k rows for every part.
MOST_FILTERS = 7
_PARTS_AT_ONCE = 20

# Words are runs of characters other than ASCII white space.
_BLANKS = r"[\x20\x09-\x0D]+"
_STRIPPED = " \t\n\x0b\x0c\r"


class Node:
    """Documents that go one way or the other at a filter; weight: counts of all of them."""

    __slots__ = ("passes", "fails", "weight")

    def __init__(self, passes: "Node | None", fails: "Node | None", weight: tuple[int, ...]):
        self.passes, self.fails, self.weight = passes, fails, weight


class Diagram:
    """A decision diagram with a level for each filter, whose ends carry the counts of one mask.

    Parts of the diagram that are alike are one node, so masks that no document has take one node for each level.
    """

    def __init__(self, filters: int, counts: dict[int, tuple[int, ...]]):
        self.order = list(range(filters))
        self.levels: list[dict[tuple[int, int], Node]] = [{} for _ in self.order]
        none = tuple(0 for _ in next(iter(counts.values())))
        ends: dict[tuple[int, ...], Node] = {}

        def grown(level: int, mask: int) -> Node:
            if level == filters:
                weight = counts.get(mask, none)
                return ends.setdefault(weight, Node(None, None, weight))
            return self._node(level, grown(level + 1, mask), grown(level + 1, mask | 1 << level))

        self.root = grown(0, 0)

    def _node(self, level: int, passes: Node, fails: Node) -> Node:
        nodes, branches = self.levels[level], (id(passes), id(fails))
        if branches not in nodes:
            nodes[branches] = Node(passes, fails, tuple(map(add, passes.weight, fails.weight)))
        return nodes[branches]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next one.

        A node of the upper level stands for the same documents before and after, so it stays and only its branches are
        made anew; the nodes above need no change.
        """
        upper = list(self.levels[level].values())
        old = self.levels[level + 1]  # kept alive until all is rebuilt: nodes are told apart by identity
        self.levels[level], self.levels[level + 1] = {}, {}
        for node in upper:
            one, two = node.passes, node.fails
            node.passes = self._node(level + 1, one.passes, two.passes)
            node.fails = self._node(level + 1, one.fails, two.fails)
            self.levels[level][id(node.passes), id(node.fails)] = node
        del old
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) along the path on which every filter passes."""
        node = self.root
        for tested in self.order:
            yield tested, node.passes.weight, node.fails.weight
            node = node.passes


def neighbour_swaps(n: int) -> list[int]:
    """Where to exchange neighbours, one after the other, so that ``n`` things stand in every order once."""
    if n < 2:
        return []
    inner, swaps = neighbour_swaps(n - 1), []
    for i in range(len(inner) + 1):
        swaps += range(n - 2, -1, -1) if i % 2 == 0 else range(n - 1)
        if i < len(inner):
            swaps.append(inner[i] + (i % 2 == 0))  # the last thing stands in front after an even sweep
    return swaps


def audited(names: str, counts: dict[int, tuple[int, ...]]) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, shapley, further counts removed) of one part."""
    diagram = Diagram(len(names), counts)
    failing = [sum(weight[0] for mask, weight in counts.items() if mask >> i & 1) for i in range(len(names))]
    unique = [counts[1 << i][0] if 1 << i in counts else 0 for i in range(len(names))]
    shapley, found = [0] * len(names), []
    swaps = iter(neighbour_swaps(len(names)))
    while True:
        order = "".join(names[i] for i in diagram.order)
        for step, (tested, kept, removed) in enumerate(diagram.steps(), 1):
            shapley[tested] += removed[0]
            found.append((order, step, tested, kept[0], removed))
        level = next(swaps, None)
        if level is None:
            break
        diagram.swap(level)
    return [
        (order, step, kept, removed[0], failing[i] - removed[0], unique[i], shapley[i], *removed[1:])
        for order, step, i, kept, removed in found
    ]


def filter_interactions(masks: DataFrame, part: str, names: str, lost: dict[str, str]) -> DataFrame:
    """What every filter does at every step of every order, for each part.

    ``masks`` has ``part``, ``mask`` (bit i: the i-th of ``names``, one letter each, fails), ``rows`` (how many documents
    the row stands for) and the columns that ``lost`` names: how many of them count for a further result.

    Returns part, filter_order, step and the counts kept, removed, redundant, unique_fails, shapley and those of ``lost``.
    Rows are summed by part and mask before they meet, so a part with a third of all documents is 2^k rows like any other.
    A null mask or count counts as 0; a null part is a part. An empty table gives an empty result.
    """
    if not 1 <= len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"1 to {MOST_FILTERS} filters with different letters")
    counts = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ["rows", *lost.values()]]
    summed = masks.groupBy(F.col(part).alias("part"), F.coalesce("mask", F.lit(0)).alias("mask")).agg(*counts)
    each = F.struct("mask", F.array("rows", *lost.values()).alias("counts"))
    parts = summed.groupBy("part").agg(F.collect_list(each).alias("masks"))  # 2^k entries at most
    numbers = ["kept", "removed", "redundant", "unique_fails", "shapley", *lost]
    columns = ["part", "filter_order", "step", *numbers]
    schema = f"part {masks.schema[part].dataType.simpleString()}, filter_order string, step int, " + ", ".join(
        f"{c} bigint" for c in numbers
    )
    rows = parts.mapInPandas(_all_orders(names, columns), schema)
    return rows.withColumnRenamed("part", part)


def _all_orders(names: str, columns: list[str]) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = []
            for name, masks in zip(batch["part"], batch["masks"]):
                counts = {entry["mask"]: tuple(map(int, entry["counts"])) for entry in masks}
                held += [(name, *row) for row in audited(names, counts)]
                if len(held) >= _PARTS_AT_ONCE * 120:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=columns)

    return run


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions on a text alone: too few words, too few different ones, too many capitals, a symbol."""
    content = F.coalesce(text, F.lit(""))
    stripped = F.btrim(content, F.lit(_STRIPPED))
    words = F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, _BLANKS))
    n, different = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 200,
        "B": 100 * different.cast("bigint") < 50 * n.cast("bigint"),
        "C": 100 * F.regexp_count(content, F.lit("[A-Z]")).cast("bigint") > 2 * F.char_length(content).cast("bigint"),
        "D": F.regexp_like(content, F.lit("[#$%&*|]")),
    }


def document_masks(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, rows, good, toxic): documents counted by source, failed filters A to E, and labels.

    E fails where a smaller key has the same text, anywhere in the table. part is the source, null as an empty string.

    - Null texts count as empty. A null key is smaller than none and larger than none, and has no label; a key's rows in
      ``labels`` are good (toxic) if one of them is. Rows with the same key and text are that many documents.
    - Rows that agree in everything are counted before they are sent, and rows without key are dealt out by their texts,
      so neither a text nor a missing key that a third of all rows share meets in one task. Whether a row is the first of
      its text is asked by text and key together.
    - Texts are read whole and only once; the rest works on some fifty bytes for each document.
    """
    failures = text_failures(F.col(text))
    mask = sum((failed.cast("int") * (1 << i) for i, failed in enumerate(failures.values())), F.lit(0))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    narrow = documents.select(
        F.col(key).alias("id"),
        source.alias("part"),
        mask.alias("mask"),
        fingerprint(F.coalesce(F.col(text), F.lit(""))).alias("print"),
    )
    counted = staged(narrow.groupBy("id", "part", "mask", "print").agg(F.count(F.lit(1)).alias("rows")), "masks")
    firsts = counted.where("id is not null").groupBy("print").agg(F.min("id").alias("id"))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"))
    known = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    spread = F.when(F.col("id").isNull(), F.xxhash64("print")).otherwise(F.lit(0))
    repeated = F.col("id").isNotNull() & F.col("first").isNull()
    joined = (
        counted.withColumn("deal", spread)
        .join(firsts.withColumn("first", F.lit(True)), ["print", "id"], "left")
        .join(known.withColumn("deal", F.lit(0).cast("bigint")), ["id", "deal"], "left")
    )
    return joined.select(
        "part",
        (F.col("mask") + F.when(repeated, 1 << len(failures)).otherwise(0)).alias("mask"),
        "rows",
        F.when(F.col("good"), F.col("rows")).otherwise(0).alias("good"),
        F.when(F.col("toxic"), F.col("rows")).otherwise(0).alias("toxic"),
    )
