"""N-gram Jaccard join with prefix trees.

Word n-grams are hashed to 64 bits and put into one global order, rare ones first as far as counts in a fixed number of
buckets tell. Two sets that are similar enough share one of their first few n-grams, and their bit signatures differ in few
places; groups of sets are tied together by these. Each group is joined by a prefix tree: its sets, common n-grams first, become a trie, all
probes walk it together, share the overlap of a common path, and leave a subtree that cannot reach the overlap they need.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.staging import small_batches, staged
from tracelake.llm.components import components

_REMEMBERED = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
BUCKET_BITS = 18
BLOCK_SETS, BLOCK_NGRAMS = 1024, 1 << 21
PIVOTS = 16
COMPARED = 256
FILTER_BITS = 22
# Rows that a task turns into Python values at once.
ROWS = 256


class Words:
    """64-bit hashes of words; remembers a bounded number of them."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > _REMEMBERED:
            known.clear()
        found = []
        for word in words:
            value = known.get(word)
            if value is None:
                known[word] = value = xxhash.xxh64_intdigest(word)
            found.append(value)
        return np.array(found, dtype=np.uint64)


def ngram_set(text: str | None, size: int, hashes: Words) -> np.ndarray:
    """The sorted hashes of a whole text's distinct word n-grams.

    A-Z are lower-cased; words are runs of other than ASCII white space. Fewer than ``size`` words are one n-gram; a text
    without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    one = hashes.of(words)
    wide = min(size, len(words))
    n = len(words) - wide + 1
    mixed = np.full(n, wide, dtype=np.uint64)
    for i in range(wide):
        mixed = (mixed ^ one[i : n + i]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def prefix_length(n: int, percent: int) -> int:
    """How many n-grams of a set of ``n``, in any global order, have one in common with every similar set."""
    return n - -(-percent * n // 100) + 1 if n else 0


def signature(found: np.ndarray) -> bytes:
    """Parities of the n-grams by their low bits: about a bit for each n-gram, a power of two from 64 to 8,192."""
    bits = 64
    while bits < min(len(found), 8192):
        bits *= 2
    places = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(places.astype(np.uint8), bitorder="little").tobytes()


def able_labels(sizes: list[int], signatures: list[bytes], percent: int) -> list[int]:
    """For every set the least place of a set that pairs which may be similar connect it with.

    Sets differ at least in as many n-grams as their signatures differ in bits; a longer signature is folded to the length
    of the shorter one. So no similar pair is left out.
    """
    known = [np.frombuffer(one, dtype=np.uint8) for one in signatures]
    label = list(range(len(known)))
    for i, one in enumerate(known):
        for j in range(i):
            if label[i] == label[j] or 100 * min(sizes[i], sizes[j]) < percent * max(sizes[i], sizes[j]):
                continue
            a, b = (one, known[j]) if len(one) >= len(known[j]) else (known[j], one)
            while len(a) > len(b):
                a = a[: len(a) // 2] ^ a[len(a) // 2 :]
            if (100 + percent) * int(np.bitwise_count(a ^ b).sum()) <= (100 - percent) * (sizes[i] + sizes[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@dataclass
class Trie:
    """A compressed trie over sorted id lists: a node is a run of ids below its parent."""

    runs: list[np.ndarray]
    children: list[list[int]]
    ended: list[list[int]]
    least: list[int]
    deepest: list[int]


def build_trie(sets: list[np.ndarray], sizes: np.ndarray) -> Trie:
    """A trie of the sets; ``least`` is the smallest true size below a node and ``deepest`` the longest way down."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())  # ids are 0 or more
    trie = Trie([np.zeros(0, dtype=np.int64)], [[]], [[]], [0], [0])
    path = [(0, 0)]  # (node, depth at its end) from the root down
    previous = np.zeros(0, dtype=np.int64)
    for i in order:
        ids = sets[i]
        shared = min(len(ids), len(previous))
        differ = np.flatnonzero(ids[:shared] != previous[:shared])
        common = int(differ[0]) if len(differ) else shared
        last = None
        while path[-1][1] > common:
            last = path.pop()
        if path[-1][1] < common:  # split the run that was left in the middle
            node, above = last[0], path[-1][1]
            run = trie.runs[node]
            upper = len(trie.runs)
            trie.runs.append(run[: common - above])
            trie.children.append([node])
            trie.ended.append([])
            trie.runs[node] = run[common - above :]
            siblings = trie.children[path[-1][0]]
            siblings[siblings.index(node)] = upper
            path.append((upper, common))
        if len(ids) > common:
            leaf = len(trie.runs)
            trie.runs.append(ids[common:])
            trie.children.append([])
            trie.ended.append([])
            trie.children[path[-1][0]].append(leaf)
            path.append((leaf, len(ids)))
        trie.ended[path[-1][0]].append(i)
        previous = ids
    trie.least, trie.deepest = [0] * len(trie.runs), [0] * len(trie.runs)
    todo = [(0, False)]
    while todo:
        node, done = todo.pop()
        if not done:
            todo.append((node, True))
            todo.extend((child, False) for child in trie.children[node])
            continue
        below = trie.children[node]
        trie.least[node] = min([*(int(sizes[i]) for i in trie.ended[node]), *(trie.least[c] for c in below)], default=0)
        trie.deepest[node] = max((len(trie.runs[c]) + trie.deepest[c] for c in below), default=0)
    return trie


def linked_labels(sets: list[np.ndarray], percent: int, probes: np.ndarray | None = None) -> np.ndarray:
    """For every set the least place of a set that links connect it with.

    All sets go into the trie; those that ``probes`` marks (all, if it is None) walk it.
    """
    label = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = counts > 1  # what one set alone has adds to no overlap
    rank = np.full(len(values), -1, dtype=np.int64)
    common = np.flatnonzero(shared)
    rank[common[np.argsort(-counts[common], kind="stable")]] = np.arange(len(common))
    known = []
    for one in sets:
        ids = rank[np.searchsorted(values, one)]
        known.append(np.sort(ids[ids >= 0]))
    trie = build_trie(known, sizes)
    asked = np.arange(len(sets)) if probes is None else np.flatnonzero(probes)
    step = max(1, min(1024, (1 << 23) // max(1, len(common))))
    for start in range(0, len(asked), step):
        mine = asked[start : start + step]
        inside = np.zeros((len(mine), len(common) + 1), dtype=bool)
        for row, i in enumerate(mine):
            inside[row, known[i]] = True
        upto = np.cumsum(inside, axis=1, dtype=np.int32)
        size, total = sizes[mine], upto[:, -1]
        todo = [(0, np.arange(len(mine)), np.zeros(len(mine), dtype=np.int64))]
        while todo:
            node, alive, overlap = todo.pop()
            run = trie.runs[node]
            if len(run):
                overlap = overlap + inside[alive[:, None], run].sum(axis=1)
                left = np.minimum(total[alive] - upto[alive, run[-1]], trie.deepest[node])
                able = (100 + percent) * (overlap + left) >= percent * (size[alive] + trie.least[node])
                alive, overlap = alive[able], overlap[able]
            if not len(alive):
                continue
            for end in trie.ended[node]:
                similar = 100 * overlap >= percent * (size[alive] + sizes[end] - overlap)
                roots = np.unique(label[np.append(mine[alive[similar]], end)])
                if len(roots) > 1:
                    label[np.isin(label, roots)] = roots[0]
            todo.extend((child, alive, overlap) for child in trie.children[node])
    return label


def _bucket_counts(documents: DataFrame, size: int) -> np.ndarray:
    """In how many documents the n-grams of each of 2^18 buckets occur, over all documents. The driver gets one number for
    each bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = Words(), np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = ngram_set(text.as_py(), size, hashes)
                np.add.at(counts, (found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        used = np.flatnonzero(counts)
        yield pa.record_batch({"bucket": used, "n": counts[used]})

    sums = documents.select("text").mapInArrow(add, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    with small_batches(documents.sparkSession):
        found = sums.toPandas()  # 2^18 rows at most
    counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def _sets(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, print, n, node (digest of the set; null for an empty one), signature and the first n-grams in the global
    order."""
    spark = documents.sparkSession
    counts = spark.sparkContext.broadcast(_bucket_counts(documents, size))  # 2 MB

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, common = Words(), counts.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                sizes, nodes, signatures, keys = [], [], [], []
                for text in rows.column(2):
                    found = ngram_set(text.as_py(), size, hashes)
                    node, first, bits = None, [], None
                    if len(found):
                        node = int(np.array([xxhash.xxh64_intdigest(found.tobytes())], dtype=np.uint64).view(np.int64)[0])
                        often = common[(found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                        first = found[np.lexsort((found, often))][: prefix_length(len(found), percent)].view(np.int64)
                        bits = signature(found)
                    sizes.append(len(found)), nodes.append(node), signatures.append(bits), keys.append(first)
                made = [
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(signatures, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ]
                names = ["doc_id", "print", "n", "node", "bits", "keys"]
                yield pa.record_batch([rows.column(0), rows.column(1), *made], names)

    schema = "doc_id bigint, print bigint, n bigint, node bigint, bits binary, keys array<bigint>"
    return documents.select("doc_id", "print", "text").mapInArrow(sets, schema)


def _joined(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) inside each ``part`` of rows (part, node, probe, text), as a star for every component."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        hashes = Words()
        sets = [ngram_set(text, size, hashes) for text in group["text"]]
        nodes = group["node"].to_numpy(np.int64)
        label = linked_labels(sets, percent, group["probe"].to_numpy(bool))
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"u": nodes[tied], "v": nodes[label[tied]]})

    return rows.groupBy("part").applyInPandas(join, "u bigint, v bigint")


def _strays(large: DataFrame, joined: DataFrame, columns: list, size: int, percent: int) -> DataFrame:
    """Links between blocks of a group.

    Sets in the component that most of the group belongs to need not meet each other again. All others, the strays, meet
    every block, in chunks of a block's size.
    """
    rooted = joined.withColumnRenamed("root", "component")
    placed = large.join(rooted, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = placed.groupBy("root", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("root").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    marked = staged(placed.join(main, "root").withColumn("strays", F.col("component") != F.col("main")), "ngram-strays")
    weight = marked.where("strays").groupBy("root").agg(F.count("*").alias("sets_"), F.sum("n").alias("ngrams_"))
    chunks = F.ceil(F.greatest(F.col("sets_") / BLOCK_SETS, F.col("ngrams_") / BLOCK_NGRAMS)).cast("bigint")
    asked = marked.join(weight.select("root", chunks.alias("chunks")), "root")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("stray")), "chunks"))
    zero = F.lit(0).cast("bigint")
    passive = asked.withColumn("stray", F.explode(F.sequence(zero, F.col("chunks") - 1)))
    passive = passive.where(~F.col("strays") | (F.col("stray") != F.col("chunk"))).withColumn("probe", F.lit(False))
    active = asked.where("strays").drop("block").withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    active = active.withColumn("stray", F.col("chunk")).withColumn("probe", F.lit(True))
    return _joined(passive.select(*columns).union(active.select(*columns)), size, percent)


def _met_together(few: DataFrame) -> DataFrame:
    """The nodes that share a key (key, node), as rows (met, node): once, however many keys the very same nodes share. Near
    copies have most of their keys in common, and their signatures are far larger than the keys."""
    nodes = few.groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("nodes"))  # ``COMPARED`` at most
    return nodes.select("nodes").distinct().select(F.xxhash64("nodes").alias("met"), F.explode("nodes").alias("node"))


def _near(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that connect all nodes with similar sets, and few others.

    Keys that one node alone has are dropped after a partial aggregate. The nodes of any other key are compared by their
    signatures, once for all keys that just these have, or, where the key has more than ``COMPARED`` rows, all tied to the
    least of them.
    """
    known = sets.where("node is not null")
    rows = known.select(F.explode("keys").alias("key"), "node")
    met = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("rows"))
    near = rows.join(met.where("least != most").select("key", "least", "rows"), "key").distinct()
    near = staged(near, "ngram-keys")
    star = near.where(F.col("rows") > COMPARED).select(F.col("node").alias("u"), F.col("least").alias("v"))
    few = near.where(F.col("rows") <= COMPARED).select("key", "node")
    signed = known.select("node", "n", "bits").dropDuplicates(["node"])
    told = _met_together(few).join(signed, "node")
    told = told.groupBy("met").agg(F.collect_list(F.struct("node", "n", "bits")).alias("sets"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = set()
            for sets in batch.column(0):
                group = sets.as_py()
                label = able_labels([x["n"] for x in group], [x["bits"] for x in group], percent)
                edges.update((group[i]["node"], group[k]["node"]) for i, k in enumerate(label) if i != k)
            ends = np.array(sorted(edges), dtype=np.int64).reshape(-1, 2)
            yield pa.record_batch({"u": ends[:, 0].copy(), "v": ends[:, 1].copy()})

    return star.union(told.select("sets").mapInArrow(compare, "u bigint, v bigint"))


def _bucket(print_: Column) -> Column:
    return F.pmod(print_, F.lit(1 << FILTER_BITS))


def _marks(prints: DataFrame) -> DataFrame:
    """Which of 2^22 buckets the ``print`` values fall into: at most 2^16 rows (__word, __bits) of 64 buckets each."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("print", F.lit(64)).cast("int"))
    words = prints.groupBy(F.shiftright(_bucket(F.col("print")), 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    return staged(words, "ngram-marks")


def _marked(rows: DataFrame, marks: DataFrame, print_: str, name: str) -> DataFrame:
    """``rows`` with the column ``name``: false only where the print is in no marked bucket. It spares texts a shuffle in
    which they would meet nothing; with many more than a million marked prints it lets nearly all through."""
    here = F.shiftright(_bucket(F.col(print_)), 6) == F.col("__word")
    bit = F.getbit("__bits", F.pmod(print_, F.lit(64)).cast("int"))
    known = rows.join(F.broadcast(marks), here, "left")  # 2^16 rows of two numbers at most
    return known.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("__word", "__bits")


def _placed(source: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, print, n, node and root for every row of ``source`` (doc_id, print, text): rows whose sets links connect
    share a root; it is null for an empty set."""
    with small_batches(source.sparkSession):
        sets = staged(_sets(source, size, percent), "ngram-sets")
    no_key = F.lit(-(1 << 63)).cast("bigint")
    row = F.struct("print", F.coalesce("doc_id", no_key).alias("id"))  # names a row that has the set
    grouped = sets.where("node is not null").groupBy("node")
    nodes = staged(
        grouped.agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.min(row).alias("row")).select(
            "node", "doc_id", "n", "row.print", "row.id"
        ),
        "ngram-nodes",
    )

    groups = staged(components(_near(sets, percent)), "ngram-groups")

    # A group above the limits is cut into blocks. Each is joined by itself, together with a few sets that all blocks get.
    weight = groups.join(nodes, "node").groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("ngrams"))
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("ngrams") / BLOCK_NGRAMS)).cast("bigint")
    member = groups.join(weight.select("root", "sets", blocks.alias("blocks")), "root").join(nodes, "node")
    member = member.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), "blocks"))
    texts = source.where("text is not null").select("print", F.coalesce("doc_id", no_key).alias("id"), "text")
    chosen = member.select("root", "node", "n", "sets", "blocks", "block", "print", "id")
    texts = _marked(texts, _marks(chosen), "print", "marked").where("marked").drop("marked")
    texts = texts.dropDuplicates(["print", "id"])  # dealt out as the join is, so texts travel once
    content = staged(chosen.join(texts, ["print", "id"]).drop("print", "id"), "ngram-texts")
    part = F.xxhash64("root", "block", "stray")

    own = content.withColumn("stray", F.lit(-1).cast("bigint")).withColumn("probe", F.lit(True))
    pivots = own.where((F.col("blocks") > 1) & (F.pmod(F.xxhash64("node"), F.col("sets")) < PIVOTS))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda b: b != F.col("block"))
    pivots = pivots.withColumn("other", F.explode(others)).drop("block").withColumnRenamed("other", "block")
    columns = [part.alias("part"), "node", "probe", "text"]
    first = staged(_joined(own.select(*columns).union(pivots.select(*columns)), size, percent), "ngram-links")
    links = first
    large = content.where("blocks > 1")
    if not large.isEmpty():
        links = first.union(_strays(large, components(first), columns, size, percent))

    roots = nodes.select("node").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return sets.select("doc_id", "print", "n", "node").join(roots, "node", "left")


def _source(documents: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, print (a hash of the text) and text."""
    return documents.select(
        F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("print"), F.col(text).alias("text")
    )


def jaccard_components(
    documents: DataFrame, size: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Two documents link when 100 x |intersection| >= ``percent`` x |union| of their sets of ``size``-word n-grams;
    component_id is the least key that links connect a document with, itself included. Every link counts: documents with
    equal sets are one node of the graph, any two similar sets share a key and so a group, and a group is joined in full
    except for pairs that other links already connect.

    - A null or empty text, or one without words, has n_shingles 0 and links with nothing.
    - A row with a null key takes part in links; its component_id is the least key of the others, or null.
    - Rows with equal keys are documents of their own. Other columns play no part. An empty table gives an empty result.
    - Words, n-grams and sets are compared by 64-bit hashes.
    """
    placed = staged(_placed(_source(documents, key, text), size, percent), "ngram-roots")
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "root", "left").select(
        F.col("doc_id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(
    documents: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``documents`` of which one is left in every group that links connect: the least key, null last, then the
    least hash of the text. Rows without words are groups of their own. All columns stay as they are."""
    last = F.lit((1 << 63) - 1).cast("bigint")
    placed = _placed(_source(documents, key, text), size, percent).where("root is not null")
    placed = staged(placed.select("root", F.coalesce("doc_id", last).alias("id"), "print"), "ngram-roots")
    groups = placed.groupBy("root").agg(F.min(F.struct("id", "print")).alias("best"), F.count("*").alias("rows"))
    groups = groups.where("rows > 1")
    best = groups.select(F.col("best.id").alias("__id"), F.col("best.print").alias("__print")).distinct()
    member = staged(placed.join(groups.select("root"), "root").select("id", "print"), "ngram-members")
    marked = documents.withColumn("__id", F.coalesce(F.col(key).cast("bigint"), last))
    marked = _marked(marked.withColumn("__print", F.xxhash64(F.col(text))), _marks(member), "__print", "__grouped")
    grouped = member.select(F.col("id").alias("__id"), F.col("print").alias("__print")).distinct()
    # Of the rows whose text may be in a group, those that are not in one stay, and the best of each group.
    doubtful = marked.where("__grouped")
    outside = doubtful.join(grouped, ["__id", "__print"], "left_anti")
    kept = doubtful.join(best, ["__id", "__print"], "left_semi").dropDuplicates(["__id", "__print"])
    left = marked.where("not __grouped").unionByName(outside).unionByName(kept)
    return left.select(*documents.columns)
