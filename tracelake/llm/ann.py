"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, in flat neighbour arrays.

Equal vectors are one node. Nearness is the inner product; a coordinate is added that lifts all vectors of a shard to
one length, so that the greatest inner product is the smallest distance and the graph can prune by distance. A shard holds
vectors of one band of lengths (the longest at most four times the shortest), so that a few long vectors do not press all
others into one point. A shard's graph is built in one task and stored as a row of flat arrays. Blocks of queries meet every
shard, walk its graph together, and the shards' nearest are merged.

Numbers of any size take part: lengths are computed from vectors divided by their largest component, and scores are
compared as products of vectors that are scaled by powers of two, which changes no digit of them.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.staging import staged

INDEX = (
    "shard int, dims int, degree int, vectors binary, levels binary, offsets binary, ids binary, links binary, "
    "upper binary, entry bigint"
)
FOUND = "query_id bigint, variant bigint, vec_id bigint, near double, score double"


@dataclass
class Graph:
    """Nodes 0 .. n - 1 of unit vectors. links: 2 x degree neighbours of every node on the ground level, -1 where none;
    upper: for levels 1, 2, ... a table of the neighbours, one row for each node that reaches so high (nodes are numbered
    by falling level, so those are the first ones)."""

    vectors: np.ndarray
    levels: np.ndarray
    links: np.ndarray
    upper: list[np.ndarray]


def spread(vectors: np.ndarray, sims: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates (sorted by falling similarity, -1 where none): first those that are nearer
    to the node than to any one taken before, then the nearest of the others."""
    rows, width = candidates.shape
    there = np.take(vectors, np.maximum(candidates, 0), axis=0)
    between = there @ there.transpose(0, 2, 1)
    valid = candidates >= 0
    taken = np.zeros((rows, width), dtype=bool)
    count = np.zeros(rows, dtype=np.int64)
    closest = np.full((rows, width), -np.inf, dtype=np.float32)
    for j in range(width):
        fine = np.flatnonzero(valid[:, j] & (closest[:, j] < sims[:, j]) & (count < most))
        taken[fine, j] = True
        count[fine] += 1
        closest[fine, j + 1 :] = np.maximum(closest[fine, j + 1 :], between[fine, j, j + 1 :])
    place = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    chosen = np.take_along_axis(candidates, place, axis=1)
    if width < most:
        chosen = np.pad(chosen, ((0, 0), (0, most - width)), constant_values=-1)
    return chosen


def _link_level(vectors: np.ndarray, order: np.ndarray, degree: int, most: int, reach: int, batch: int) -> np.ndarray:
    """Neighbours of the nodes ``order`` (by place in it), inserted in that order: ``degree`` links out, ``most`` in all.

    Batches double up to ``batch`` nodes. The ``reach`` nearest of the nodes that are there, the batch's own included, are
    found exactly by a matrix product, which a shard's size bounds.
    """
    n = len(order)
    own = vectors[order]
    table = np.full((n, most), -1, dtype=np.int64)
    start = 0
    while start < n:
        end = min(n, start + max(64, min(start, batch)))
        sims = own[start:end] @ own[:end].T
        sims[np.arange(end - start), np.arange(start, end)] = -np.inf
        width = min(reach, end - 1)
        if width < 1:
            start = end
            continue
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        near_sims = np.take_along_axis(sims, near, axis=1)
        place = np.argsort(-near_sims, axis=1, kind="stable")
        near, near_sims = np.take_along_axis(near, place, axis=1), np.take_along_axis(near_sims, place, axis=1)
        chosen = spread(own, near_sims, near, degree)
        table[start:end, :degree] = chosen
        source = np.repeat(np.arange(start, end), degree)
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        value = np.einsum("ij,ij->i", own[source], own[target])
        place = np.lexsort((source, -value, target))
        source, target = source[place], target[place]
        ends, first, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, counts)
        coming = np.full((len(ends), most), -1, dtype=np.int64)
        fits = rank < most
        coming[np.repeat(np.arange(len(ends)), counts)[fits], rank[fits]] = source[fits]
        for at in range(0, len(ends), batch):
            mine = ends[at : at + batch]
            both = np.sort(np.concatenate([table[mine], coming[at : at + batch]], axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both_sims = np.einsum("ij,ikj->ik", own[mine], own[np.maximum(both, 0)])
            both_sims = np.where(both >= 0, both_sims, -np.inf)
            place = np.argsort(-both_sims, axis=1, kind="stable")
            both, both_sims = np.take_along_axis(both, place, axis=1), np.take_along_axis(both_sims, place, axis=1)
            table[mine] = spread(own, both_sims, both, most)
        start = end
    return table


def build(vectors: np.ndarray, levels: np.ndarray, degree: int, reach: int, batch: int = 1024) -> Graph:
    """The graph of unit vectors whose nodes are numbered by falling level."""
    random = np.random.Generator(np.random.PCG64(len(vectors)))
    upper = []
    for level in range(1, int(levels.max(initial=0)) + 1):
        count = int((levels >= level).sum())
        upper.append(_link_level(vectors, np.arange(count), degree, degree, reach, batch).astype(np.int32))
    order = random.permutation(len(vectors))
    table = _link_level(vectors, order, degree, 2 * degree, reach, batch)
    links = np.full_like(table, -1)
    links[order] = np.where(table >= 0, order[np.maximum(table, 0)], -1)
    return Graph(vectors, levels, links.astype(np.int32), upper)


def search(graph: Graph, queries: np.ndarray, breadth: int, step: int = 4) -> np.ndarray:
    """The ``breadth`` nearest nodes that a walk from the top finds for each query, -1 where fewer are found.

    All queries walk together: down the upper levels by the best neighbour, then on the ground level with a beam of which
    every round opens the best ``step`` nodes that are not open yet, until none is left.
    """
    count, n = len(queries), len(graph.vectors)
    at = np.zeros(count, dtype=np.int64)
    best = queries @ graph.vectors[0]
    for table in reversed(graph.upper):
        moving = np.arange(count)
        while len(moving):
            near = table[at[moving]]
            sims = np.einsum("ij,ikj->ik", queries[moving], graph.vectors[np.maximum(near, 0)])
            sims = np.where(near >= 0, sims, -np.inf)
            pick = sims.argmax(axis=1)
            value = sims[np.arange(len(moving)), pick]
            ahead = value > best[moving]
            moving, near, pick, value = moving[ahead], near[ahead], pick[ahead], value[ahead]
            at[moving], best[moving] = near[np.arange(len(moving)), pick], value
    seen = np.zeros((count, n), dtype=bool)
    seen[np.arange(count), at] = True
    beam = np.full((count, breadth), -1, dtype=np.int64)
    sims = np.full((count, breadth), -np.inf, dtype=np.float32)
    opened = np.ones((count, breadth), dtype=bool)
    beam[:, 0], sims[:, 0], opened[:, 0] = at, best, False
    active = np.arange(count)
    while len(active):
        waiting = np.where(opened[active], 1, 0)
        pick = np.argsort(waiting, axis=1, kind="stable")[:, :step]  # the beam is sorted, so the best come first
        real = ~np.take_along_axis(opened[active], pick, axis=1)
        nodes = np.where(real, np.take_along_axis(beam[active], pick, axis=1), -1)
        opened[active[:, None], pick] = True
        near = graph.links[np.maximum(nodes, 0)].astype(np.int64)
        near[nodes < 0] = -1
        near = np.sort(near.reshape(len(active), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[active[:, None], np.maximum(near, 0)]] = -1
        rows, columns = np.nonzero(near >= 0)
        fresh = near[rows, columns]
        seen[active[rows], fresh] = True
        value = np.full(near.shape, -np.inf, dtype=np.float32)
        value[rows, columns] = np.einsum(
            "ij,ij->i", np.take(queries, active[rows], axis=0), np.take(graph.vectors, fresh, axis=0)
        )
        all_sims = np.concatenate([sims[active], value], axis=1)
        all_nodes = np.concatenate([beam[active], near], axis=1)
        all_open = np.concatenate([opened[active], near < 0], axis=1)
        place = np.argsort(-all_sims, axis=1, kind="stable")[:, :breadth]
        sims[active] = np.take_along_axis(all_sims, place, axis=1)
        beam[active] = np.take_along_axis(all_nodes, place, axis=1)
        opened[active] = np.take_along_axis(all_open, place, axis=1)
        active = active[~opened[active].all(axis=1)]
    return beam


def valid_vectors(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part: no null key, and a vector without null, NaN or
    infinite components that is not all zeros. Repeated rows count once."""
    rows = embeddings.select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    )
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("vector", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(sound & nonzero).distinct()


def with_band(vectors: DataFrame) -> DataFrame:
    """The largest component of each vector and the band of its length: lengths from half to twice a power of four."""
    vectors = vectors.withColumn("largest", F.array_max(F.transform("vector", F.abs)))
    square = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + (x / F.col("largest")) * (x / F.col("largest")))
    return vectors.withColumn("band", F.floor((F.log2("largest") + F.log2(square) / 2 + 1) / 2).cast("int"))


def lifted(raw: np.ndarray) -> np.ndarray:
    """Vectors of a shard as unit vectors: divided by the longest, and a coordinate more."""
    scaled = raw / np.abs(raw).max()
    scaled /= np.sqrt((scaled**2).sum(axis=1).max())
    lift = np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))
    return np.column_stack([scaled, lift]).astype(np.float32)


def build_index(vectors: DataFrame, copies: int, shard_rows: int, degree: int = 16, reach: int = 64) -> tuple[DataFrame, int]:
    """A row of flat arrays for each shard, and the number of shards: as many for each band as its rows need.

    Of equal vectors the ``copies`` least keys are kept with their node: no query can need more. A window's limit cuts them
    off before the shuffle, so that a vector with very many copies meets nowhere. The driver sees the number of rows of each
    band; doubles have fewer than 1,100 bands.
    """
    counts = vectors.groupBy("band").count().orderBy("band").collect()
    parts = [-(-row["count"] // shard_rows) for row in counts]
    bands = [(row["band"], sum(parts[:i]), parts[i]) for i, row in enumerate(counts)]
    table = vectors.sparkSession.createDataFrame(bands, "band int, begin int, parts int")
    place = F.expr("row_number() over (partition by vector order by vec_id)")
    few = vectors.withColumn("place", place).where(F.col("place") <= copies)
    nodes = few.groupBy("vector", "band").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most ``copies`` of them
    part = F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.col("parts"))
    nodes = nodes.join(F.broadcast(table), "band").withColumn("shard", (F.col("begin") + part).cast("int"))
    nodes = nodes.withColumn("mix", F.xxhash64(F.get("ids", F.lit(0)), F.lit("level"))).select("shard", "vector", "ids", "mix")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        raw = np.array(group["vector"].tolist(), dtype=np.float64)
        uniform = (group["mix"].to_numpy(np.int64).astype(np.uint64) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        levels = np.floor(-np.log(np.maximum(uniform, 1e-12)) / np.log(degree)).astype(np.int64)
        first = np.array([ids[0] for ids in group["ids"]], dtype=np.int64)
        order = np.lexsort((*raw.T[::-1], first, -levels))
        raw, levels = raw[order], levels[order]
        ids = [np.asarray(group["ids"].iloc[i], dtype=np.int64) for i in order]
        graph = build(lifted(raw), levels, degree, reach)
        offsets = np.cumsum([0, *map(len, ids)]).astype(np.int64)
        row = {
            "shard": group["shard"].iloc[0],
            "dims": raw.shape[1],
            "degree": degree,
            "vectors": raw.tobytes(),
            "levels": levels.tobytes(),
            "offsets": offsets.tobytes(),
            "ids": np.concatenate(ids).tobytes(),
            "links": graph.links.tobytes(),
            "upper": b"".join(table.tobytes() for table in graph.upper),
            "entry": 0,
        }
        return pd.DataFrame([row])

    return nodes.groupBy("shard").applyInPandas(one, INDEX), sum(parts)


def _opened(row: pd.Series) -> tuple[np.ndarray, Graph, np.ndarray, np.ndarray]:
    """The arrays of a stored shard: vectors as given, graph, offsets of the nodes' keys, keys."""
    dims, degree = int(row["dims"]), int(row["degree"])
    raw = np.frombuffer(row["vectors"], dtype=np.float64).reshape(-1, dims)
    levels = np.frombuffer(row["levels"], dtype=np.int64)
    flat, upper, at = np.frombuffer(row["upper"], dtype=np.int32), [], 0
    for level in range(1, int(levels.max(initial=0)) + 1):
        count = int((levels >= level).sum()) * degree
        upper.append(flat[at : at + count].reshape(-1, degree))
        at += count
    links = np.frombuffer(row["links"], dtype=np.int32).reshape(-1, 2 * degree)
    graph = Graph(lifted(raw), levels, links, upper)
    return raw, graph, np.frombuffer(row["offsets"], dtype=np.int64), np.frombuffer(row["ids"], dtype=np.int64)


def nearest(
    embeddings: DataFrame,
    every: int = 20,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = 16_384,
    degree: int = 16,
    breadth: int = 160,
    block: int = 1024,
    blocks_per_task: int = 16,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` nearest found for each row whose key ``every`` divides.

    - Nearness is the inner product, greatest first, ties to the smaller key. The walk finds candidates; scores and their
      order come from the vectors as given, in double precision. Where a score is beyond the range of doubles (infinite, or
      too small), the order is still that of the true products. A row is no candidate for itself; its copies are.
    - Rows with a null key, and with a vector that is null, empty, all zeros or holds a null or non-finite component, take no
      part; nor do vectors of another length than the most frequent one. Repeated rows count once. Rows of one key with
      different vectors are rows of their own: each is a query with ranks from 1, and a candidate for the other.
    - All rows that take part are indexed: equal vectors as one node, with the ``k`` + 1 least keys.
    - A shard holds about ``shard_rows`` nodes of one band of lengths. A task takes a shard and ``blocks_per_task`` blocks of
      ``block`` queries, which walk together, so an index travels once for as many queries as it has nodes.
    - Other columns play no part. An empty table gives an empty result.
    """
    sound = valid_vectors(embeddings, key, vector)
    sizes = sound.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"))
    dims = sizes.orderBy(F.desc("n"), "dims").limit(1).collect()
    sound = sound.where(F.size("vector") == (dims[0]["dims"] if dims else 0))
    vectors = staged(with_band(sound), "ann-vectors")
    asked = F.col("vec_id") % every == 0
    facts = vectors.agg(F.max("largest").alias("largest"), F.count(F.when(asked, 1)).alias("queries")).collect()[0]
    top = int(np.frexp(facts["largest"] or 1.0)[1])
    parts = max(1, -(-facts["queries"] // (block * blocks_per_task)))
    index, shards = build_index(vectors, k + 1, shard_rows, degree)
    index = staged(index, "ann-index")

    variant = F.xxhash64("vector")
    mine = F.pmod(F.xxhash64("vec_id", variant), F.lit(parts)).cast("int")
    queries = vectors.where(asked).select(
        F.col("vec_id").alias("query_id"), variant.alias("variant"), "vector", mine.alias("part")
    )
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards, 1) - 1))))
    pieces = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def ask(wanted: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({name.split()[0]: [] for name in FOUND.split(", ")})
        if not len(wanted) or not len(stored):
            return none.astype({"query_id": "int64", "variant": "int64", "vec_id": "int64"})
        raw, graph, offsets, ids = _opened(stored.iloc[0])
        even = np.ldexp(raw, -top)
        out = []
        for begin in range(0, len(wanted), block):
            some = wanted.iloc[begin : begin + block]
            q = np.array(some["vector"].tolist(), dtype=np.float64)
            power = np.frexp(np.abs(q).max(axis=1))[1]
            own = np.ldexp(q, -power[:, None])
            unit = own / np.sqrt((own**2).sum(axis=1, keepdims=True))
            # A node has a row of its own for each copy, so k + 1 nodes are enough; the beam is wider to find them.
            found = search(graph, np.column_stack([unit, np.zeros(len(q))]).astype(np.float32), max(breadth, 2 * k))
            for i, (name, kind) in enumerate(zip(some["query_id"], some["variant"], strict=True)):
                nodes = found[i][found[i] >= 0]
                near = (even[nodes] * own[i]).sum(axis=1)
                order = np.lexsort((ids[offsets[nodes]], -near))[: k + 1]
                nodes, near = nodes[order], near[order]
                copies = offsets[nodes + 1] - offsets[nodes]
                keys = np.concatenate([ids[offsets[node] : offsets[node + 1]] for node in nodes])
                other = (keys != name) | ~np.repeat((raw[nodes] == q[i]).all(axis=1), copies)
                keys, near = keys[other], np.repeat(near, copies)[other]
                place = np.lexsort((keys, -near))[:k]
                with np.errstate(over="ignore", under="ignore"):
                    score = np.ldexp(near[place], int(power[i]) + top)
                rows = {"query_id": name, "variant": kind, "vec_id": keys[place], "near": near[place], "score": score}
                out.append(pd.DataFrame(rows))
        return pd.concat(out, ignore_index=True)

    met = queries.groupBy("shard", "part").cogroup(pieces.groupBy("shard", "part")).applyInPandas(ask, FOUND)
    rank = F.expr("row_number() over (partition by query_id, variant order by near desc, vec_id)")
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
