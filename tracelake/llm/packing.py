"""Best-fit packing of token sequences after a dominance reduction.

Documents are tokenised and cut into pieces of at most one sequence. Pieces of one length are alike to the packing, so
the instance is how many pieces there are of each length: as many numbers as a sequence has tokens, whatever the
corpus. On these counts, Martello and Toth's reduction fixes sequences that provably dominate every alternative, and
best fit packs the rest. The plan says which ranks of a length go where; pieces are ranked within their length by Spark
and look up their place.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.staging import small_batches, staged
from tracelake.llm.numbering import running_before, runs_for

# Latin letters, punctuation and currency signs: here both libraries split a text by the same pattern and the same
# character classes. Other characters, and the name of a special token, go to the reference library.
_UNUSUAL = re.compile("[^\x00-ɏ‐-›€]|<\\|")
# Fixed value: the published split pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Rows that a task turns into Python values at once.
ROWS = 256
PIECES = "doc_id bigint, copy string, piece int, start bigint, length int, ids_crc32 bigint"


class Tokens:
    """Token ids of texts by a ``tokenizers`` file with a byte-level BPE vocabulary.

    ``tiktoken`` works on the same vocabulary and merge order three times faster and is used for texts whose characters
    both treat alike; the ``tokenizers`` library itself does the others.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {token.content for token in self.exact.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in word): rank for word, rank in vocabulary.items() if word not in special}
        self.fast = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if _UNUSUAL.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a sequence: all of ``most`` tokens, but the first may be shorter."""
    first = length % most or min(length, most)
    starts = [0, *range(first, length, most)] if length else []
    return [(start, first if start == 0 else most) for start in starts]


def cut_documents(
    documents: DataFrame, tokenizer: str, end_id: int, most: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The pieces of every document: key, copy (a digest of the text, for rows with equal keys), piece, start, length, ids_crc32.

    A null text counts as empty; an empty one is the end id alone. ``tokenizer`` is a file that executors can read.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows = batch.slice(first, ROWS)
                found = []
                for doc, content in zip(rows.column(0), rows.column(1), strict=True):
                    doc, content = doc.as_py(), content.as_py() or ""
                    ids = np.array([*tokens.ids(content), end_id], dtype="<u4")
                    copy = f"{zlib.crc32(content.encode('utf-8', 'surrogatepass')):08x}{len(ids):x}"
                    for place, (start, length) in enumerate(cut(len(ids), most)):
                        crc = zlib.crc32(ids[start : start + length].tobytes())
                        found.append((doc, copy, place, start, length, crc))
                columns = zip(*found, strict=True)
                yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    return documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(pieces, PIECES)


@dataclass
class Plan:
    """Which ranks of a length go into which sequences.

    A row of ``uses``: length, first rank, number of sequences, pieces of this length in each of them, first sequence,
    offset of the first of these pieces.
    """

    uses: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    ranks: dict[int, int] = field(default_factory=dict)

    def close(self, content: list[tuple[int, int]], count: int) -> None:
        """``count`` sequences that hold (length, how many) each."""
        offset = 0
        for length, many in content:
            first = self.ranks.get(length, 0)
            self.uses.append((length, first, count, many, self.sequences, offset))
            self.ranks[length] = first + count * many
            offset += length * many
        self.sequences += count


def _fit(counts: np.ndarray, most: int, without: int = 0) -> int:
    """The greatest length up to ``most`` with a piece left, when one piece of length ``without`` is spoken for; or 0."""
    for length in range(min(most, len(counts) - 1), 0, -1):
        if counts[length] > (length == without):
            return length
    return 0


def reduce_by_dominance(counts: np.ndarray, capacity: int, plan: Plan) -> None:
    """Fix sequences that dominate every alternative, and take their pieces out of ``counts``.

    For the longest piece j that is not settled, with room r beside it and k the greatest other piece within r:
    nothing fits - {j}; k fills r, or no two pieces fit together - {j, k}; at most two fit, and no two are longer than
    k - {j, k} again. Each of these sets can replace whatever shares j's sequence in any packing without using more
    sequences. A piece without such a set is left for best fit. Equal lengths are settled together.
    """
    for j in range(min(capacity, len(counts) - 1), 0, -1):
        while counts[j]:
            room = capacity - j
            k = _fit(counts, room, without=j)
            if not k:
                count, content = int(counts[j]), [(j, 1)]
            elif k == room or _dominates(counts, j, k, room):
                count = int(counts[j]) // 2 if k == j else int(min(counts[j], counts[k]))
                content = [(j, 2)] if k == j else [(j, 1), (k, 1)]
            else:
                break
            plan.close(content, count)
            for length, many in content:
                counts[length] -= many * count


def _dominates(counts: np.ndarray, j: int, k: int, room: int) -> bool:
    """Whether k beside j is at least as long as any pair that fits, where no three pieces fit."""
    free = counts.copy()
    free[j] -= 1
    small = np.repeat(np.flatnonzero(free[: room + 1] > 0), np.minimum(free[np.flatnonzero(free[: room + 1] > 0)], 3))[:3]
    if len(small) < 2 or small[:2].sum() > room:
        return True
    if len(small) == 3 and small.sum() <= room:
        return False
    for a in np.flatnonzero(free[: room + 1] > 0):
        rest = free.copy()
        rest[a] -= 1
        b = _fit(rest, room - int(a))
        if b and a + b > k:
            return False
    return True


def best_fit(counts: np.ndarray, capacity: int, plan: Plan) -> None:
    """Best fit over falling lengths: a piece goes where it leaves the least room. Alike sequences are filled together."""
    open_: dict[int, list[tuple[int, tuple]]] = {}

    def put(room: int, count: int, content: tuple) -> None:
        if count:
            open_.setdefault(room, []).append((count, content))

    for length in range(min(capacity, len(counts) - 1), 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in open_ if r >= length), default=capacity)
            groups = open_.get(room)
            count, content = groups.pop() if groups else (left, ())
            if groups is not None and not groups:
                del open_[room]
            many = min(room // length, left)
            filled = min(count, left // many)
            put(room - many * length, filled, (*content, (length, many)))
            left -= filled * many
            if content:
                put(room, count - filled, content)
    for groups in open_.values():
        for count, content in groups:
            plan.close(list(content), count)


def pack_lengths(counts: dict[int, int], capacity: int) -> Plan:
    """A plan for so many pieces of each length, 1 to ``capacity``."""
    table = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in counts.items():
        table[length] += count
    plan = Plan()
    reduce_by_dominance(table, capacity, plan)
    best_fit(table, capacity, plan)
    return plan


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with sequence_id and offset. They hold length (1 to ``capacity``), doc_id, copy and piece, and are staged.

    What goes through the driver is one count for each length, and what comes back is a plan of a few rows for each.
    """
    spark = pieces.sparkSession
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pack_lengths(counts, capacity)
    run = F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(runs_for(sum(counts.values()))))
    order = [F.col("doc_id"), F.col("copy"), F.col("piece")]
    ranked = running_before(pieces, ["length"], run, order, F.lit(1).cast("bigint"), "rank")

    uses = np.array(sorted(plan.uses) or np.zeros((0, 6)), dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(uses)  # a few rows for each length up to the capacity

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = shared.value
        keys = use[:, 0] << 44 | use[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            mine = use[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            into, among = np.divmod(rank - mine[:, 1], mine[:, 3])
            batch["sequence_id"] = mine[:, 4] + into
            batch["offset"] = mine[:, 5] + among * length
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInPandas(place, f"{schema}, sequence_id bigint, offset bigint").drop("rank")


def pack_documents(
    documents: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = 1024,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every piece with its sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    - A document is its token ids, without special tokens, and ``end_id``; a null text counts as empty. Longer ones are
      cut into pieces of ``capacity`` tokens, the first of which may be shorter.
    - ids_crc32: of the piece's ids as little-endian unsigned 32-bit numbers.
    - Sequences are numbered from 0; offsets in a sequence are gapless from 0.
    - Rows with the same key are packed each by itself. A null key stays null. Other columns play no part. An empty table
      gives an empty result.
    """
    with small_batches(documents.sparkSession):
        pieces = staged(cut_documents(documents, tokenizer, end_id, capacity, key, text), "pack-pieces")
    return pack_pieces(pieces, capacity).select(
        F.col("doc_id").alias(key),
        "piece",
        "start",
        F.col("length").cast("bigint").alias("length"),
        "ids_crc32",
        "sequence_id",
        "offset",
    )
