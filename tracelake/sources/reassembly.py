"""TCP payload to whole messages, split inside long flows.

Packets of one direction of a connection are walked in capture order by a small state machine whose
state is the unfinished message. A header that names more than the largest length is rejected, and the next message is
searched for byte by byte, in as many packets as it takes. Every byte of the payload ends up in a message, in the list of
what was lost, or in a message that its flow leaves unfinished. Short flows are walked whole, partition by partition. A flow with very
many packets is cut into chunks. Each chunk first guesses where a message begins; the guess only serves
to find out what the chunk leaves unfinished. Chunks are then walked again from what their predecessor
left, until every chunk was given just that; as a rule one more walk does it.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.scan import BROADCAST_KEYS, CHUNK_ROWS, HotKeys, chunk_of, hot_keys
from tracelake.functions.staging import staged

FLOW = ["trace_file", "ip_src", "src_port", "ip_dst", "dst_port"]
# Messages are numbered by the frame they end in times this, plus their place in it.
MESSAGE_STEP = 1 << 16

_PIECE = [*FLOW, "chunk"]
_OUT = (
    "trace_file string, ip_src string, src_port int, ip_dst string, dst_port int, chunk bigint, what string, "
    "frame_no bigint, place int, low_seq bigint, first_ms bigint, high_seq bigint, last_ms bigint, body binary, "
    "search boolean, why string, bytes bigint"
)
_TAIL = ["body", "low_seq", "first_ms", "high_seq", "last_ms", "search"]
BATCH_ROWS = 4096
# Longest message that is believed, and longest header of one: a task holds no more of a flow.
LARGEST_MESSAGE = 1 << 24
LONGEST_HEADER = 1 << 18
# Place of the end of a chunk in which no message seems to begin.
NO_START = 2
# Why bytes are lost.
NO_MESSAGE, TOO_LONG, TOO_MANY = "no message", "too long", "too many messages in a packet"


# Length of the message that begins at the start of the bytes: None if telling takes more bytes, 0 if
# no message begins there.
Measure = Callable[[bytes], int | None]


class _Unfinished:
    """Bytes of a message so far, and the times of its packets with the lowest and highest TCP numbers.

    With ``search``, its beginning was searched for, so it may be none; with no bytes yet, the search goes on.
    """

    def __init__(self, body: bytes, low: int, first: int, high: int, last: int, search: bool = False):
        self.body, self.low, self.first, self.high, self.last = bytearray(body), low, first, high, last
        self.length, self.search = None, search

    def add(self, body: bytes, seq: int, ms: int) -> None:
        self.body += body
        if seq <= self.low:
            self.low, self.first = seq, ms
        if seq >= self.high:
            self.high, self.last = seq, ms

    def row(self, what: str, frame_no, place: int, body: bytes | None) -> tuple:
        times = self.low, self.first, self.high, self.last
        return what, frame_no, place, *times, body, self.search, None, None if body is None else len(body)


def _lost(frame_no: int, why: str, size: int) -> tuple:
    return "lost", frame_no, 0, None, None, None, None, None, False, why, size


@dataclass(frozen=True)
class _Framing:
    """What the walk needs to know of a framing."""

    measure: "Measure"
    most: int | None
    largest: int

    def believed(self, start: bytes) -> int | None:
        """The measure; a message beyond the largest length is none."""
        length = self.measure(start)
        return 0 if length is not None and length > self.largest else length


def _feed(tail, packet: tuple, framing: _Framing) -> tuple[list, "_Unfinished | None"]:
    """Messages that end in ``packet`` and bytes lost in it, and the message it leaves unfinished."""
    frame_no, seq, ms, payload = packet
    if tail is None:
        tail = _Unfinished(payload, seq, ms, seq, ms)
    else:
        tail.add(payload, seq, ms)
    found, messages = [], 0
    while framing.most is None or messages < framing.most:
        if tail.length is None:
            tail.length = framing.measure(bytes(tail.body))
        length, size = tail.length, len(tail.body)
        too_long = size > LONGEST_HEADER if length is None else length > framing.largest
        if too_long or length == 0 and tail.search:
            rest = bytes(tail.body)
            start, look = _guess(rest[1:], framing.believed)
            skip = 1 + (look if start is None else start)
            found.append(_lost(frame_no, TOO_LONG if too_long else NO_MESSAGE, skip))
            tail = _Unfinished(rest[skip:], seq, ms, seq, ms, True)
            if start is None:
                return found, tail
            continue
        if length == 0:
            return [*found, _lost(frame_no, NO_MESSAGE, size)], None
        if length is None or size < length:
            return found, tail
        found.append(tail.row("message", frame_no, messages, bytes(tail.body[:length])))
        messages += 1
        rest = bytes(tail.body[length:])
        if not rest:
            return found, None
        tail = _Unfinished(rest, seq, ms, seq, ms)
    return [*found, _lost(frame_no, TOO_MANY, len(tail.body))], None


def _guess(seen: bytes, measure: Measure) -> tuple[int | None, int]:
    """First place in ``seen`` where a message seems to begin and another to follow, if any.

    The second number is where to look on when more bytes have come.
    """
    for at in range(len(seen)):
        if measure(seen[at : at + 16]) == 0:
            continue
        length = measure(seen[at:])
        if length is None:
            return None, at
        if length and (at + length >= len(seen) or measure(seen[at + length :]) != 0):
            return at, at
    return None, len(seen)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The packets of each run of equal keys, without the key columns, and the key."""
    width = len(_PIECE)
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows - 1, bool)
        for column in batch.columns[:width]:
            one, other = column[1:], column[:-1]
            differ = pc.or_(pc.fill_null(pc.not_equal(one, other), False), pc.xor(one.is_null(), other.is_null()))
            changes |= differ.to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        values = batch.select(range(width, batch.num_columns))
        for start, stop in zip(starts, starts[1:]):
            yield values.slice(start, stop - start), [c[start].as_py() for c in batch.columns[:width]]


def _walker(framing: _Framing, guess: bool):
    """Walk sorted partitions; one output row per message, per loss and per chunk's end.

    With ``guess``, a numbered chunk may begin inside a message; the row of its end has ``place`` 1 if so,
    and ``NO_START`` if no message seems to begin in it.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tail, rows, seen, skipped = None, None, [], None, 0

        def ended():
            left = tail or _Unfinished(b"", None, None, None, None)
            place = NO_START if seen is not None else int(skipped)
            rows.append((*key, *left.row("tail", None, place, bytes(left.body) if tail else None)))

        for batch, flow in _runs(batches):
            if flow != key:
                if key is not None:
                    ended()
                key, tail, skipped = flow, None, 0
                seen = b"" if guess and flow[-1] is not None else None
            for frame_no, seq, ms, payload, low, first, search in zip(*[c.to_pylist() for c in batch.columns]):
                if low is not None:  # what the chunk before left unfinished
                    tail = _Unfinished(payload, low, first, seq, ms, search)
                    continue
                if seen is not None:
                    start, look = _guess(seen + payload, framing.believed)
                    skipped |= start != 0
                    if start is None:
                        seen = (seen + payload)[look:]
                        continue
                    payload, seen = (seen + payload)[start:], None
                found, tail = _feed(tail, (frame_no, seq, ms, payload), framing)
                rows.extend((*key, *f) for f in found)
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows.clear()
        if key is not None:
            ended()
        if rows:
            yield _batch(rows)

    return walk


_COLUMNS = pa.schema(
    [
        (name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[kind])
        for name, kind in (column.split() for column in _OUT.split(", "))
    ]
)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _COLUMNS.types)], schema=_COLUMNS)


def _pieces(packets: DataFrame, hot: HotKeys, chunk_rows: int) -> DataFrame:
    """TCP packets with payload, with the chunk they are walked in; short flows have none."""
    chunk: Column = F.lit(None).cast("bigint")
    if hot.table is not None and hot.broadcast:
        packets = packets.join(F.broadcast(hot.table.withColumn("is_hot", F.lit(True))), FLOW, "left")
        chunk = F.when(F.col("is_hot"), chunk_of("frame_no", chunk_rows)).otherwise(chunk)
    elif hot.table is not None:
        chunk = chunk_of("frame_no", chunk_rows)
    none = F.lit(None).cast("bigint")
    return packets.select(
        *FLOW, chunk.alias("chunk"), "frame_no", "tcp_seq", "ts_ms", "payload", none.alias("low"), none.alias("first"),
        F.lit(False).alias("search"),
    )


@dataclass(frozen=True)
class Reassembled:
    """``messages``: one row per whole message. ``unfinished``: flows that end inside a message. ``losses``: bytes that
    are in neither (flow, frame_no, why and bytes; no frame_no where a flow ends while the next message is searched for)."""

    messages: DataFrame
    unfinished: DataFrame
    losses: DataFrame


def reassemble_messages(packets: DataFrame, measure: Measure, **options) -> DataFrame:
    """The ``messages`` of ``reassemble``."""
    return reassemble(packets, measure, **options).messages


def reassemble(
    packets: DataFrame,
    measure: Measure,
    max_messages_per_packet: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
    largest: int = LARGEST_MESSAGE,
) -> Reassembled:
    """SRC-6, PRJ-12, PRJ-13, SO-4: the whole messages in the TCP payload, one row each.

    ``packets`` need their ``payload``. Payload is appended in capture order, without reordering and
    without removing repeats; bytes that begin no message are skipped up to the next packet.
    ``first_ms`` and ``last_ms`` are the times of the packets with the lowest and highest TCP numbers.
    ``msg_no`` orders messages by the packet they end in. All messages of a packet are found;
    ``max_messages_per_packet=3`` loses what follows the third. A message of more than ``largest`` bytes, or with a header
    of more than ``LONGEST_HEADER``, is taken for damage: the next place is searched where a message begins and, as far as
    its packet shows, another follows. Runs jobs, and stages the result.
    """
    framing = _Framing(measure, max_messages_per_packet, largest)
    carrying = packets.where("l4 = 'tcp' and tcp_payload_len > 0 and length(payload) > 0")
    hot = hot_keys(carrying, FLOW, chunk_rows)
    pieces = _pieces(carrying, hot, chunk_rows)

    def walked(rows: DataFrame, guess: bool) -> DataFrame:
        lines = rows.repartition(*_PIECE).sortWithinPartitions(*_PIECE, "frame_no")
        return staged(lines.mapInArrow(_walker(framing, guess), _OUT), "messages")

    found = walked(pieces, True)
    ends = found.where("what = 'tail' and chunk is null").select(*FLOW, "body", "search")
    if hot.table is not None:
        found, last = _mend(found, pieces, walked, chunk_rows)
        ends = ends.unionByName(last)
    messages = found.where("what = 'message'").select(
        *FLOW,
        (F.col("frame_no") * MESSAGE_STEP + F.col("place")).alias("msg_no"),
        "first_ms",
        "last_ms",
        F.col("body").alias("message"),
    )
    left = ends.where("length(body) > 0").withColumn("bytes", F.length("body").cast("bigint"))
    no_frame = F.lit(None).cast("bigint").alias("frame_no")
    searching = left.where("search").select(*FLOW, no_frame, F.lit(NO_MESSAGE).alias("why"), "bytes")
    losses = found.where("what = 'lost'").select(*FLOW, "frame_no", "why", "bytes").unionByName(searching)
    return Reassembled(messages, left.where("not search").select(*FLOW, "bytes"), losses)


def _chunk_runs(ends: DataFrame, chunk_rows: int) -> DataFrame:
    """The run (its first chunk) of every chunk, and whether it has ``several``: a chunk in which no message seems to begin
    goes with the one before it, up to ``CHUNK_ROWS`` packets."""
    order = Window.partitionBy(*FLOW).orderBy("chunk")
    begins = F.max(F.when(F.col("place") < NO_START, F.col("nth"))).over(order)
    numbered = ends.select(*_PIECE, "place", F.row_number().over(order).alias("nth"))
    begun = numbered.withColumn("begin", F.coalesce(begins, F.lit(1)))
    most = F.lit(max(1, CHUNK_ROWS // chunk_rows))
    begun = begun.withColumn("begin", F.col("nth") - (F.col("nth") - F.col("begin")) % most)
    run = Window.partitionBy(*FLOW, "begin")
    return begun.select(*_PIECE, F.min("chunk").over(run).alias("run"), (F.count("*").over(run) > 1).alias("several"))


def _mend(found: DataFrame, pieces: DataFrame, walked: Callable[[DataFrame, bool], DataFrame], chunk_rows: int):
    """Walk chunks again until each was given the unfinished message that its predecessor left.

    A message that spans many chunks makes one run of them, which is then walked as one chunk; so the number of rounds does
    not grow with its length.
    """
    nothing = F.struct(*[F.col(c) for c in _TAIL])
    left = nothing.alias("left")
    pieces = pieces.where("chunk is not null")
    guessed = (F.col("place") > 0).alias("guessed")
    tails = found.where("what = 'tail' and chunk is not null")
    runs = staged(_chunk_runs(tails, chunk_rows), "chunk-runs")

    def again(chosen: DataFrame) -> DataFrame:
        """The packets of the chosen runs, each as one chunk."""
        parts = staged(runs.join(chosen.withColumnRenamed("chunk", "run"), [*FLOW, "run"], "left_semi"), "chunks-again")
        parts = parts.select(*_PIECE, "run")
        parts = F.broadcast(parts) if parts.count() <= BROADCAST_KEYS else parts
        return pieces.join(parts, _PIECE).withColumn("chunk", F.col("run")).select(pieces.columns)

    ends = tails.select(*_PIECE, left, guessed, F.lit(0).alias("round"))
    rounds, replaced, number = [found.withColumn("round", F.lit(0))], [], 0
    several = runs.where("several")
    if not several.isEmpty():
        number = 1
        rounds.append(walked(again(several.select(*FLOW, F.col("run").alias("chunk")).distinct()), True))
        rounds[1] = rounds[1].withColumn("round", F.lit(number))
        replaced.append(several.select(*_PIECE, F.lit(0).alias("round")))
        ends = ends.join(several.select(*_PIECE), _PIECE, "left_anti").unionByName(
            rounds[1].where("what = 'tail'").select(*_PIECE, left, guessed, "round")
        )
    ends = ends.withColumn("given", F.when(F.lit(False), F.col("left")))
    while True:
        before = F.lag("left").over(Window.partitionBy(*FLOW).orderBy("chunk"))
        due = F.when(before["body"].isNotNull(), before)
        ends = staged(ends, "chunk-ends")
        wrong = ends.withColumn("due", due).where("guessed or not (due <=> given)")
        wrong = staged(wrong, "chunks-wrong")
        count = wrong.count()
        if count == 0:
            break
        number += 1
        chosen = F.broadcast(wrong.select(*_PIECE)) if count <= BROADCAST_KEYS else wrong.select(*_PIECE)
        first_line = wrong.where("due is not null").select(
            *_PIECE,
            F.lit(-1).cast("bigint").alias("frame_no"),
            F.col("due.high_seq").alias("tcp_seq"),
            F.col("due.last_ms").alias("ts_ms"),
            F.col("due.body").alias("payload"),
            F.col("due.low_seq").alias("low"),
            F.col("due.first_ms").alias("first"),
            F.col("due.search").alias("search"),
        )
        new = walked(again(wrong.select(*_PIECE)).unionByName(first_line), False)
        rounds.append(new.withColumn("round", F.lit(number)))
        replaced.append(wrong.select(*_PIECE, "round"))
        given = wrong.select(*_PIECE, F.col("due").alias("given"))
        fresh = new.where("what = 'tail'").select(*_PIECE, left, guessed, F.lit(number).alias("round"))
        fresh = fresh.join(given, _PIECE)
        ends = ends.join(chosen, _PIECE, "left_anti").unionByName(fresh)
    messages = rounds[0]
    for more in rounds[1:]:
        messages = messages.unionByName(more)
    if replaced:
        old = replaced[0]
        for more in replaced[1:]:
            old = old.unionByName(more)
        messages = messages.join(old, [*_PIECE, "round"], "left_anti")
    last = ends.groupBy(*FLOW).agg(F.max_by("left", "chunk").alias("left"))
    return messages, last.select(*FLOW, "left.body", "left.search")


def length_prefixed(start: bytes) -> int | None:
    """A simple framing: a four-byte big-endian length, then that many bytes."""
    return None if len(start) < 4 else 4 + int.from_bytes(start[:4], "big")
