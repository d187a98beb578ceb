"""Capture files to a ``packets`` table, in pieces that do not follow file boundaries.

A file is cut into byte ranges. Records chain from one to the next, but where the first record of a range begins only the
range before can tell. So every range is walked once from all places near its beginning that could be record headers
and lead to another. Chains soon run into each other, and what is kept of a range is a small map: from the place where it is entered to the
place where it leaves. These maps are composed by doubling: each round, every chain learns where it leads after twice as
many ranges, so even a file of a million ranges, all guessed wrong, is put in order in twenty rounds over the small maps.

A record header that cannot be one breaks the chain. Reading goes on at the next place where a chain begins, in the same
range or in the next one; so damage costs its own bytes and no more rounds. A range is walked again only where it is
entered at a valid header that does not look like one. What is left out is listed with file, offset and bytes.
"""

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracelake.functions.staging import staged
from tracelake.schemas import PACKETS
from tracelake.sources.frames import FILE_HEADER, RECORD_HEADER, TRUSTED_LINKS, FileHeader, packet_batch

SPLIT_BYTES = 128 << 20
SYNC_BYTES = 4 << 20
FIRST_LOOK = 1 << 16
BATCH_RECORDS = 16384
MOST_TASKS = 50_000
# Bytes of captures for a task, at least: where ranges are smaller, a task has several of them.
TASK_BYTES = 32 << 20

_LOSS = T.StructType(
    [T.StructField("at", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("why", T.StringType())]
)
_CHAIN = T.StructType(
    [
        T.StructField("offsets", T.ArrayType(T.LongType())),  # where the range may be entered to get onto this chain
        T.StructField("lead", T.IntegerType()),  # 1 if no record begins at the first of them
        T.StructField("records", T.LongType()),
        T.StructField("next", T.LongType()),  # where the chain leaves the range, if that is known
        T.StructField("damaged", T.BooleanType()),  # whether the header there cannot be one
        T.StructField("stop", T.LongType()),  # records that begin before this are its own
        T.StructField("lost", T.ArrayType(_LOSS)),
    ]
)
_RANGES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("split_no", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("given", T.ArrayType(T.LongType())),
        T.StructField("error", T.StringType()),
        T.StructField("trusted", T.ArrayType(T.LongType())),
        T.StructField("chains", T.ArrayType(_CHAIN)),
    ]
)
_RANGE_COLUMNS = to_arrow_schema(_RANGES)
DAMAGED, CUT_OFF = "damaged", "cut off"


def _open(path: str):
    """A random-access file on any storage that Arrow reaches; local paths come as ``file:/...``."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    scheme, _, rest = path.partition("://")
    system, name = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{quote(rest, safe='/:@')}")
    return system.open_input_file(name)


def _resume(header: FileHeader, source, at: int, end: int, length: int) -> int | None:
    """The first place from ``at`` on, and before ``end``, where a trusted chain of records begins."""
    want = FIRST_LOOK
    while at < end:
        block = source.read_at(min(want, length - at), at)
        want = min(4 * want, SYNC_BYTES)
        sure = len(block) if at + len(block) >= length else len(block) // 2  # a chain needs room to show
        found = header.first_trusted(block, length - at)
        if found is not None and found < sure:
            return at + found if at + found < end else None
        at += sure
    return None


def _walk(
    header: FileHeader, source, first: int, end: int, length: int, lost: list[dict], want: int = 4 << 20
) -> Iterator[tuple[bytes, int | None, list[int]]]:
    """Blocks of whole records from ``first`` on: ``(block, file offset, record starts in the block)``.

    Covers the records that begin before ``end``; a last, empty block says where the next record is, or None where that is
    not known. What is no record goes to ``lost``: a header with an impossible length and what follows it up to the next
    chain of records, and a last record that the end of the file cuts off.
    """
    at = first
    while at < end:
        block = source.read_at(min(want, length - at), at)
        starts, here, after = [], 0, at
        while after == at + here < end:
            if after + RECORD_HEADER <= length and here + RECORD_HEADER > len(block):
                break
            size = header.record.unpack_from(block, here)[2] if after + RECORD_HEADER <= length else 0
            if size <= header.limit and after + RECORD_HEADER + size <= length:
                if here + RECORD_HEADER + size > len(block):
                    break
                starts.append(here)
                here += RECORD_HEADER + size
                after = at + here
                continue
            damaged = size > header.limit
            again = _resume(header, source, after + 1, end, length) if damaged else length
            stop = end if again is None else again
            lost.append({"at": after, "bytes": stop - after, "why": DAMAGED if damaged else CUT_OFF})
            after = again
            if again is not None and again - at < len(block):
                here = again - at
        yield block, at, starts
        if after is None:
            yield b"", None, []
            return
        want = FIRST_LOOK if after > at + here else max(want, min(2 * want, 4 << 20)) if here else want * 2
        at = after
    yield b"", at, []


class _Chain:
    """The records from ``first`` on that begin before ``end``, up to where they run into one of ``others``.

    A record after ``end`` that damage follows is its own, too: nothing in its range would tell that it is one.
    """

    def __init__(self, header: FileHeader, source, first: int, end: int, length: int, others: list["_Chain"]):
        self.first, self.lost, self.next, self.damaged, self.stop = first, [], None, False, end
        found: list[np.ndarray] = []
        for _, at, places in _walk(header, source, first, end, length, self.lost, 4 << 20 if not others else 1 << 16):
            self.next, here = at, np.array(places, np.int64) + (at or 0)
            met = [(int(np.flatnonzero(both)[0]), other) for other in others if (both := other.holds(here)).any()]
            if met:
                stop, other = min(met, key=lambda m: m[0])
                found.append(here[:stop])
                self._goes_on_as(other, int(here[stop]), found)
                return
            found.append(here)
        self.starts = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.records = len(self.starts)
        if self.next is not None and self.next < length:
            if self.next + RECORD_HEADER > length:
                self.lost.append({"at": self.next, "bytes": length - self.next, "why": CUT_OFF})
                self.next = length
            else:
                size = header.record.unpack_from(source.read_at(RECORD_HEADER, self.next))[2]
                self.damaged = size > header.limit
                after = self.next + RECORD_HEADER + size
                if not self.damaged and after + RECORD_HEADER <= length:
                    follows = header.record.unpack_from(source.read_at(RECORD_HEADER, after))[2]
                    if follows > header.limit:
                        self.records, self.stop = self.records + 1, self.next + 1
                        self.next, self.damaged = after, True

    def _goes_on_as(self, other: "_Chain", at: int, found: list[np.ndarray]) -> None:
        self.starts = np.concatenate(found)
        self.records = len(self.starts) + other.records - int(np.searchsorted(other.starts, at))
        self.next, self.damaged, self.stop = other.next, other.damaged, other.stop
        self.lost = [loss for loss in self.lost if loss["at"] < at] + [loss for loss in other.lost if loss["at"] >= at]

    def holds(self, places: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(len(places), bool)
        at = np.minimum(np.searchsorted(self.starts, places), len(self.starts) - 1)
        return self.starts[at] == places

    def row(self, until: int) -> dict:
        entries = self.starts[: np.searchsorted(self.starts, until)].tolist()
        lead = int(not len(self.starts) or self.starts[0] != self.first)
        entries = [self.first, *entries] if lead or not entries else entries
        return {
            "offsets": entries, "lead": lead, "records": self.records, "next": self.next, "damaged": self.damaged,
            "stop": self.stop, "lost": self.lost,
        }


_NO_CHAIN = {"offsets": [], "lead": 0, "records": 0, "next": None, "damaged": False, "stop": None, "lost": []}


def _walk_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each byte range may be entered, and where it is left then."""
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pylist([_walk_range(row)], schema=_RANGE_COLUMNS)


def _walk_range(row: dict) -> dict:
    start, end, length = row["start"], row["end"], row["length"]
    with _open(row["path"]) as source:
        try:
            header = FileHeader(source.read_at(min(FILE_HEADER, length), 0))
        except ValueError as problem:
            return {**row, "error": str(problem), "trusted": [], "chains": []}
        until = start + min(end - start, header.limit + RECORD_HEADER, SYNC_BYTES)
        if row["split_no"] == 0:
            entries, trusted = [FILE_HEADER], [FILE_HEADER]
        else:
            entries, trusted = _entries(header, source, start, until, length)
            if not trusted:
                later = _resume(header, source, start, end, length)
                trusted = [] if later is None else [later]
        chains: list[_Chain] = []
        pending = np.array(entries, np.int64)
        first = trusted[:1]
        while first or len(pending):
            chain = _Chain(header, source, first[0] if first else int(pending[0]), end, length, chains)
            chains.append(chain)
            pending, first = pending[~chain.holds(pending) & (pending != chain.first)], []
        for at in row["given"] or []:
            if not any(chain.first == at or chain.holds(np.array([at])).any() and at < until for chain in chains):
                chains.append(_Chain(header, source, at, end, length, chains))
    return {**row, "error": None, "trusted": trusted, "chains": [*(chain.row(until) for chain in chains), _NO_CHAIN]}


def _entries(header: FileHeader, source, start: int, until: int, length: int) -> tuple[list[int], list[int]]:
    """Places from ``start`` on, and before ``until``, that lead from one record to another, and the trusted ones of them."""
    block = source.read_at(min(until - start + FIRST_LOOK, SYNC_BYTES, length - start), start)
    near = header.likely(block)
    inside = near < until - start
    whole = None

    def asked(links: int, among: np.ndarray) -> np.ndarray:
        nonlocal whole
        known, unsure = header.chained(block, near, length - start, links)
        for i in np.flatnonzero(unsure & among).tolist():  # their chains leave the block
            whole = source.read_at(min(SYNC_BYTES, length - start), start) if whole is None else whole
            known[i] = header.trusted(whole, int(near[i]), length - start, links)
        return known & among

    linked = asked(2, inside)
    return (start + near[linked]).tolist(), (start + near[asked(TRUSTED_LINKS, linked)]).tolist()


def index_captures(
    spark: SparkSession,
    path: str,
    mode: str = "FAILFAST",
    split_bytes: int = SPLIT_BYTES,
    most_tasks: int = MOST_TASKS,
) -> DataFrame:
    """SRC-1, SRC-3: one row per byte range with its first record, its number of records and what of it was lost.

    The listing reads no file contents. With ``mode="FAILFAST"`` a file that is no capture, or has damage in it, fails the
    job with the places; with ``"DROPMALFORMED"`` such files and bytes are left out, and ``capture_losses`` lists them. A
    last record that the end of its file cuts off is listed too but is no failure. Runs jobs, at most ``most_tasks`` tasks
    each; the driver sees counts and up to five places.
    """
    if mode not in ("FAILFAST", "DROPMALFORMED"):
        raise ValueError(f"mode must be 'FAILFAST' or 'DROPMALFORMED', not {mode!r}")
    index = _index(spark, path, split_bytes, most_tasks)
    if mode == "FAILFAST":
        bad = _losses(index).where(F.col("why") != CUT_OFF).orderBy("path", "at").limit(5).collect()
        if bad:
            places = "; ".join(f"{r['path']}: {r['bytes']} bytes at {r['at']}: {r['why']}" for r in bad)
            raise ValueError(f"unreadable captures: {places}")
    return index.where("error is null")


def capture_losses(
    spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, most_tasks: int = MOST_TASKS
) -> DataFrame:
    """SRC-3: path, at, bytes and why of all that ``read_pcap`` leaves out with ``mode="DROPMALFORMED"``.

    ``why`` is "damaged", "cut off" (by the end of the file) or the reason why a whole file is no capture.
    """
    return _losses(_index(spark, path, split_bytes, most_tasks))


def _losses(index: DataFrame) -> DataFrame:
    """Losses inside ranges, and whole files."""
    inside = index.where("error is null").select("path", F.inline("lost"))
    files = index.where("error is not null and split_no = 0").select(
        "path", F.lit(0).cast("bigint").alias("at"), F.col("length").alias("bytes"), F.col("error").alias("why")
    )
    return inside.union(files)


def _index(spark: SparkSession, path: str, split_bytes: int, most_tasks: int) -> DataFrame:
    """The ranges of all files, also of those that are no captures, with the records that are in them."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    size = F.lit(split_bytes).cast("bigint")
    last = F.greatest(F.call_function("div", F.col("length") - 1, size), F.lit(0))
    ranges = files.withColumn("split_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    ranges = ranges.select(
        "path",
        "length",
        "split_no",
        (F.col("split_no") * size).alias("start"),
        F.least("length", (F.col("split_no") + 1) * size).alias("end"),
        F.array().cast("array<bigint>").alias("given"),
    )
    columns = ranges.columns
    tasks = _tasks(ranges, "start", most_tasks)
    walked = staged(ranges.repartition(tasks).mapInArrow(_walk_ranges, _RANGES), "capture-index")
    while True:
        edges = staged(_edges(walked, split_bytes), "capture-edges")
        # As a rule the first chain of each range leads to the first one of the next.
        odd = edges.where("chain_no = 0 and not (to_split = split_no + 1 and into = 0)")
        if odd.isEmpty():
            return staged(_placed(walked, edges.where("chain_no = 0")), "capture-index")
        reached = _reached(edges, odd.select("path").distinct())
        entries = edges.join(reached, ["path", "split_no", "chain_no"], "left_semi")
        unknown = entries.where("into < 0").groupBy("path", F.col("to_split").alias("split_no"))
        unknown = staged(unknown.agg(F.collect_set("first").alias("more")), "capture-again")
        if unknown.isEmpty():
            return staged(_placed(walked, entries), "capture-index")
        again = walked.join(unknown, ["path", "split_no"]).withColumn("given", F.array_union("given", "more"))
        fixed = again.select(columns).repartition(_tasks(again, "start", most_tasks)).mapInArrow(_walk_ranges, _RANGES)
        walked = staged(walked.join(unknown, ["path", "split_no"], "left_anti").unionByName(fixed), "capture-index")


def _tasks(ranges: DataFrame, begin: str, most_tasks: int) -> int:
    """Into how many tasks to deal ranges: one for each, or fewer where ranges are small."""
    size = F.sum(F.greatest(F.col("end") - F.col(begin), F.lit(0)))
    number, total = ranges.agg(F.count("*"), F.coalesce(size, F.lit(0))).collect()[0]
    enough = max(-(-total // TASK_BYTES), ranges.sparkSession.sparkContext.defaultParallelism)
    return max(1, min(number, most_tasks, enough))


def _edges(walked: DataFrame, split_bytes: int) -> DataFrame:
    """For each chain of each range: the range it leads to (to_split), where that is due to be entered, the first record
    there, and the chain of it (into, -1 if none is known). A file's first range is entered by a row of its own."""
    good = walked.where("error is null")
    left = good.select("path", "length", "split_no", F.posexplode("chains").alias("chain_no", "chain"))
    following = F.coalesce(F.call_function("div", F.col("chain.next"), F.lit(split_bytes).cast("bigint")), F.col("split_no") + 1)
    left = left.select(
        "path", "length", "split_no", "chain_no", "chain.next", "chain.damaged", following.alias("to_split")
    ).where(F.coalesce("next", F.col("to_split") * split_bytes) < F.col("length"))
    there = good.select("path", F.col("split_no").alias("to_split"), "start", "trusted", "chains")
    first = (
        F.when(F.col("next").isNull(), F.get("trusted", F.lit(0)))
        .when(F.col("damaged"), F.array_min(F.filter("trusted", lambda at: at > F.col("next"))))
        .otherwise(F.col("next"))
    )
    on_it = F.transform("chains", lambda chain: F.array_contains(chain["offsets"], F.col("first")))
    into = F.when(F.col("first").isNull(), F.size("chains") - 1).otherwise(F.array_position(on_it, F.lit(True)) - 1)
    edges = left.join(there, ["path", "to_split"]).withColumn("first", first)
    edges = edges.select(
        "path", "split_no", "chain_no", "to_split", F.coalesce("next", "start").alias("due"), "first",
        into.cast("int").alias("into"),
    )
    begin = F.lit(FILE_HEADER).cast("bigint")
    begins = good.where("split_no = 0").select(
        "path", F.lit(-1).cast("bigint").alias("split_no"), F.lit(0).alias("chain_no"), "split_no", begin.alias("due"),
        begin.alias("first"), F.lit(0).alias("into"),
    )
    return edges.union(begins)


def _reached(edges: DataFrame, odd: DataFrame) -> DataFrame:
    """The chains (path, split_no, chain_no) that lie on the way from the beginning of their file.

    These are the first ones of the ranges, but for the files ``odd``. There the ways are doubled: a round adds what is as
    many steps ahead as all rounds before have covered.
    """
    node = ["path", "split_no", "chain_no"]
    other = staged(odd, "capture-jumps")
    straight = edges.where("chain_no = 0").join(other, "path", "left_anti").select(node)
    jumps = edges.where("into >= 0").join(other, "path", "left_semi").select(*node, "to_split", "into")
    jumps = staged(jumps, "capture-jumps")
    reached = jumps.where("split_no = -1").select(node)
    while not jumps.isEmpty():
        ends = [F.col("to_split").alias("split_no"), F.col("into").alias("chain_no")]
        ahead = jumps.join(reached, node, "left_semi").select("path", *ends)
        reached = staged(reached.union(ahead), "capture-jumps")
        begins = [F.col("split_no").alias("begin_split"), F.col("chain_no").alias("begin_chain")]
        twice = jumps.select("path", *begins, *ends).join(jumps, node)
        begins = [F.col("begin_split").alias("split_no"), F.col("begin_chain").alias("chain_no")]
        jumps = staged(twice.select("path", *begins, "to_split", "into"), "capture-jumps")
    return straight.union(reached.distinct())


def _placed(walked: DataFrame, entries: DataFrame) -> DataFrame:
    """The ranges with the first of their records, how many there are, and what of them was lost on the way."""
    entered = entries.select("path", F.col("to_split").alias("split_no"), "due", "first", "into")
    ranges = walked.join(entered, ["path", "split_no"], "left").withColumn("chain", F.get("chains", F.col("into")))
    begun = F.array_position(F.col("chain.offsets"), F.col("first")) - 1 - F.col("chain.lead")
    records = F.col("chain.records") - F.greatest(begun, F.lit(0))
    stop = F.coalesce("first", "end")
    gap = F.struct(F.col("due").alias("at"), (stop - F.col("due")).alias("bytes"), F.lit(DAMAGED).alias("why"))
    none = F.array().cast(T.ArrayType(_LOSS))
    later = F.coalesce(F.filter("chain.lost", lambda loss: loss["at"] >= F.col("first")), none)
    return ranges.select(
        "path", "length", "split_no", "start", F.coalesce("chain.stop", "end").alias("end"), "first",
        F.col("chain.next").alias("next"),
        F.when(F.col("first").isNull(), 0).otherwise(records).cast("bigint").alias("records"), "error",
        F.concat(F.when(F.col("due") < stop, F.array(gap)).otherwise(none), later).alias("lost"),
    )


def _decode(names: list[str], payload: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number = row["first_no"]
                with _open(row["path"]) as source:
                    header = FileHeader(source.read_at(FILE_HEADER, 0))
                    for block, _, starts in _walk(header, source, row["first"], row["end"], row["length"], []):
                        for i in range(0, len(starts), BATCH_RECORDS):
                            some = np.array(starts[i : i + BATCH_RECORDS], np.int64)
                            yield packet_batch(header, block, some, row["path"], number, names, payload)
                            number += len(some)

    return decode


def read_pcap(
    spark: SparkSession,
    path: str,
    mode: str = "FAILFAST",
    payload: bool = False,
    split_bytes: int = SPLIT_BYTES,
    most_tasks: int = MOST_TASKS,
    columns: list[str] | None = None,
) -> DataFrame:
    """SRC-1, SRC-2, SRC-4: all packets of a capture file, or of all captures in a folder.

    Frames are numbered from 1 in each file. Lengths are the declared ones; ports are known only for
    packets whose transport header was captured and that are not later fragments. ``payload=True`` adds
    the captured TCP payload bytes. ``mode`` is that of ``index_captures``.

    With ``columns``, only these are decoded and returned: a count of frames reads no addresses, and columns of the record
    header need no layer below it. Python tasks are not told what a query uses of their output, so it is said here.
    """
    return _packets(index_captures(spark, path, mode, split_bytes, most_tasks), payload, most_tasks, columns)


def read_pcap_and_losses(
    spark: SparkSession,
    path: str,
    payload: bool = False,
    split_bytes: int = SPLIT_BYTES,
    most_tasks: int = MOST_TASKS,
    columns: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``read_pcap`` with ``mode="DROPMALFORMED"`` and the ``capture_losses`` beside it, of one index."""
    index = _index(spark, path, split_bytes, most_tasks)
    return _packets(index.where("error is null"), payload, most_tasks, columns), _losses(index)


def _packets(index: DataFrame, payload: bool, most_tasks: int, columns: list[str] | None) -> DataFrame:
    """The packets in the ranges of ``index``."""
    known = [*PACKETS.names, "ts"]
    if columns is not None and (not columns or not set(columns) <= set(known)):
        raise ValueError(f"columns must be some of {known}, not {columns}")
    asked = known if columns is None else list(columns)
    fields = [f for f in PACKETS.fields if f.name in asked or f.name == "ts_us" and "ts" in asked]
    names = [f.name for f in fields]
    before = Window.partitionBy("path").orderBy("split_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = index.withColumn("first_no", F.coalesce(F.sum("records").over(before), F.lit(0)) + 1)
    busy = staged(numbered.where("records > 0").select("path", "length", "end", "first", "first_no"), "capture-ranges")
    tasks = _tasks(busy, "first", most_tasks)
    whole = payload or columns is not None and "payload" in columns
    packets = busy.repartition(tasks).mapInArrow(_decode(names, whole), T.StructType(fields))
    return (packets.withColumn("ts", F.timestamp_micros("ts_us")) if "ts" in asked else packets).select(*asked)
