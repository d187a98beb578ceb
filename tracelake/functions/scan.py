"""Running values over an ordered key, without ever giving one task more than a bounded part of it.

Keys with few rows use a plain window. A key with more than ``chunk_rows`` rows is cut into chunks of
its order column: each (key, chunk) is scanned on its own, one summary row per (key, chunk) is scanned
by key, and what it carries into each chunk is joined back on (key, chunk).
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.staging import staged

CHUNK_ROWS = 1 << 20
# Most keys that are sent to every task; each is a few dozen bytes.
BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class Running:
    """One running column.

    ``how``: ``sum``, ``max`` or ``last`` (latest value that is not null).
    ``rows``: ``through`` the current row, only those ``before`` it, or the ``whole`` key.
    """

    name: str
    value: Column
    how: str
    rows: str = "through"

    def total(self, place: Column) -> Column:
        if self.how == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), place))
        return F.sum(self.value) if self.how == "sum" else F.max(self.value)

    def over(self, value: Column, window, last_row: int) -> Column:
        window = window.rowsBetween(Window.unboundedPreceding, last_row)
        if self.how == "last":
            return F.last(value, ignorenulls=True).over(window)
        if self.how == "sum":
            return F.coalesce(F.sum(value).over(window), F.lit(0))
        return F.max(value).over(window)

    def join(self, carry: Column, here: Column) -> Column:
        if self.how == "sum":
            return carry + here
        return F.greatest(carry, here) if self.how == "max" else F.coalesce(here, carry)

    @property
    def last_row(self) -> int:
        return {"through": 0, "before": -1, "whole": Window.unboundedFollowing}[self.rows]


@dataclass(frozen=True)
class HotKeys:
    """The keys too large for one task. ``table`` is null when there are none.

    ``broadcast``: there are ``BROADCAST_KEYS`` at most. ``largest`` are these or, of more, the ``BROADCAST_KEYS`` with the
    most rows, so that no other key has more than that part of all rows.
    """

    names: list[str]
    table: DataFrame | None
    broadcast: bool
    largest: DataFrame | None = None

    def once(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, staged if there are hot keys: ``running`` then reads it several times."""
        return df if self.table is None else staged(df, name)


def chunk_of(order: str, chunk_rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of an integer order column; at most ``chunk_rows`` distinct orders share one."""
    return F.call_function("div", F.col(order), F.lit(chunk_rows).cast("bigint"))


def hot_keys(df: DataFrame, names: list[str], chunk_rows: int = CHUNK_ROWS) -> HotKeys:
    """Count the rows of each key (a partial aggregate) and keep the keys above ``chunk_rows``.

    Runs a job; the driver learns only how many hot keys there are.
    """
    counts = df.groupBy(*names).agg(F.count("*").alias("_rows"))
    hot = staged(counts.where(F.col("_rows") > chunk_rows), "hot-keys")
    number = hot.count()
    if number == 0:
        return HotKeys(names, None, False)
    table = hot.select(*names)
    if number <= BROADCAST_KEYS:
        return HotKeys(names, table, True, table)
    largest = hot.orderBy(F.desc("_rows")).limit(BROADCAST_KEYS).select(*names)
    return HotKeys(names, table, False, staged(largest, "largest-keys"))


def join_by_key(many: DataFrame, one: DataFrame, keys: list[str], hot: HotKeys, how: str = "inner") -> DataFrame:
    """Join rows of ``many`` with ``one``, which has one row for a key at most, and give no task all rows of a hot key.

    ``hot`` names ``keys`` or some of them, which both sides have. The largest keys are sent to every task, and their rows
    stay where they are; the others meet in a shuffle. ``how``: inner, left, left_semi or left_anti.
    """
    if hot.table is None:
        return many.join(one, keys, how)
    few = F.broadcast(hot.largest)
    cold = many.join(few, hot.names, "left_anti").join(one, keys, how)
    known = F.broadcast(one.join(few, hot.names, "left_semi"))  # one row for each of BROADCAST_KEYS at most
    return cold.unionByName(many.join(few, hot.names, "left_semi").join(known, keys, how))


def running(
    df: DataFrame, keys: list[str], order: list[str], chunk: list[str], columns: list[Running], hot: HotKeys
) -> DataFrame:
    """Add the running ``columns`` to ``df``.

    ``order`` must be unique within a key, ``chunk`` must not decrease along it, and neither ``keys``
    nor ``chunk`` may be null. ``hot`` names ``keys`` or some of them. ``df`` should not come out of a
    shuffle by some of ``keys``: Spark would keep that partitioning, and a hot key in one task. With hot keys ``df`` is
    read three times, so it should be a table (``HotKeys.once``).
    """
    if hot.table is None:
        return _by_key(df, keys, order, columns)
    few = F.broadcast(hot.largest)
    cold = _by_key(df.join(few, hot.names, "left_anti"), keys, order, columns)
    return cold.unionByName(_by_chunk(df.join(few, hot.names, "left_semi"), keys, order, chunk, columns))


def _by_key(df: DataFrame, keys: list[str], order: list[str], columns: list[Running]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", *[c.over(c.value, window, c.last_row).alias(c.name) for c in columns])


def _by_chunk(
    df: DataFrame, keys: list[str], order: list[str], chunk: list[str], columns: list[Running]
) -> DataFrame:
    part = [*keys, *chunk]
    totals = df.groupBy(*part).agg(*[c.total(F.struct(*order)).alias(f"_{c.name}") for c in columns])
    chunks = Window.partitionBy(*keys).orderBy(*chunk)
    carries = totals.select(
        *part,
        *[
            c.over(F.col(f"_{c.name}"), chunks, c.last_row if c.rows == "whole" else -1).alias(f"_{c.name}")
            for c in columns
        ],
    )
    rows = Window.partitionBy(*part).orderBy(*order)
    local = df.select(
        "*", *[c.over(c.value, rows, c.last_row).alias(c.name) for c in columns if c.rows != "whole"]
    )

    def final(c: Running) -> Column:
        carry = F.col(f"_{c.name}")
        return carry if c.rows == "whole" else c.join(carry, F.col(c.name))

    return local.join(carries, part).select(*df.columns, *[final(c).alias(c.name) for c in columns])
