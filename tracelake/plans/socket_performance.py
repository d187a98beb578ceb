"""The socket-performance job: messages to flows, segments and metric series."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scan import CHUNK_ROWS
from tracelake.functions.staging import staged
from tracelake.operators import handshakes as hs
from tracelake.operators.metrics import socket_metrics
from tracelake.operators.ordering import in_scope
from tracelake.operators.routing import assign_messages, flow_events
from tracelake.operators.segments import close_early, flow_health, flow_stats, segments


@dataclass(frozen=True)
class SocketPerformance:
    flows: DataFrame
    segments: DataFrame
    stats: DataFrame

    def health(self) -> DataFrame:
        return flow_health(self.stats, self.segments, [c for c in ("scope", "flow", "rem_pos") if c in self.stats.columns])

    def metrics(self) -> DataFrame:
        return socket_metrics(self.flows, self.segments)


def handshake_table(ordered: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All matched handshakes of messages from ``in_scope``, staged: later steps read them several times."""
    return staged(hs.match_handshakes(ordered, chunk_rows), "handshakes")


def socket_performance(
    messages: DataFrame,
    scope: str = "trace",
    early_close: str = "toggle",
    chunk_rows: int = CHUNK_ROWS,
    number_step: int = 1,
    keep: str = "last",
) -> SocketPerformance:
    """Flows, segments and statistics of a ``messages`` table, which is read several times.

    ``number_step``: the usual distance of two ``msg_no``, ``MESSAGE_STEP`` for reassembled messages. ``keep="all"`` takes
    every handshake for a flow, also where a later one on its data pipe replaces it; ``rem_pos``, the place of the response,
    then tells the flows of a pipe apart.
    """
    ordered = in_scope(messages, scope, chunk_rows, number_step)
    matched = handshake_table(ordered, chunk_rows)
    flows = hs.flow_table(matched, keep)
    assigned = staged(assign_messages(ordered, matched, chunk_rows), "assigned")
    events = staged(flow_events(assigned, flows, keep, chunk_rows), "events")
    events, progress, points = close_early(events, early_close, chunk_rows)
    segs, stats = segments(events, progress), flow_stats(flows, progress, points)
    if keep == "all":
        names = ["flow.pipe", F.col("flow.rem").alias("rem_pos")]
        segs, stats = (df.select("scope", *names, *df.columns[2:]).withColumnRenamed("pipe", "flow") for df in (segs, stats))
    return SocketPerformance(flows, segs, stats)
