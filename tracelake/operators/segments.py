"""Per-flow progress, completeness, segments and statistics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scan import CHUNK_ROWS, HotKeys, Running, hot_keys, join_by_key, running
from tracelake.functions.staging import staged

# A flow expects at least 3 blocks, and its highest block number plus 2.
LEAST_EXPECTED = 3
EXPECTED_MARGIN = 2

_FLOW = ["scope", "flow"]
_MESSAGE = [*_FLOW, "phase", "pos"]


def flow_progress(events: DataFrame, hot: HotKeys) -> DataFrame:
    """W-1, W-5: one row per applied message with the flow's running values after it.

    ``n`` messages, ``sent_so_far`` blocks with retransmissions, ``acked_so_far`` first acks (an ack is
    a first ack if a transmission of its number comes right before it), ``expected`` blocks, and
    ``latest_ms``, the running maximum of the data-side times.
    """
    ordered = running(
        events,
        [*_FLOW, "seq"],
        ["phase", "pos", "item"],
        ["phase", "chunk"],
        [Running("before", F.col("what"), "last", "before")],
        hot,
    )
    first_ack = (F.col("what") == "ack") & F.coalesce(F.col("before") == "tx", F.lit(False))
    on_data = F.col("side") == "data"
    messages = ordered.groupBy(*_MESSAGE, "chunk").agg(
        F.count_if(F.col("what") == "tx").alias("sent"),
        F.count_if(first_ack).alias("acked"),
        F.max(F.when(F.col("what") == "tx", F.col("seq").cast("bigint") + EXPECTED_MARGIN)).alias("needs"),
        F.max("payload_bytes").alias("payload_bytes"),
        F.min(F.when(on_data, F.col("first_ms"))).alias("first_ms"),
        F.max(F.when(on_data, F.col("last_ms"))).alias("last_ms"),
    )
    progress = running(
        hot.once(messages, "messages"),
        _FLOW,
        ["phase", "pos"],
        ["phase", "chunk"],
        [
            Running("n", F.lit(1).cast("bigint"), "sum"),
            Running("sent_so_far", F.col("sent"), "sum"),
            Running("acked_so_far", F.col("acked"), "sum"),
            Running("expected", F.col("needs"), "max"),
            Running("latest_ms", F.col("last_ms"), "max"),
        ],
        hot,
    )
    return progress.withColumn("expected", F.greatest(F.lit(LEAST_EXPECTED), "expected"))


def completion(progress: DataFrame) -> DataFrame:
    """W-5: per flow, the message after which data and acks were complete, and both (``closed_at``)."""
    points = progress.groupBy(*_FLOW).agg(
        F.min(F.when(F.col("sent_so_far") >= F.col("expected"), F.col("n"))).alias("data_at"),
        F.min(F.when(F.col("acked_so_far") >= F.col("expected"), F.col("n"))).alias("ack_at"),
    )
    both = F.col("data_at").isNotNull() & F.col("ack_at").isNotNull()
    return points.select(
        *_FLOW,
        F.col("data_at").isNotNull().alias("data_complete"),
        F.col("ack_at").isNotNull().alias("ack_complete"),
        F.when(both, F.greatest("data_at", "ack_at")).alias("closed_at"),
    )


def close_early(
    events: DataFrame, early_close: str = "toggle", chunk_rows: int = CHUNK_ROWS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """W-6: drop what a completed flow ignores; returns ``(events, progress, completion)``.

    After its completing message a flow ignores every other message. Only flows that do ignore
    something are measured again. ``early_close="off"`` applies everything. ``events`` should be a
    staged table: it is read several times.
    """
    if early_close not in ("toggle", "off"):
        raise ValueError(f"early_close must be 'toggle' or 'off', not {early_close!r}")
    hot = hot_keys(events, _FLOW, chunk_rows)
    progress = staged(flow_progress(events, hot), "progress")
    points = completion(progress)
    if early_close == "off":
        return events, progress, points
    points = staged(points, "completion")
    closed = points.where("closed_at is not null").select(*_FLOW, "closed_at")
    ignored = join_by_key(progress, closed, _FLOW, hot).where("n > closed_at and (n - closed_at) % 2 = 1")
    ignored = staged(ignored.select(*_MESSAGE), "ignored")
    if ignored.isEmpty():
        return events, progress, points
    applied = events.join(ignored, _MESSAGE, "left_anti")
    shortened = staged(ignored.select(*_FLOW).distinct(), "shortened")
    # Staged so that the next windows do not inherit the join's partitioning by flow.
    again = join_by_key(events, shortened, _FLOW, hot, "left_semi")
    again = staged(again.join(ignored, _MESSAGE, "left_anti"), "again")
    unchanged = join_by_key(progress, shortened, _FLOW, hot, "left_anti")
    progress = unchanged.unionByName(flow_progress(again, hot))
    return applied, staged(progress, "progress"), points


def segments(events: DataFrame, progress: DataFrame) -> DataFrame:
    """W-1, W-3, W-4, JN-5: one row per flow and block number.

    ``sent_ms`` is the flow's running maximum time at the latest transmission, ``ack_ms`` the last ack
    after it, or null.
    """
    place = F.struct("phase", "pos", "item")
    tx, ack = F.col("what") == "tx", F.col("what") == "ack"
    latest = (
        events.where("what <> 'none'")
        .groupBy(*_FLOW, "seq")
        .agg(
            F.max(F.when(tx, place)).alias("tx_place"),
            F.max(F.when(ack, place)).alias("ack_place"),
            F.max_by(F.when(ack, F.col("last_ms")), F.when(ack, place)).alias("ack_ms"),
        )
        .where("tx_place is not null")
    )
    latest = latest.select(
        *_FLOW,
        "seq",
        F.col("tx_place.phase").alias("phase"),
        F.col("tx_place.pos").alias("pos"),
        F.when(F.col("ack_place") > F.col("tx_place"), F.col("ack_ms")).alias("ack_ms"),
    )
    sent = progress.select(*_MESSAGE, F.col("latest_ms").alias("sent_ms"))
    return latest.join(sent, _MESSAGE).select(*_FLOW, "seq", "sent_ms", "ack_ms")


def flow_stats(flows: DataFrame, progress: DataFrame, points: DataFrame) -> DataFrame:
    """A-14, A-15, A-16, F-15: one row per flow."""
    totals = progress.groupBy(*_FLOW).agg(
        F.sum("sent").alias("blocks"),
        F.sum("acked").alias("acks"),
        F.greatest(F.lit(LEAST_EXPECTED), F.max("needs")).alias("expected"),
        F.min("first_ms").alias("start_ms"),
        F.max("last_ms").alias("end_ms"),
        F.sum("payload_bytes").alias("payload_bytes"),
    )
    opened = flows.select("scope", "flow", "ack_pipe", "req_ms", "rem_ms")
    span = F.col("end_ms") - F.col("start_ms")
    return (
        opened.join(totals, _FLOW)
        .join(points.select(*_FLOW, "data_complete", "ack_complete"), _FLOW)
        .withColumn("transfer_ms", span)
        .withColumn("bytes_per_ms", F.when(span != 0, F.col("payload_bytes") / span))
    )


def flow_health(stats: DataFrame, segs: DataFrame, keys: list[str] = _FLOW) -> DataFrame:
    """A-11, A-12: uncompleted flows, and the acks that these still expect.

    A flow needs as many blocks, and as many first acks, as its highest number plus two, so one that
    sends each number once never completes, however clean. That is the rule, not a fault.
    """
    open_flows = stats.where("not (data_complete and ack_complete)").select(*keys)
    missing = segs.where("ack_ms is null").groupBy(*keys).agg(F.count("*").alias("missing"))
    return (
        open_flows.join(missing, keys, "left")
        .agg(
            F.count("*").alias("uncompleted_flows"),
            F.coalesce(F.sum("missing"), F.lit(0)).alias("acks_expected"),
        )
    )


def status_text(blocks, acks, expected, data_complete, ack_complete):
    """F-15: a flow's progress as text."""
    return F.format_string(
        "Data: %s:%d\nAck: %s:%d\nExpectedNumber: %d",
        data_complete.cast("string"), blocks, ack_complete.cast("string"), acks, expected,
    )
