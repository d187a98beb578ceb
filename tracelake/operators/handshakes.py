"""Socket handshakes: a connect request and the response that takes it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scan import CHUNK_ROWS, Running, hot_keys, running


def match_handshakes(messages: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """JN-1, W-8: one row per ``rem`` whose predecessor on its ack pipe is a ``req``.

    A later ``req`` replaces a waiting one, a ``rem`` uses the waiting one up, and a ``rem`` that finds
    none opens no flow; so the row before decides. A ``rem`` that advertises no pipe counts for nothing and leaves the
    waiting ``req`` as it is. ``messages`` come from ``in_scope``.
    """
    is_req = F.col("kind") == "req"
    calls = messages.where("kind in ('req', 'rem')").select(
        "scope",
        "pos",
        "chunk",
        "kind",
        "first_ms",
        "last_ms",
        F.when(is_req, F.col("adv_pipe_id")).otherwise(F.col("pipe_id")).alias("ack_pipe"),
        F.when(~is_req, F.col("adv_pipe_id")).alias("data_pipe"),
    )
    calls = calls.where("ack_pipe is not null and (kind = 'req' or data_pipe is not null)")
    before = F.struct("kind", "pos", "chunk", "first_ms", "last_ms")
    keys = ["scope", "ack_pipe"]
    hot = hot_keys(calls, keys, chunk_rows)
    paired = running(hot.once(calls, "calls"), keys, ["pos"], ["chunk"], [Running("req", before, "last", "before")], hot)
    return paired.where("kind = 'rem' and req.kind = 'req'").select(
        "scope",
        "data_pipe",
        "ack_pipe",
        F.col("req.pos").alias("req_pos"),
        F.col("req.chunk").alias("req_chunk"),
        F.col("pos").alias("rem_pos"),
        F.col("chunk").alias("rem_chunk"),
        F.col("req.first_ms").alias("req_ms"),
        F.col("req.last_ms").alias("req_last_ms"),
        F.col("first_ms").alias("rem_ms"),
    )


def last_handshakes(handshakes: DataFrame) -> DataFrame:
    """The flows that count: the last handshake of each data pipe replaces the earlier ones."""
    keys = ["scope", "data_pipe"]
    rest = [c for c in handshakes.columns if c not in keys]
    last = handshakes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "rem_pos").alias("last"))
    return last.select(*keys, "last.*")


def flow_table(handshakes: DataFrame, keep: str = "last") -> DataFrame:
    """The flows with their names in ``flow``: the last handshake of each data pipe, named by the pipe, or with
    ``keep="all"`` every handshake, named by pipe and response (``pipe``, ``rem``)."""
    if keep == "last":
        return last_handshakes(handshakes).withColumn("flow", F.col("data_pipe"))
    if keep != "all":
        raise ValueError(f"keep must be 'last' or 'all', not {keep!r}")
    return handshakes.withColumn("flow", F.struct(F.col("data_pipe").alias("pipe"), F.col("rem_pos").alias("rem")))


def orphan_requests(messages: DataFrame, handshakes: DataFrame) -> DataFrame:
    """JN-6: requests that no response took."""
    requests = messages.where("kind = 'req'").select(
        "scope", F.col("adv_pipe_id").alias("ack_pipe"), F.col("pos").alias("req_pos"), F.col("first_ms").alias("req_ms")
    )
    return requests.join(handshakes, ["scope", "ack_pipe", "req_pos"], "left_anti")


def orphan_counts(messages: DataFrame, handshakes: DataFrame) -> DataFrame:
    """JN-6: unanswered requests, and the messages and pipes that never got a flow."""
    requests = orphan_requests(messages, handshakes).agg(F.count("*").alias("n"))
    per_pipe = messages.where("kind in ('data', 'ack', 'close')").groupBy("scope", F.col("pipe_id").alias("pipe"))
    known = handshakes.select("scope", F.col("data_pipe").alias("pipe")).unionAll(
        handshakes.select("scope", F.col("ack_pipe").alias("pipe"))
    )
    lost = per_pipe.agg(F.count("*").alias("n")).join(known.distinct(), ["scope", "pipe"], "left_anti")
    totals = lost.agg(F.count("*").alias("pipes"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))
    return requests.select(F.lit("requests").alias("what"), "n").unionAll(
        totals.unpivot([], ["messages", "pipes"], "what", "n")
    )
