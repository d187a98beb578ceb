"""Which flow each message belongs to."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scan import CHUNK_ROWS, Running, hot_keys, join_by_key, running

_MESSAGE = ["kind", "first_ms", "last_ms", "payload_bytes", "seqs", "acks"]


def assign_messages(messages: DataFrame, handshakes: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """JN-2, JN-3, JN-4: route every data, ack and close message as of its position.

    Data goes to the latest handshake before it whose data pipe it names, acks to the latest whose ack
    pipe they name, closes to the data pipe's if there is one and else to the ack pipe's. What finds no
    handshake waits (``side`` null). One row per message:

    - ``side``, ``flow``, ``flow_rem``: where it was routed, and the response that opened that flow;
    - ``kept``: that flow is the last one on its data pipe;
    - ``replay``: data pipe of the kept flow that a waiting message is replayed into on the data side.

    Waiting acks are replayed on the ack side of every later flow of their pipe. That set is not
    spelled out here: ``flow_events`` needs only its last ack per number.
    """
    kept = handshakes.groupBy("scope", "data_pipe").agg(F.max("rem_pos").alias("rem_pos"))
    opened = handshakes.join(
        kept.withColumn("kept", F.lit(True)), ["scope", "data_pipe", "rem_pos"], "left"
    ).select(
        "scope",
        "ack_pipe",
        F.col("rem_pos").alias("pos"),
        F.col("rem_chunk").alias("chunk"),
        F.struct(
            F.col("data_pipe").alias("pipe"), F.col("rem_pos").alias("rem"), F.col("kept").isNotNull().alias("kept")
        ).alias("flow"),
    )
    none = F.when(F.lit(False), F.col("flow"))
    on_data = F.struct(F.col("flow.pipe").alias("pipe"), F.col("flow").alias("data_mark"), none.alias("ack_mark"))
    on_ack = F.struct(F.col("ack_pipe").alias("pipe"), none.alias("data_mark"), F.col("flow").alias("ack_mark"))
    marks = opened.select("scope", "pos", "chunk", F.inline(F.array(on_data, on_ack)))
    moved = messages.where("kind in ('data', 'ack', 'close') and pipe_id is not null").select(
        "scope", F.col("pipe_id").alias("pipe"), "pos", "chunk", *_MESSAGE
    )
    line = moved.unionByName(marks, True)
    hot = hot_keys(line, ["scope", "pipe"], chunk_rows)
    seen = running(
        hot.once(line, "line"),
        ["scope", "pipe"],
        ["pos"],
        ["chunk"],
        [
            Running("on_data", F.col("data_mark"), "last", "before"),
            Running("on_ack", F.col("ack_mark"), "last", "before"),
            Running("final", F.col("data_mark"), "last", "whole"),
        ],
        hot,
    ).where("kind is not null")

    has_data, has_ack = F.col("on_data").isNotNull(), F.col("on_ack").isNotNull()
    to_data = F.col("kind").isin("data", "close") & has_data
    to_ack = (F.col("kind") == "ack") & has_ack | (F.col("kind") == "close") & ~has_data & has_ack
    seen = seen.withColumn("side", F.when(to_data, "data").when(to_ack, "ack"))
    target = F.when(F.col("side") == "data", F.col("on_data")).when(F.col("side") == "ack", F.col("on_ack"))
    waits = F.col("side").isNull()
    return seen.select(
        "scope",
        "pipe",
        "pos",
        "chunk",
        "side",
        target["pipe"].alias("flow"),
        target["rem"].alias("flow_rem"),
        F.coalesce(target["kept"], F.lit(False)).alias("kept"),
        F.when(waits & (F.col("pos") < F.col("final.rem")), F.col("final.pipe")).alias("replay"),
        *_MESSAGE,
    )


def flow_events(
    assigned: DataFrame, flows: DataFrame, keep: str = "last", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """W-7: what each flow of ``flow_table`` applies, one row per message and listed number.

    Order is (``phase``, ``pos``, ``item``): phase 0 the request; 2 messages that waited on the data
    pipe; 3 acks that waited on the ack pipe; 4 routed messages. ``what`` is ``tx``, ``ack`` or
    ``none``; ``seq`` is -1 without a number (numbers are 0 or more).

    Phase 3 holds, per number sent in phase 2, only the last waiting ack. All such acks came before
    the first handshake on the pipe, so they are the same for every flow that shares it, and a flow
    cannot complete before phase 4: completing takes as many first acks as the highest number plus
    two, and without a retransmission there is at most one per number. Earlier acks of a number are
    overwritten, so they change nothing. ``assigned`` should be a staged table: it is read several times.

    With ``keep="all"``, of which flow a message is says the interval it lies in: from the response that opened the flow to
    the next one on its pipe. What waited on a data pipe is applied by every flow that the pipe opens later; that is the
    rule, and the only step whose result is larger than its input.
    """
    request = flows.select(
        "scope",
        "flow",
        F.lit(0).alias("phase"),
        F.col("req_pos").alias("pos"),
        F.col("req_chunk").alias("chunk"),
        F.lit("data").alias("side"),
        F.lit("none").alias("what"),
        F.lit(0).alias("item"),
        F.lit(-1).alias("seq"),
        F.col("req_ms").alias("first_ms"),
        F.col("req_last_ms").alias("last_ms"),
        F.lit(0).cast("bigint").alias("payload_bytes"),
    )
    if keep == "last":
        routed, waited = assigned.where("kept"), assigned.where("replay is not null").withColumn("flow", F.col("replay"))
    else:
        interval = F.struct(F.col("flow").alias("pipe"), F.col("flow_rem").alias("rem"))
        routed = assigned.where("side is not null").withColumn("flow", interval)
        later = flows.select("scope", F.col("data_pipe").alias("pipe"), "rem_pos", F.col("flow").alias("opened"))
        waited = assigned.where("side is null").join(later, ["scope", "pipe"]).where("pos < rem_pos")
        waited = waited.withColumn("flow", F.col("opened")).drop("opened", "rem_pos")
    routed = routed.withColumn("phase", F.lit(4))
    replayed = waited.withColumns({"phase": F.lit(2), "side": F.lit("data")})
    messages = message_events(routed.unionByName(replayed))

    waiting = (
        assigned.where("kind = 'ack' and side is null")
        .select("scope", F.col("pipe").alias("ack_pipe"), "pos", "last_ms", F.explode("acks").alias("seq"))
        .groupBy("scope", "ack_pipe", "seq")
        .agg(F.max_by("last_ms", "pos").alias("last_ms"))
    )
    sent = replayed.where("kind = 'data'").select("scope", "flow", F.explode("seqs").alias("seq")).distinct()
    opened = flows.select("scope", "flow", "ack_pipe", "rem_pos", "rem_chunk")
    acked_late = (
        join_by_key(sent, opened, ["scope", "flow"], hot_keys(sent, ["scope", "flow"], chunk_rows))
        .join(waiting, ["scope", "ack_pipe", "seq"])
        .select(
            "scope",
            "flow",
            F.lit(3).alias("phase"),
            F.col("rem_pos").alias("pos"),
            F.col("rem_chunk").alias("chunk"),
            F.lit("ack").alias("side"),
            F.lit("ack").alias("what"),
            F.lit(0).alias("item"),
            "seq",
            F.col("last_ms").alias("first_ms"),
            "last_ms",
            F.lit(0).cast("bigint").alias("payload_bytes"),
        )
    )
    return request.unionByName(messages).unionByName(acked_late)


def message_events(applied: DataFrame) -> DataFrame:
    """One row per number listed in a message that matters on its side, or one ``none`` row.

    ``applied`` has ``scope``, ``flow``, ``phase``, ``pos``, ``chunk``, ``side`` and the message columns.
    """
    sends = (F.col("side") == "data") & (F.col("kind") == "data")
    acks = (F.col("side") == "ack") & (F.col("kind") == "ack")
    numbers = F.when(sends, F.col("seqs")).when(acks, F.col("acks"))
    listed = applied.select(
        "scope",
        "flow",
        "phase",
        "pos",
        "chunk",
        "side",
        "first_ms",
        "last_ms",
        F.when(sends, F.col("payload_bytes")).otherwise(F.lit(0)).cast("bigint").alias("payload_bytes"),
        F.posexplode_outer(numbers).alias("item", "seq"),
    )
    what = F.when(F.col("seq").isNull(), "none").when(F.col("side") == "data", "tx").otherwise("ack")
    below = (F.col("side") == "data") & (F.col("seq") < 0)
    number = F.when(below, F.raise_error("block numbers are 0 or more").cast("int")).otherwise(F.col("seq"))
    return listed.withColumn("what", what).withColumns(
        {"item": F.coalesce("item", F.lit(0)), "seq": F.coalesce(number, F.lit(-1))}
    )
