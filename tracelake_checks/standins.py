"""The given tables in the shape of packets and messages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.columns import epoch_ms


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lineitem_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as packets: return flag A is TCP, N is UDP, R neither; line status F is IPv6."""
    flag = F.col("l_returnflag")
    l4 = F.when(flag == "A", "tcp").when(flag == "N", "udp")
    payload = F.col("l_quantity").cast("bigint")
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("trace-"), flag).alias("trace_file"),
        F.when(F.col("l_linestatus") == "F", 6).otherwise(4).alias("ip_version"),
        F.col("l_orderkey").cast("string").alias("ip_src"),
        F.col("l_suppkey").cast("string").alias("ip_dst"),
        F.col("l_linenumber").alias("ip_header_len"),
        payload.alias("ip_payload_len"),
        (F.col("l_linenumber") + payload).alias("ip_total_len"),
        l4.alias("l4"),
        F.when(l4.isNotNull(), F.col("l_linenumber")).alias("src_port"),
        F.when(flag == "A", F.col("l_suppkey")).when(flag == "N", F.col("l_partkey")).alias("dst_port"),
        (F.col("l_linenumber") + payload).alias("wire_len"),
        F.when(flag == "A", payload).alias("tcp_payload_len"),
    )


def event_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Events as IPv4 packets: one trace per event type, the number in ``props`` as length."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("trace_file"),
        (F.col("event_id") + 1).alias("frame_no"),
        F.lit(4).alias("ip_version"),
        F.get_json_object("props", "$.k").cast("bigint").alias("ip_total_len"),
    )


def _event_number():
    return F.get_json_object("props", "$.k").cast("int")


def event_messages(spark: SparkSession, folder: str, busy: bool = False) -> DataFrame:
    """Events as socket messages: each user has a data pipe and an ack pipe, in one of four traces.

    ``busy``: only one in ten sign-ups and purchases opens a flow, the others are data and acks, and blocks are numbered
    0 to 2, so that most flows complete and then ignore messages.
    """
    kinds = {"signup": "req", "purchase": "rem", "view": "data", "click": "ack", "error": "close"}
    event = F.col("event_type")
    if busy:
        opens = _event_number() < 10
        event = F.when((event == "signup") & ~opens, "view").when((event == "purchase") & ~opens, "click").otherwise(event)
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[event]
    user = F.col("user_id").cast("string")
    data_pipe, ack_pipe = F.concat(F.lit("d"), user), F.concat(F.lit("a"), user)
    ms = epoch_ms(F.col("ts"))
    number = F.array((_event_number() % 3).cast("int") if busy else _event_number())
    nothing = F.array().cast("array<int>")
    return table(spark, folder, "events").select(
        F.concat(F.lit("t"), F.pmod("user_id", F.lit(4)).cast("string")).alias("trace_file"),
        F.col("event_id").alias("msg_no"),
        kind.alias("kind"),
        F.when(event.isin("view", "error"), data_pipe).when(event.isin("click", "purchase"), ack_pipe).alias("pipe_id"),
        F.when(event == "signup", ack_pipe).when(event == "purchase", data_pipe).alias("adv_pipe_id"),
        ms.alias("first_ms"),
        ms.alias("last_ms"),
        F.when(event == "view", F.length("props")).otherwise(0).cast("bigint").alias("payload_bytes"),
        F.when(event == "view", number).otherwise(nothing).alias("seqs"),
        F.when(event == "click", number).otherwise(nothing).alias("acks"),
    )


def user_flow_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Views and clicks as the data and acks of one flow per user, without handshakes."""
    from tracelake.functions.scan import chunk_of

    messages = event_messages(spark, folder).where("kind in ('data', 'ack')")
    return messages.select(
        F.lit("").alias("scope"),
        F.expr("substr(pipe_id, 2)").alias("flow"),
        F.lit(4).alias("phase"),
        F.col("msg_no").alias("pos"),
        chunk_of("msg_no").alias("chunk"),
        F.when(F.col("kind") == "data", "data").otherwise("ack").alias("side"),
        "kind",
        "first_ms",
        "last_ms",
        "payload_bytes",
        "seqs",
        "acks",
    )
