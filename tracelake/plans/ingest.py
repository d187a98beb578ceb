"""Captures to tables, each decoded once: later jobs read the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.scan import CHUNK_ROWS
from tracelake.sources.captures import SPLIT_BYTES, read_pcap
from tracelake.functions.staging import staged
from tracelake.sources.reassembly import LARGEST_MESSAGE, Measure, reassemble
from tracelake.sources.wire import ElementNames, classify_messages, message_losses, package_length, parse_messages


def ingest_packets(
    spark: SparkSession,
    source: str,
    target: str,
    mode: str = "FAILFAST",
    payload: bool = False,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """SRC-2: decode the captures at ``source`` into a Parquet table at ``target`` and read that."""
    packets = read_pcap(spark, source, mode, payload, split_bytes)
    packets.write.mode("errorifexists").parquet(target)
    return spark.read.schema(packets.schema).parquet(target)


def ingest_messages(
    packets: DataFrame,
    target: str,
    measure: Measure = package_length,
    names: ElementNames = ElementNames(),
    max_messages_per_packet: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
    losses: str | None = None,
    largest: int = LARGEST_MESSAGE,
) -> DataFrame:
    """SRC-6, SRC-7: write the socket messages of a ``packets`` table with payload, and read them.

    With ``losses``, what is in no message is written there: trace_file, frame_no or msg_no, why and bytes. Reasons are
    those of ``reassemble`` and ``message_losses``, and "unfinished" for a message that its flow does not end. The bytes of
    parsed messages and of all losses, but for blocks without number inside a message, are all bytes of TCP payload.
    """
    whole = reassemble(packets, measure, max_messages_per_packet, chunk_rows, largest)
    parsed = parse_messages(whole.messages)
    if losses is not None:
        parsed = staged(parsed, "parsed")
        none = F.lit(None).cast("bigint")
        unread = whole.losses.select("trace_file", "frame_no", none.alias("msg_no"), "why", "bytes")
        left = whole.unfinished.select(
            "trace_file", none.alias("frame_no"), none.alias("msg_no"), F.lit("unfinished").alias("why"), "bytes"
        )
        unparsed = message_losses(parsed, names).withColumn("frame_no", none)
        unread.unionByName(left).unionByName(unparsed).write.mode("errorifexists").parquet(losses)
    messages = classify_messages(parsed, names)
    messages.write.mode("errorifexists").parquet(target)
    return packets.sparkSession.read.schema(messages.schema).parquet(target)
