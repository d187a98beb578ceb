"""The given tables as capture files and TCP segments, so that ingest and reassembly run on whole tables.

The bytes are put together by column expressions; each task writes the packets of its partition as one
capture file into the shared folder.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake_checks.standins import table
from tracelake.functions.staging import new_path
from tracelake.operators.traffic import frame_count, ipv4_totals, payload_totals, port_traffic
from tracelake.plans.socket_performance import socket_performance
from tracelake.plans.ingest import ingest_messages, ingest_packets
from tracelake.sources.captures import read_pcap, read_pcap_and_losses
from tracelake.sources.frames import RECORD_HEADER
from tracelake.sources.reassembly import MESSAGE_STEP, Reassembled, length_prefixed, reassemble, reassemble_messages
from tracelake.sources.wire import ElementNames

SEGMENT = 100


def number(value, size: int) -> Column:
    """Big-endian bytes of a number that is 0 or more."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def raw(text: str) -> Column:
    return F.unhex(F.lit(text))


def utf8(text) -> Column:
    return F.encode(text if isinstance(text, Column) else F.lit(text), "UTF-8")


def sized(body: Column, size: int) -> Column:
    return F.concat(number(F.length(body), size), body)


def ethernet(ip_version: Column, proto: Column, src: Column, dst: Column, inner: Column) -> Column:
    v4 = F.concat(
        raw("0800" "4500"), number(F.length(inner) + 20, 2), raw("0001" "0000" "40"), number(proto, 1), raw("0000"),
        number(src, 4), number(dst, 4), inner,
    )
    v6 = F.concat(
        raw("86dd" "60000000"), number(F.length(inner), 2), number(proto, 1), raw("40"),
        number(src, 16), number(dst, 16), inner,
    )
    return F.concat(raw("02" * 12), F.when(ip_version == 6, v6).otherwise(v4))


def tcp(src: Column, dst: Column, seq: Column, payload: Column) -> Column:
    return F.concat(number(src, 2), number(dst, 2), number(seq, 4), raw("00000000" "5010" "0000" "0000" "0000"), payload)


def udp(src: Column, dst: Column, payload: Column) -> Column:
    return F.concat(number(src, 2), number(dst, 2), number(F.length(payload) + 8, 2), raw("0000"), payload)


def _writer(folder: str):
    local = folder if folder.startswith("/") else folder.removeprefix("file:")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if local.startswith("/"):
            system, base = fs.LocalFileSystem(), local
        else:
            system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}.pcap"
        packets = 0
        with system.open_output_stream(name) as out:
            out.write(bytes.fromhex("a1b2c3d4 0002 0004 00000000 00000000 0000ffff 00000001"))
            for batch in batches:
                packets += batch.num_rows
                out.write(b"".join(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_pydict({"packets": [packets]}, pa.schema([("packets", pa.int64())]))

    return write


def write_captures(packets: DataFrame, key: str, order: list[str], damaged: Column | None = None) -> str:
    """Write ``(us, frame)`` rows as capture files, one per partition of ``key``; returns the folder.

    The headers of ``damaged`` rows name a size that no record has.
    """
    folder = new_path(packets.sparkSession, "captures")
    million = F.lit(1_000_000).cast("bigint")
    record = F.concat(
        number(F.call_function("div", F.col("us"), million), 4),
        number(F.col("us") % million, 4),
        F.when(F.lit(False) if damaged is None else damaged, raw("7fffffff")).otherwise(number(F.length("frame"), 4)),
        sized(F.col("frame"), 4),
    )
    lines = packets.repartition(key).sortWithinPartitions(*order).select(record.alias("record"))
    lines.mapInArrow(_writer(folder), "packets bigint").agg(F.sum("packets")).collect()
    return folder


def lineitem_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as ``(us, frame)`` rows; ports are 16 bits wide."""
    items = table(spark, folder, "lineitem")
    flag, src = F.col("l_returnflag"), F.col("l_linenumber")
    payload = utf8(F.repeat(F.lit("x"), F.col("l_quantity").cast("int")))
    inner = (
        F.when(flag == "A", tcp(src, F.col("l_suppkey") % 65536, F.col("l_orderkey") % 65536, payload))
        .when(flag == "N", udp(src, F.col("l_partkey") % 65536, payload))
        .otherwise(F.concat(raw("0800000000000000"), payload))
    )
    proto = F.when(flag == "A", 6).when(flag == "N", 17).otherwise(1)
    version = F.when(F.col("l_linestatus") == "F", 6).otherwise(4)
    frame = ethernet(version, proto, F.col("l_orderkey") % (1 << 31), F.col("l_suppkey") % (1 << 31), F.col("inner"))
    items = items.withColumn("inner", inner)  # a column of its own is put together once
    return items.select(*ITEM, F.lit(1_000_000).cast("bigint").alias("us"), frame.alias("frame"))


ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: Bytes in a range for the queries that cut capture files into many ranges.
SMALL_SPLIT = 1 << 17
#: One in so many records of a thousand neighbouring orders is damaged.
DAMAGED_EACH = 64


def write_lineitem_captures(spark: SparkSession, folder: str) -> str:
    return write_captures(lineitem_frames(spark, folder), "l_orderkey", ITEM)


def write_damaged_captures(spark: SparkSession, folder: str) -> str:
    """Line items as captures in which every ``DAMAGED_EACH``-th record of a thousand neighbouring orders is damaged."""
    block = F.call_function("div", F.col("l_orderkey"), F.lit(1000).cast("bigint"))
    place = F.row_number().over(Window.partitionBy("block").orderBy(*ITEM))
    frames = lineitem_frames(spark, folder).withColumn("block", block).withColumn("place", place)
    frames = frames.withColumn("us", F.lit(1_700_000_000_000_000) + F.col("place"))  # times of day, as captures have them
    return write_captures(frames, "block", ["block", *ITEM], F.col("place") % DAMAGED_EACH == 0)


def lineitem_captures(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    return read_pcap(spark, write_lineitem_captures(spark, folder), columns=columns)


def pcap_ingest(spark, folder):
    """Captures decoded once into a table; the columns that do not depend on the partitions."""
    packets = ingest_packets(spark, write_lineitem_captures(spark, folder), new_path(spark, "packets"))
    return packets.select(
        "ip_version", F.when(F.col("ip_version") == 4, F.col("ip_src")).alias("ip_src"), "ip_header_len",
        "ip_payload_len", "ip_total_len", "wire_len", "l4", "src_port", "dst_port", "tcp_seq", "tcp_payload_len", "ts_ms",
    )


def pcap_ingest_split(spark, folder):
    """The same from many byte ranges of each capture."""
    packets = read_pcap(spark, write_lineitem_captures(spark, folder), split_bytes=SMALL_SPLIT)
    return packets.select(
        "ip_version", F.when(F.col("ip_version") == 4, F.col("ip_src")).alias("ip_src"), "ip_header_len",
        "ip_payload_len", "ip_total_len", "wire_len", "l4", "src_port", "dst_port", "tcp_seq", "tcp_payload_len", "ts_ms",
    )


def _found_and_lost(spark, folder, **options):
    captures = write_damaged_captures(spark, folder)
    packets, losses = read_pcap_and_losses(spark, captures, columns=["cap_len"], **options)
    size = F.col("cap_len").cast("bigint") + RECORD_HEADER
    found = packets.agg(F.lit("found").alias("what"), F.count("*").alias("records"), F.sum(size).alias("bytes"))
    lost = losses.groupBy(F.col("why").alias("what"))
    return found.unionByName(lost.agg(F.lit(None).cast("bigint").alias("records"), F.sum("bytes").alias("bytes")))


def pcap_losses(spark, folder):
    """What is read of damaged captures, and what is lost: together all their bytes."""
    return _found_and_lost(spark, folder)


def pcap_losses_split(spark, folder):
    """The same from many byte ranges of each capture."""
    return _found_and_lost(spark, folder, split_bytes=SMALL_SPLIT)


def capture_frame_count(spark, folder):
    return frame_count(lineitem_captures(spark, folder, ["frame_no"]))


def capture_payload_totals(spark, folder):
    return payload_totals(lineitem_captures(spark, folder, ["l4", "wire_len", "tcp_payload_len"]))


def capture_port_traffic(spark, folder):
    return port_traffic(lineitem_captures(spark, folder, ["l4", "dst_port", "ip_version", "ip_header_len", "ip_payload_len"]))


def capture_ipv4_totals(spark, folder):
    """Totals of the traces put together; how rows fall into traces depends on the partitions."""
    traces = ipv4_totals(lineitem_captures(spark, folder))
    return traces.agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))


def segments_of(messages: DataFrame, keep: list[str]) -> DataFrame:
    """Cut each ``stream`` into TCP segments of up to ``SEGMENT`` bytes."""
    last = F.call_function("div", F.length("stream") - 1, F.lit(SEGMENT)).cast("int")
    cut = messages.select(*keep, "stream", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    body = F.substring(F.col("stream"), F.col("piece") * SEGMENT + 1, F.lit(SEGMENT))
    return cut.select(*keep, "piece", body.alias("payload"))


def conversation_packets(spark, folder, damaged: Column | None = None) -> DataFrame:
    """Conversation turns sent as length-prefixed messages, two turns to a stream, a conversation to a flow.

    The headers of ``damaged`` turns name a length that no message has.
    """
    turns = table(spark, folder, "conversations")
    body = utf8(F.concat_ws("\t", F.col("turn").cast("string"), "role", "text"))
    pair = F.call_function("div", F.col("turn"), F.lit(2).cast("bigint")).alias("pair")
    bad = F.lit(False) if damaged is None else damaged
    frame = F.when(bad, F.concat(raw("7fffffff"), body)).otherwise(sized(body, 4))
    framed = turns.select("conv_id", pair, F.struct("turn", frame.alias("frame")).alias("message"))
    # Two turns at most to a group.
    pairs = framed.groupBy("conv_id", "pair").agg(F.array_sort(F.collect_list("message")).alias("both"))
    stream = F.aggregate("both", raw(""), lambda done, m: F.concat(done, m["frame"]))
    cut = segments_of(pairs.select("conv_id", "pair", stream.alias("stream")), ["conv_id", "pair"])
    place = (F.col("conv_id") * 4096 + F.col("pair")) * (1 << 20) + F.col("piece") + 1
    return cut.select(
        F.lit("conversations").alias("trace_file"),
        place.alias("frame_no"),
        place.alias("ts_ms"),
        F.col("conv_id").cast("string").alias("ip_src"),
        F.lit("server").alias("ip_dst"),
        F.lit(1000).alias("src_port"),
        F.lit(9701).alias("dst_port"),
        F.lit("tcp").alias("l4"),
        place.alias("tcp_seq"),
        F.length("payload").alias("tcp_payload_len"),
        "payload",
    )


def _turns(whole: DataFrame) -> DataFrame:
    parts = F.split(F.decode(F.expr("substring(message, 5)"), "UTF-8"), "\t", 3)
    return whole.select(
        F.col("ip_src").cast("bigint").alias("conv_id"),
        parts[0].cast("bigint").alias("turn"),
        parts[1].alias("role"),
        parts[2].alias("text"),
    )


def reassembled_messages(spark, folder):
    """Conversation turns, sent and put together again."""
    return _turns(reassemble_messages(conversation_packets(spark, folder), length_prefixed))


#: Packets in a chunk for the queries that run the plan for large flows.
FEW_PACKETS = 4


def reassembled_messages_chunked(spark, folder):
    return _turns(reassemble_messages(conversation_packets(spark, folder), length_prefixed, chunk_rows=FEW_PACKETS))


def _damaged_conversations(spark, folder, **options) -> Reassembled:
    packets = conversation_packets(spark, folder, F.col("turn") % 5 == 3)
    return reassemble(packets, length_prefixed, **options)


def resumed_messages(spark, folder):
    """One turn in five has a damaged header; all others are found."""
    return _turns(_damaged_conversations(spark, folder).messages)


def _accounted(whole: Reassembled) -> DataFrame:
    size = F.length("message").cast("bigint")
    found = whole.messages.select(F.lit("found").alias("what"), size.alias("bytes"))
    lost = whole.losses.select(F.lit("lost").alias("what"), "bytes")
    left = whole.unfinished.select(F.lit("unfinished").alias("what"), "bytes")
    return found.unionByName(lost).unionByName(left).groupBy("what").agg(F.sum("bytes").alias("bytes"))


def message_losses(spark, folder):
    """Bytes of payload in messages and in losses: together all that was sent."""
    return _accounted(_damaged_conversations(spark, folder))


def message_losses_chunked(spark, folder):
    return _accounted(_damaged_conversations(spark, folder, chunk_rows=FEW_PACKETS))


NAMES = ElementNames()


def _element(namespace: int, name: Column, content: Column, kind: str | None = None) -> Column:
    flags = raw(f"{namespace:02x}{'01' if kind else '00'}")
    typed = sized(utf8(kind), 2) if kind else raw("")
    return F.concat(utf8("jxel"), flags, sized(utf8(name), 2), typed, sized(content, 4))


def _body(elements: list[Column]) -> Column:
    namespaces = F.concat(raw("0001"), sized(utf8(NAMES.socket_namespace), 2))
    return F.concat(utf8("jxmg"), raw("00"), namespaces, number(len(elements), 2), *elements)


def _package(body: Column) -> Column:
    headers = F.concat(
        sized(utf8("content-type"), 1), sized(utf8("application/x-jxta-msg"), 2),
        sized(utf8("content-length"), 1), raw("0008"), number(F.length(body), 8), raw("00"),
    )
    return F.concat(headers, body)


def _router(pipe: Column) -> Column:
    address = F.concat(F.lit("<Router><Dest>jxta://uuid-1/PipeService/"), pipe, F.lit("</Dest></Router>"))
    return _element(1, F.lit(NAMES.router_name), utf8(address))


def _advertisement(tag: str, pipe: Column) -> Column:
    text = F.concat(F.lit("<jxta:PipeAdvertisement><Id>"), pipe, F.lit("</Id></jxta:PipeAdvertisement>"))
    return _element(2, F.lit(tag), utf8(text))


def event_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Events sent as socket messages over TCP, written as captures and ingested with their payload."""
    user = F.col("user_id").cast("string")
    data_pipe, ack_pipe = F.concat(F.lit("d"), user), F.concat(F.lit("a"), user)
    count = F.get_json_object("props", "$.k")
    event = F.col("event_type")
    body = (
        F.when(event == "view", _body([_router(data_pipe), _element(1, count, utf8(F.col("props")), NAMES.block_type)]))
        .when(event == "click", _body([_router(ack_pipe), _element(1, F.lit(NAMES.ack_name), number(count, 4))]))
        .when(event == "error", _body([_router(data_pipe), _element(2, F.lit(NAMES.close_tag), raw(""))]))
        .when(event == "signup", _body([_router(F.lit("listener")), _advertisement(NAMES.request_tag, ack_pipe)]))
        .otherwise(_body([_router(ack_pipe), _advertisement(NAMES.response_tag, data_pipe)]))
    )
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", origin, F.col("ts"))
    sent = table(spark, folder, "events").select("event_id", "user_id", us.alias("us"), body.alias("body"))
    sent = sent.withColumn("stream", _package(F.col("body")))
    cut = segments_of(sent, ["event_id", "user_id", "us"])
    frame = ethernet(
        F.lit(4), F.lit(6), F.col("user_id") % (1 << 31), F.lit(1), F.col("inner")
    )
    cut = cut.withColumn("inner", tcp(F.lit(1000), F.lit(9701), F.col("piece"), F.col("payload")))
    packets = cut.select("event_id", "user_id", "piece", "us", frame.alias("frame"))
    captures = write_captures(packets, "user_id", ["event_id", "piece"])
    return ingest_packets(spark, captures, new_path(spark, "packets"), payload=True)


def captured_messages(spark: SparkSession, folder: str) -> DataFrame:
    return ingest_messages(event_captures(spark, folder), new_path(spark, "messages"))


def capture_messages(spark, folder):
    """The messages found in the captures, without their place in them."""
    listed = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("seqs", "acks")]
    return captured_messages(spark, folder).select(
        "kind", F.when(F.col("kind") != "req", F.col("pipe_id")).alias("pipe_id"), "adv_pipe_id",
        "first_ms", "last_ms", "payload_bytes", *listed,
    )


def capture_metrics(spark, folder):
    """From capture files to the metric series."""
    messages = captured_messages(spark, folder)
    return socket_performance(messages, number_step=MESSAGE_STEP).metrics()


QUERIES = {
    f.__name__: f
    for f in (
        pcap_ingest,
        pcap_ingest_split,
        pcap_losses,
        pcap_losses_split,
        capture_frame_count,
        capture_payload_totals,
        capture_port_traffic,
        capture_ipv4_totals,
        reassembled_messages,
        reassembled_messages_chunked,
        resumed_messages,
        message_losses,
        message_losses_chunked,
        capture_messages,
        capture_metrics,
    )
}
