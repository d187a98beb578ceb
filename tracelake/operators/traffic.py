"""Flat aggregates over packets and text. All of them pre-aggregate before the shuffle."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.columns import WORD_DELIMITERS, packet_bytes
from tracelake.functions.scan import CHUNK_ROWS, Running, chunk_of, hot_keys, running

#: Binary logarithm of the registers of a distinct-count sketch.
SKETCH_PRECISION = 14


def frame_count(packets: DataFrame) -> DataFrame:
    """A-1, PRJ-1: one row with the number of frames."""
    frames = packets.where("frame_no > 0")
    return frames.agg(F.count("*").alias("frames")).select(F.lit("frameNum").alias("label"), "frames")


def payload_totals(packets: DataFrame) -> DataFrame:
    """A-2, PRJ-2, PRJ-6: wire length and TCP payload length summed over TCP packets of any IP version."""
    totals = packets.where("l4 = 'tcp'").agg(
        F.sum("wire_len").alias("wireLen"), F.sum("tcp_payload_len").alias("payloadLen")
    )
    return totals.unpivot([], ["wireLen", "payloadLen"], "label", "total").select(
        "label", F.coalesce("total", F.lit(0)).alias("total")
    )


def service_packets(packets: DataFrame) -> DataFrame:
    """PRJ-3, PRJ-4: IPv4 packets that carry a TCP or UDP destination port."""
    return packets.where("ip_version = 4 and l4 in ('tcp', 'udp') and dst_port is not null")


def _by_port(packets: DataFrame) -> DataFrame:
    return (
        service_packets(packets)
        .groupBy("dst_port")
        .agg(F.sum(packet_bytes()).alias("bytes"), F.count("*").alias("packets"))
    )


def port_traffic(packets: DataFrame) -> DataFrame:
    """A-3, A-5, SO-1: bytes and packets per destination port, in port order."""
    return _by_port(packets).orderBy("dst_port")


def port_traffic_text(packets: DataFrame) -> DataFrame:
    """A-4, SO-2: as ``port_traffic``, with the port as text and in text order."""
    by_port = _by_port(packets)
    return by_port.select(F.col("dst_port").cast("string").alias("port"), "bytes", "packets").orderBy("port")


def word_count(lines: DataFrame, text: str = "value") -> DataFrame:
    """A-6: occurrences of every whitespace token, case kept."""
    pieces = lines.select(F.explode(F.split(F.col(text), WORD_DELIMITERS)).alias("word"))
    return pieces.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def ipv4_totals(packets: DataFrame) -> DataFrame:
    """A-17: IPv4 bytes and packets per trace."""
    return (
        packets.where("ip_version = 4")
        .groupBy("trace_file")
        .agg(F.sum(F.col("ip_total_len").cast("bigint")).alias("bytes"), F.count("*").alias("packets"))
    )


def ipv4_cardinalities(packets: DataFrame, approximate: bool = False) -> DataFrame:
    """A-18: distinct addresses, sources, destinations, flows and TCP ports of the IPv4 packets.

    The exact form shuffles each (measure, value) pair once and counts what arrives, so no task holds
    all values of one measure. The approximate form is a single partial aggregate.
    """
    pairs = _ipv4_values(packets)
    if approximate:
        return pairs.groupBy("measure").agg(F.approx_count_distinct("value").alias("n"))
    return pairs.distinct().groupBy("measure").agg(F.count("value").alias("n"))


def _ipv4_values(packets: DataFrame, *columns: str) -> DataFrame:
    """``columns``, measure and value of what ``ipv4_cardinalities`` counts."""
    ipv4 = packets.where("ip_version = 4")
    tcp = F.col("l4") == "tcp"
    flow = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("ip_src", "src_port", "ip_dst", "dst_port", "l4")])
    values: list[tuple[str, Column]] = [
        ("addresses", F.col("ip_src").cast("string")),
        ("addresses", F.col("ip_dst").cast("string")),
        ("sources", F.col("ip_src").cast("string")),
        ("destinations", F.col("ip_dst").cast("string")),
        ("flows", F.when(F.col("l4").isNotNull(), flow)),
        ("tcp_src_ports", F.when(tcp, F.col("src_port").cast("string"))),
        ("tcp_dst_ports", F.when(tcp, F.col("dst_port").cast("string"))),
    ]
    return ipv4.select(
        *columns, F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), v.alias("value")) for n, v in values]))
    )


def cardinality_sketches(packets: DataFrame, precision: int = SKETCH_PRECISION) -> DataFrame:
    """A-18, mergeable: (trace_file, measure, sketch), the state of a distinct count for each trace.

    Written once for each capture, sketches answer for any set of captures without their packets. A sketch has some
    2^``precision`` bytes at most, and fewer for few values.
    """
    values = _ipv4_values(packets, "trace_file").groupBy("trace_file", "measure")
    return values.agg(F.hll_sketch_agg("value", F.lit(precision)).alias("sketch"))


def merged_cardinalities(sketches: DataFrame) -> DataFrame:
    """A-18: measure and n over the traces of ``cardinality_sketches``; n is off by ``sketch_error`` at most, three sigmas."""
    merged = sketches.groupBy("measure").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("measure", F.hll_sketch_estimate("sketch").alias("n"))


def sketch_error(precision: int = SKETCH_PRECISION) -> float:
    """Three standard errors of a merged sketch, as a share of the count."""
    return 3 * 1.04 / math.sqrt(1 << precision)


def running_totals(packets: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """W-2: cumulative IPv4 bytes and packets after each IPv4 packet of a trace."""
    ipv4 = packets.where("ip_version = 4").select(
        "trace_file", "frame_no", "ip_total_len", chunk_of("frame_no", chunk_rows).alias("chunk")
    )
    return running(
        ipv4,
        ["trace_file"],
        ["frame_no"],
        ["chunk"],
        [
            Running("bytes", F.col("ip_total_len").cast("bigint"), "sum"),
            Running("packets", F.lit(1).cast("bigint"), "sum"),
        ],
        hot_keys(ipv4, ["trace_file"], chunk_rows),
    ).drop("chunk", "ip_total_len")
