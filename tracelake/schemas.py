"""Column layout of the tables that the operators exchange."""

from pyspark.sql import types as T

PACKETS = T.StructType(
    [
        T.StructField("trace_file", T.StringType()),
        T.StructField("frame_no", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("wire_len", T.IntegerType()),
        T.StructField("cap_len", T.IntegerType()),
        T.StructField("ip_version", T.IntegerType()),
        T.StructField("ip_src", T.StringType()),
        T.StructField("ip_dst", T.StringType()),
        T.StructField("ip_header_len", T.IntegerType()),
        T.StructField("ip_payload_len", T.IntegerType()),
        T.StructField("ip_total_len", T.IntegerType()),
        T.StructField("ip_proto", T.IntegerType()),
        T.StructField("l4", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tcp_seq", T.LongType()),
        T.StructField("tcp_payload_len", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

MESSAGES = T.StructType(
    [
        T.StructField("trace_file", T.StringType()),
        T.StructField("msg_no", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("pipe_id", T.StringType()),
        T.StructField("adv_pipe_id", T.StringType()),
        T.StructField("first_ms", T.LongType()),
        T.StructField("last_ms", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("seqs", T.ArrayType(T.IntegerType())),
        T.StructField("acks", T.ArrayType(T.IntegerType())),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("sec", T.LongType()),
        T.StructField("value", T.LongType()),
    ]
)
