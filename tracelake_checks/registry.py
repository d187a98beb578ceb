"""One query per operator, each over whole tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake_checks import standins
from tracelake.operators import handshakes as hs
from tracelake.operators import metrics as mt
from tracelake.operators import traffic
from tracelake.operators.ordering import in_scope
from tracelake.operators.routing import assign_messages, message_events
from tracelake.operators import segments as sg
from tracelake.plans.socket_performance import SocketPerformance, handshake_table, socket_performance
from tracelake.sinks.tables import read_by_key, read_lines_as, write_by_key, write_report, write_series, write_tab
from tracelake.sources.text import read_lines
from tracelake.functions.columns import pair_text, pair_values
from tracelake.functions.scan import CHUNK_ROWS
from tracelake.functions.staging import new_path, staged


def frame_count(spark: SparkSession, folder: str) -> DataFrame:
    return traffic.frame_count(standins.event_packets(spark, folder))


def payload_totals(spark, folder):
    return traffic.payload_totals(standins.lineitem_packets(spark, folder))


def port_traffic(spark, folder):
    return traffic.port_traffic(standins.lineitem_packets(spark, folder))


def port_traffic_text(spark, folder):
    by_port = traffic.port_traffic_text(standins.lineitem_packets(spark, folder))
    return by_port.select("port", pair_text(F.col("bytes"), F.col("packets")).alias("value"))


def port_report(spark, folder):
    """The space-separated report, written and read back."""
    path = new_path(spark, "port-report")
    write_report(traffic.port_traffic(standins.lineitem_packets(spark, folder)), path)
    lines = read_lines(spark, path)
    size, packets = pair_values(F.substring_index("value", " ", -2))
    port = F.substring_index("value", " ", 1).cast("bigint")
    return lines.select(port.alias("dst_port"), size.alias("bytes"), packets.alias("packets"))


def word_count(spark, folder):
    return traffic.word_count(standins.table(spark, folder, "documents"), "text")


def ipv4_totals(spark, folder):
    return traffic.ipv4_totals(standins.lineitem_packets(spark, folder))


def ipv4_cardinalities(spark, folder):
    return traffic.ipv4_cardinalities(standins.lineitem_packets(spark, folder))


def ipv4_cardinalities_sketched(spark, folder):
    """Exact counts, and whether the sketches of all traces, merged, are within their stated error of them."""
    packets = standins.lineitem_packets(spark, folder)
    sketches = staged(traffic.cardinality_sketches(packets), "sketches")
    estimated = traffic.merged_cardinalities(sketches).withColumnRenamed("n", "estimate")
    near = F.abs(F.col("estimate") - F.col("n")) <= traffic.sketch_error() * F.col("n")
    return traffic.ipv4_cardinalities(packets).join(estimated, "measure").select("measure", "n", near.alias("near"))


def running_totals(spark, folder):
    return traffic.running_totals(standins.event_packets(spark, folder))


def handshakes(spark, folder):
    matched = hs.match_handshakes(in_scope(standins.event_messages(spark, folder)))
    return matched.select("scope", "data_pipe", "ack_pipe", "req_pos", "rem_pos", "req_ms", "rem_ms")


def orphan_requests(spark, folder):
    messages = in_scope(standins.event_messages(spark, folder))
    return hs.orphan_requests(messages, hs.match_handshakes(messages))


def orphan_counts(spark, folder):
    messages = in_scope(standins.event_messages(spark, folder))
    return hs.orphan_counts(messages, handshake_table(messages))


def assigned_messages(spark, folder):
    messages = in_scope(standins.event_messages(spark, folder))
    assigned = assign_messages(messages, handshake_table(messages))
    return assigned.select("scope", "pos", "kind", "pipe", "side", "flow", "flow_rem", "kept", "replay")


def _flows(spark, folder):
    return hs.last_handshakes(hs.match_handshakes(in_scope(standins.event_messages(spark, folder))))


def requests_per_second(spark, folder):
    return mt.requests_per_second(_flows(spark, folder))


def responses_per_second(spark, folder):
    return mt.responses_per_second(_flows(spark, folder))


def user_segments(spark, folder):
    events = message_events(standins.user_flow_messages(spark, folder))
    events, progress, _ = sg.close_early(staged(events, "events"), "off")
    return sg.segments(events, progress)


def segments(spark, folder):
    return user_segments(spark, folder).select("flow", "seq", "sent_ms", "ack_ms")


def arrivals_per_second(spark, folder):
    return mt.arrivals_per_second(user_segments(spark, folder))


def rtt_samples(spark, folder):
    return mt.rtt_samples(user_segments(spark, folder))


def rtt_lists(spark, folder):
    return mt.rtt_lists(rtt_samples(spark, folder))


def _performance(spark, folder) -> SocketPerformance:
    return socket_performance(standins.event_messages(spark, folder))


def flow_segments(spark, folder):
    return _performance(spark, folder).segments


def flow_stats(spark, folder):
    return _performance(spark, folder).stats


def flow_status(spark, folder):
    stats = _performance(spark, folder).stats
    parts = [F.col(c) for c in ("blocks", "acks", "expected", "data_complete", "ack_complete")]
    return stats.select("scope", "flow", sg.status_text(*parts).alias("status"))


def flow_health(spark, folder):
    return _performance(spark, folder).health()


def metrics_merged(spark, folder):
    return _performance(spark, folder).metrics()


def metric_sizes(spark, folder):
    return mt.metric_sizes(metrics_merged(spark, folder))


def metrics_rebased(spark, folder):
    return mt.rebase_time(metrics_merged(spark, folder))


def metrics_rebased_each(spark, folder):
    return mt.rebase_time(metrics_merged(spark, folder), "metric")


def metrics_partitioned(spark, folder):
    """One folder per metric, written and read back."""
    path = new_path(spark, "metrics")
    write_by_key(metrics_merged(spark, folder), path, F.col("metric"), "metric")
    return read_by_key(spark, path, "sec bigint, value bigint, metric string")


def metrics_replaced(spark, folder):
    """A folder per metric, of which those of arrivals and round trips are then replaced."""
    path = new_path(spark, "metrics")
    series = metrics_merged(spark, folder)
    write_by_key(series.withColumn("value", F.lit(-1).cast("bigint")), path, F.col("metric"), "metric")
    write_by_key(series.where(F.col("metric").isin("arv", "rtt")), path, F.col("metric"), "metric", replace=True)
    return read_by_key(spark, path, "sec bigint, value bigint, metric string")


def series_in_order(spark, folder):
    """The metric series as files; lines of each, and how often a line is smaller than the one before it in file order."""
    path = new_path(spark, "series")
    write_series(metrics_merged(spark, folder), path, "metric", ["sec", "value"])
    number = F.monotonically_increasing_id().alias("number")  # rises inside a block of a file
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), number]
    parts = F.split("value", " ")
    point = F.struct(parts[0].cast("bigint").alias("sec"), parts[1].cast("bigint").alias("value")).alias("point")
    lines = spark.read.schema("value string, metric string").text(path).select("metric", point, *place)
    before = F.lag("point").over(Window.partitionBy("metric", "file").orderBy("block", "number"))
    inside = lines.withColumn("less", F.coalesce(F.col("point") < before, F.lit(False)).cast("int"))
    files = inside.groupBy("metric", "file").agg(
        F.count("*").alias("lines"), F.sum("less").alias("less"), F.min("point").alias("least"), F.max("point").alias("most")
    )
    over = F.coalesce(F.col("least") < F.lag("most").over(Window.partitionBy("metric").orderBy("file")), F.lit(False))
    files = files.withColumn("less", F.col("less") + over.cast("int"))
    return files.groupBy("metric").agg(F.sum("lines").alias("lines"), F.sum("less").alias("disorder"))


def word_count_tab(spark, folder):
    """Words and counts as tab-separated text, written and read back."""
    path = new_path(spark, "words")
    write_tab(word_count(spark, folder), path)
    return read_lines_as(spark, path, "word string, n bigint")


def words_by_key(spark, folder):
    """Words in a folder for each of their first characters, written and read back."""
    path = new_path(spark, "words-by-key")
    counted = word_count(spark, folder).select("n", "word", F.substring("word", 1, 1).alias("first"))
    write_by_key(counted, path, F.col("first"), "first")
    return read_by_key(spark, path, "n bigint, word string, first string")


#: Rows in a chunk for the queries that run the plans for large inputs: most keys of the given tables are above it.
SMALL_CHUNK = 50


def _busy(spark, folder, chunk_rows=CHUNK_ROWS) -> SocketPerformance:
    return socket_performance(standins.event_messages(spark, folder, busy=True), chunk_rows=chunk_rows)


def flow_stats_completed(spark, folder):
    return _busy(spark, folder).stats


def flow_segments_completed(spark, folder):
    return _busy(spark, folder).segments


def flow_health_completed(spark, folder):
    return _busy(spark, folder).health()


def flow_status_completed(spark, folder):
    parts = [F.col(c) for c in ("blocks", "acks", "expected", "data_complete", "ack_complete")]
    return _busy(spark, folder).stats.select("scope", "flow", sg.status_text(*parts).alias("status"))


def metrics_completed(spark, folder):
    return _busy(spark, folder).metrics()


def flow_stats_global(spark, folder):
    """Flows that may run on through the traces."""
    return socket_performance(standins.event_messages(spark, folder), scope="global").stats


def running_totals_chunked(spark, folder):
    return traffic.running_totals(standins.event_packets(spark, folder), chunk_rows=SMALL_CHUNK)


def handshakes_chunked(spark, folder):
    matched = hs.match_handshakes(in_scope(standins.event_messages(spark, folder), chunk_rows=SMALL_CHUNK), 2)
    return matched.select("scope", "data_pipe", "ack_pipe", "req_pos", "rem_pos", "req_ms", "rem_ms")


def assigned_messages_chunked(spark, folder):
    messages = in_scope(standins.event_messages(spark, folder), chunk_rows=SMALL_CHUNK)
    assigned = assign_messages(messages, handshake_table(messages, 2), 2)
    return assigned.select("scope", "pos", "kind", "pipe", "side", "flow", "flow_rem", "kept", "replay")


def flow_stats_chunked(spark, folder):
    return _busy(spark, folder, chunk_rows=4).stats


def flow_segments_chunked(spark, folder):
    return _busy(spark, folder, chunk_rows=4).segments


def flow_stats_all(spark, folder):
    """Every handshake is a flow, also where a later one on its pipe replaces it."""
    return socket_performance(standins.event_messages(spark, folder), keep="all").stats


def flow_segments_all(spark, folder):
    return socket_performance(standins.event_messages(spark, folder), keep="all").segments


def flow_stats_all_chunked(spark, folder):
    return socket_performance(standins.event_messages(spark, folder, busy=True), keep="all", chunk_rows=4).stats


def rtt_lists_chunked(spark, folder):
    """Chunks of a few milliseconds, so that every second is a hot key."""
    return mt.rtt_lists(rtt_samples(spark, folder), chunk_rows=2)


QUERIES = {
    f.__name__: f
    for f in (
        ipv4_cardinalities_sketched,
        series_in_order,
        metrics_replaced,
        flow_stats_all,
        flow_segments_all,
        flow_stats_all_chunked,
        rtt_lists_chunked,
        word_count_tab,
        words_by_key,
        flow_stats_completed,
        flow_segments_completed,
        flow_health_completed,
        flow_status_completed,
        metrics_completed,
        flow_stats_global,
        running_totals_chunked,
        handshakes_chunked,
        assigned_messages_chunked,
        flow_stats_chunked,
        flow_segments_chunked,
        frame_count,
        payload_totals,
        port_traffic,
        port_traffic_text,
        port_report,
        word_count,
        ipv4_totals,
        ipv4_cardinalities,
        running_totals,
        handshakes,
        orphan_requests,
        orphan_counts,
        assigned_messages,
        requests_per_second,
        responses_per_second,
        segments,
        arrivals_per_second,
        rtt_samples,
        rtt_lists,
        flow_segments,
        flow_stats,
        flow_status,
        flow_health,
        metrics_merged,
        metric_sizes,
        metrics_rebased,
        metrics_rebased_each,
        metrics_partitioned,
    )
}
