"""Per-second series. Labels are fixed: ``req``, ``rem``, ``arv`` and ``rtt``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.columns import array_text, second_bucket
from tracelake.functions.scan import CHUNK_ROWS, Running, hot_keys, running

# Metric labels.
REQUESTS, RESPONSES, ARRIVALS, RTT = "req", "rem", "arv", "rtt"


def _per_second(df: DataFrame, ms: str) -> DataFrame:
    return df.groupBy(second_bucket(F.col(ms)).alias("sec")).agg(F.count("*").alias("n"))


def requests_per_second(flows: DataFrame) -> DataFrame:
    """A-7, PRJ-9: socket requests by second."""
    return _per_second(flows.where("req_ms > 0"), "req_ms")


def responses_per_second(flows: DataFrame) -> DataFrame:
    """A-8, PRJ-9: socket responses by second."""
    return _per_second(flows.where("rem_ms > 0"), "rem_ms")


def arrivals_per_second(segs: DataFrame) -> DataFrame:
    """A-9: segments by the second they were sent in, acked or not."""
    return _per_second(segs, "sent_ms")


def rtt_samples(segs: DataFrame) -> DataFrame:
    """A-10, PRJ-8, PRJ-10: one round-trip time per acked segment, by ack second. May be negative."""
    return segs.where("ack_ms is not null").select(
        second_bucket(F.col("ack_ms")).alias("sec"), (F.col("ack_ms") - F.col("sent_ms")).alias("rtt_ms")
    )


def rtt_lists(samples: DataFrame, part_size: int = 1000, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A-10, F-10, F-11: the sorted round-trip times of each second as text, ``part_size`` to a row.

    Equal times are counted first and a second's list is cut into parts, so a busy second is spread
    over many rows and tasks.
    """
    size = F.lit(part_size).cast("bigint")
    counted = samples.groupBy("sec", "rtt_ms").agg(F.count("*").alias("copies"))
    counted = counted.withColumn("chunk", F.floor(F.col("rtt_ms") / chunk_rows))
    hot = hot_keys(counted, ["sec"], chunk_rows)
    placed = running(counted, ["sec"], ["rtt_ms"], ["chunk"], [Running("end", F.col("copies"), "sum")], hot)
    start = F.col("end") - F.col("copies")
    first_part, last_part = (F.call_function("div", p, size) for p in (start, F.col("end") - 1))
    pieces = placed.withColumn("part", F.explode(F.sequence(first_part, last_part)))
    here = F.least("end", (F.col("part") + 1) * size) - F.greatest(start, F.col("part") * size)
    pieces = pieces.select("sec", "part", F.struct("rtt_ms", here.cast("int").alias("copies")).alias("piece"))
    lists = pieces.groupBy("sec", "part").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    values = F.flatten(F.transform("pieces", lambda p: F.array_repeat(p["rtt_ms"], p["copies"])))
    return lists.select("sec", "part", array_text(values).alias("rtts"))


def socket_metrics(flows: DataFrame, segs: DataFrame) -> DataFrame:
    """A-19: the four series over all traces as ``(metric, sec, value)``.

    ``req``, ``rem`` and ``arv`` have one count per second, ``rtt`` one row per sample.
    """

    def labelled(label: str, series: DataFrame, value: str) -> DataFrame:
        return series.select(F.lit(label).alias("metric"), "sec", F.col(value).cast("bigint").alias("value"))

    return (
        labelled(REQUESTS, requests_per_second(flows), "n")
        .unionByName(labelled(RESPONSES, responses_per_second(flows), "n"))
        .unionByName(labelled(ARRIVALS, arrivals_per_second(segs), "n"))
        .unionByName(labelled(RTT, rtt_samples(segs), "rtt_ms"))
    )


def metric_sizes(metrics: DataFrame) -> DataFrame:
    """A-13: how many seconds each series covers."""
    return metrics.select("metric", "sec").distinct().groupBy("metric").agg(F.count("*").alias("seconds"))


def rebase_time(metrics: DataFrame, scope: str = "global") -> DataFrame:
    """W-9: shift seconds so that the earliest is 0, over all series or in each ``metric``."""
    if scope == "global":
        return metrics.withColumn("sec", F.col("sec") - metrics.agg(F.min("sec")).scalar())
    if scope != "metric":
        raise ValueError(f"scope must be 'global' or 'metric', not {scope!r}")
    first = metrics.groupBy("metric").agg(F.min("sec").alias("first_sec"))
    # One row per label, four at most.
    return metrics.join(F.broadcast(first), "metric").select(
        "metric", (F.col("sec") - F.col("first_sec")).alias("sec"), "value"
    )
