"""Plans that have to stay as they are for large inputs."""

from pyspark.sql import functions as F

from tests.captures import capture, ethernet, ipv4, tcp
from tracelake.functions.scan import Running, chunk_of, hot_keys, running
from tracelake.operators.traffic import payload_totals, port_traffic
from tracelake.plans.ingest import ingest_packets


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def lines(text, start):
    return [line for line in text.splitlines() if line.startswith(start)]


def test_flat_queries_prune_and_push_down(spark, tmp_path, capsys):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a").write_bytes(capture([(1, 0, ethernet(ipv4(tcp(b"x" * 9), 6)))]))
    packets = ingest_packets(spark, str(tmp_path / "c"), str(tmp_path / "packets"), payload=True)
    ports = plan(port_traffic(packets), capsys)
    assert lines(ports, "ReadSchema") == [
        "ReadSchema: struct<ip_version:int,ip_header_len:int,ip_payload_len:int,l4:string,dst_port:int>"
    ]
    assert "EqualTo(ip_version,4)" in ports and "IsNotNull(dst_port)" in ports
    assert "partial_sum" in ports and "Python" not in ports
    totals = plan(payload_totals(packets), capsys)
    assert lines(totals, "ReadSchema") == ["ReadSchema: struct<wire_len:int,l4:string,tcp_payload_len:int>"]
    assert "EqualTo(l4,tcp)" in totals


def test_hot_keys_are_shuffled_by_chunk(spark, tmp_path, capsys):
    rows = spark.range(1000).select(
        F.when(F.col("id") < 800, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("n")
    )
    rows.withColumn("c", chunk_of("n", 100)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    hot = hot_keys(df, ["k"], 100)
    assert [r.k for r in hot.table.collect()] == ["hot"]
    text = plan(running(df, ["k"], ["n"], ["c"], [Running("s", F.col("n"), "sum")], hot), capsys)
    shuffles = [line.split("hashpartitioning(")[1].split(")")[0] for line in text.splitlines() if "hashpartitioning" in line]
    keys = [tuple(column.split("#")[0].strip() for column in s.split(",")[:-1]) for s in shuffles]
    assert sorted(keys) == [("k",), ("k",), ("k", "c"), ("k", "c")]
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_cold_keys_take_one_shuffle(spark, capsys):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"), F.lit(0).alias("c"))
    hot = hot_keys(df, ["k"], 100)
    text = plan(running(df, ["k"], ["n"], ["c"], [Running("s", F.col("n"), "sum")], hot), capsys)
    assert text.count("hashpartitioning") == 1
