"""Sinks and scalar expressions."""

import datetime
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tracelake.functions.columns import array_text, epoch_ms, file_name, pair_text, pair_values, second_bucket, words
from tracelake.functions.staging import shared_folder
from tracelake.operators.metrics import metric_sizes, rebase_time
from tracelake.operators.traffic import (
    cardinality_sketches,
    ipv4_cardinalities,
    merged_cardinalities,
    sketch_error,
    word_count,
)
from tracelake.schemas import METRICS
from tests.captures import capture, ethernet, ipv4, tcp
from tracelake.sinks.tables import read_by_key, read_lines_as, write_by_key, write_report, write_series, write_tab
from tracelake.sources.text import read_lines


def lines(path):
    return sorted(line for part in path.glob("**/part-*") for line in part.read_text().splitlines())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_reports(spark, tmp_path):
    ports = spark.createDataFrame([(443, 482225092, 361424), (67, 1312, 4)], "port int, bytes bigint, packets bigint")
    write_report(ports, str(tmp_path / "report"))
    assert lines(tmp_path / "report") == ["443 482225092 361424", "67 1312 4"]
    assert read_lines(spark, str(tmp_path / "report")).count() == 2
    write_tab(ports.select("port", pair_text(F.col("bytes"), F.col("packets"))), str(tmp_path / "tab"))
    assert lines(tmp_path / "tab") == ["443\t482225092 361424", "67\t1312 4"]
    with pytest.raises(AnalysisException):
        write_tab(ports, str(tmp_path / "tab"))


def test_folder_per_key(spark, tmp_path):
    metrics = spark.createDataFrame([("arv", 7, 2), ("rtt", 7, -4), ("rtt", 8, 30)], METRICS)
    write_by_key(metrics, str(tmp_path / "m"), F.col("metric"), "metric")
    assert lines(tmp_path / "m" / "metric=rtt") == ["7 -4", "8 30"]
    back = read_by_key(spark, str(tmp_path / "m"), "sec bigint, value bigint, metric string")
    assert back.select("metric", "sec", "value").exceptAll(metrics).count() == 0
    write_by_key(metrics, str(tmp_path / "k"), F.concat(F.col("metric"), F.lit("-"), F.col("sec")))
    assert {p.name for p in (tmp_path / "k").glob("folder=*")} == {"folder=arv-7", "folder=rtt-7", "folder=rtt-8"}


def test_time_columns_do_not_depend_on_the_zone(spark):
    moment = datetime.datetime(2024, 1, 1, 0, 0, 7, 179_999)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(moment,)], "ts timestamp_ntz")
        assert df.select(epoch_ms(F.col("ts"))).first()[0] == 1_704_067_207_179
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert one(spark, second_bucket(F.lit(1_704_067_207_999))) == 1_704_067_207


def test_text_columns(spark):
    assert one(spark, words(F.lit(" a\tb\n\nA  c\r\f"))) == ["a", "b", "A", "c"]
    assert one(spark, words(F.lit("  "))) == []
    assert one(spark, file_name(F.lit("hdfs://n/in/trace.pcap"))) == "trace.pcap"
    assert one(spark, array_text(F.array(F.lit(3), F.lit(-1)))) == "(2)[3 -1 ]"
    assert one(spark, array_text(F.array().cast("array<int>"))) == "(0)[]"
    first, second = pair_values(F.lit("12 x"))
    assert (one(spark, first), one(spark, second)) == (12, None)


def test_word_count(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a").write_text("to be or\tnot\nTo be\n\n")
    text = read_lines(spark, str(tmp_path / "lines"))
    assert {tuple(r) for r in word_count(text).collect()} == {("to", 1), ("be", 2), ("or", 1), ("not", 1), ("To", 1)}


def test_series(spark):
    metrics = spark.createDataFrame([("arv", 7, 2), ("rtt", 9, 1), ("rtt", 9, 3), ("rtt", 12, 1)], METRICS)
    assert {tuple(r) for r in metric_sizes(metrics).collect()} == {("arv", 1), ("rtt", 2)}
    assert sorted(r.sec for r in rebase_time(metrics).collect()) == [0, 2, 2, 5]
    assert sorted(r.sec for r in rebase_time(metrics, "metric").collect()) == [0, 0, 0, 3]
    with pytest.raises(ValueError):
        rebase_time(metrics, "trace")


def test_cardinalities(spark):
    rows = [(4, "a", "b", 1, 80, "tcp"), (4, "b", "a", 80, 1, "tcp"), (4, "a", "c", 5, 53, "udp"), (4, "a", "c", None, None, None), (6, "x", "y", 1, 2, "tcp")]
    packets = spark.createDataFrame(rows, "ip_version int, ip_src string, ip_dst string, src_port int, dst_port int, l4 string")
    want = {"addresses": 3, "sources": 2, "destinations": 3, "flows": 3, "tcp_src_ports": 2, "tcp_dst_ports": 2}
    for approximate in (False, True):
        assert {r.measure: r.n for r in ipv4_cardinalities(packets, approximate).collect()} == want


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_shared_folder_lies_below_the_warehouse_where_the_session_names_none():
    settings = {"spark.sql.warehouse.dir": "hdfs://n/warehouse"}
    for master in ("local[2]", "yarn"):
        context = SimpleNamespace(master=master, applicationId="app")
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, *default: settings.get(key, *default)), sparkContext=context)
        assert shared_folder(session) == "hdfs://n/warehouse/tracelake/app"


def test_text_is_written_as_it_is(spark, tmp_path):
    rows = [('"hello"', 1, "a"), ("#x", None, ""), (" d ", 2, None), (None, 3, "a b"), ("", 4, '"')]
    df = spark.createDataFrame(rows, "word string, n int, key string")
    write_tab(df.select("n", "word"), str(tmp_path / "tab"))
    assert lines(tmp_path / "tab") == sorted(["1\t\"hello\"", "\\N\t#x", "2\t d ", "3\t\\N", "4\t"])
    back = read_lines_as(spark, str(tmp_path / "tab"), "n int, word string")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select("n", "word").collect()))
    write_report(spark.createDataFrame([(443, None, 7)], "a int, b int, c int"), str(tmp_path / "report"))
    assert lines(tmp_path / "report") == ["443 \\N 7"]
    write_by_key(df.select("n", "word", "key"), str(tmp_path / "keys"), F.col("key"), "key")
    back = read_by_key(spark, str(tmp_path / "keys"), "n int, word string, key string")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select("n", "word", "key").collect()))


def test_a_small_key_is_one_file(spark, tmp_path):
    write_by_key(spark.range(1000).repartition(20), str(tmp_path / "k"), F.col("id") % 7)
    for folder in (tmp_path / "k").glob("folder=*"):
        assert len(list(folder.glob("part-*"))) == 1


def test_folders_are_replaced_whole_or_not_at_all(spark, tmp_path):
    """A failing task leaves what was there; a finished job replaces the folders of its own keys only."""
    path = str(tmp_path / "k")

    def there():
        return {f.name: sorted(lines(f)) for f in (tmp_path / "k").glob("k=*") if list(f.glob("part-*"))}

    write_by_key(spark.range(40).selectExpr("id v", "cast(id % 4 as string) k"), path, F.col("k"), "k")
    before = there()
    assert set(before) == {"k=0", "k=1", "k=2", "k=3"}
    new = spark.range(0, 4000, 1, 8).selectExpr("id v", "cast(1 + id % 2 * 4 as string) k")
    with pytest.raises(Exception, match="broken row"):
        broken = new.withColumn("v", F.expr("if(v = 3999, raise_error('broken row'), v)"))
        write_by_key(broken, path, F.col("k"), "k", replace=True)
    assert there() == before
    with pytest.raises(Exception, match="broken row"):
        write_by_key(broken, str(tmp_path / "other"), F.col("k"), "k")
    assert not list(tmp_path.glob("other/k=*"))
    write_by_key(new, path, F.col("k"), "k", replace=True)
    after = there()
    assert {k: v for k, v in after.items() if k not in ("k=1", "k=5")} == {k: before[k] for k in ("k=0", "k=2", "k=3")}
    assert len(after["k=1"]) == len(after["k=5"]) == 2000
    assert not list(tmp_path.glob("k/.spark-staging*"))


def test_readme_code_runs(spark, tmp_path):
    code = Path(__file__).resolve().parent.parent.joinpath("README.md").read_text().split("```python\n")[1].split("```")[0]
    (tmp_path / "captures").mkdir()
    (tmp_path / "captures" / "a").write_bytes(capture([(1, 0, ethernet(ipv4(tcp(b"x" * 9), 6)))]))
    exec(code.replace("hdfs:///", f"{tmp_path}/"), {"spark": spark})
    assert lines(tmp_path / "reports" / "ports")


def test_series_files_are_sorted_in_the_order_of_their_names(spark, tmp_path):
    """A large series is several files, a small one a single file; null and empty keys have folders, too."""
    rows = [("hot", i * 7919 % 5000, i) for i in range(30_000)] + [("small", 3, 1), ("small", 1, 2), (None, 1, 1), ("", 2, 2)]
    df = spark.createDataFrame(rows, "metric string, sec int, value int").repartition(5)
    path = str(tmp_path / "series")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_series(df, path, "metric", ["sec", "value"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for metric in ("hot", "small"):
        files = sorted((tmp_path / "series" / f"metric={metric}").glob("part-*"))
        lines = [tuple(map(int, line.split(" "))) for file in files for line in file.read_text().splitlines()]
        assert lines == sorted((sec, value) for name, sec, value in rows if name == metric)
        assert len(files) > 2 if metric == "hot" else len(files) == 1
    back = read_by_key(spark, path, "sec int, value int, metric string").select("metric", "sec", "value")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(Exception, match="already exists"):
        write_series(df, path, "metric", ["sec"])


def test_sketches_of_traces_merge(spark):
    """Merged sketches count what several traces share once, within the stated error."""
    packets = spark.range(60_000).selectExpr(
        "concat('t', id % 4) trace_file", "4 ip_version", "cast(id % 20000 as string) ip_src", "cast(id % 300 as string) ip_dst",
        "if(id % 2 = 0, 'tcp', null) l4", "cast(id % 1000 as int) src_port", "443 dst_port",
    )
    sketches = cardinality_sketches(packets)
    assert sketches.select("trace_file").distinct().count() == 4
    exact = {r.measure: r.n for r in ipv4_cardinalities(packets).collect()}
    merged = {r.measure: r.n for r in merged_cardinalities(sketches).collect()}
    assert exact.keys() == merged.keys() and exact["sources"] == 20_000
    assert all(abs(merged[m] - n) <= sketch_error() * n for m, n in exact.items())
    one = {r.measure: r.n for r in merged_cardinalities(sketches.where("trace_file = 't1'")).collect()}
    assert abs(one["sources"] - 5000) <= sketch_error() * 5000
