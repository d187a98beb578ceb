"""Capture reading on files whose contents are known."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from tests.captures import capture, cooked, ethernet, ipv4, ipv6, tcp, udp
from tracelake.operators.traffic import frame_count, ipv4_totals, payload_totals, port_traffic, port_traffic_text
from tracelake.plans.ingest import ingest_packets
from tracelake.functions.staging import staged
from tracelake.sources import captures, frames
from tracelake.sources.frames import FileHeader
from tracelake.sources.captures import capture_losses, index_captures, read_pcap

ICMP = b"\x08\0\0\0\0\0\0\0"


def put(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)
    return str(folder)


def as_rows(df, *columns):
    return [tuple(r) for r in df.orderBy("trace_file", "frame_no").select(*columns).collect()]


@pytest.fixture
def two_traces(tmp_path):
    folder = tmp_path / "traces"
    put(
        folder,
        "a",
        capture(
            [
                (1, 0, ethernet(ipv4(tcp(b"x" * 44), 6))),
                (1, 10_000, ethernet(ipv4(udp(b"y" * 300), 17))),
                (1, 500_000, ethernet(ipv4(ICMP, 1), pad=18)),
                (2, 100_000, ethernet(ipv6(tcp(b"z" * 40), 6), 0x86DD)),
            ]
        ),
    )
    return put(folder, "b", capture([(3, 0, ethernet(ipv4(tcp(b"q" * 1460), 6)))]))


def test_flat_aggregates(spark, two_traces, tmp_path):
    packets = read_pcap(spark, two_traces)
    assert as_rows(packets, "frame_no", "ts_ms", "wire_len", "ip_version", "l4", "dst_port", "tcp_payload_len") == [
        (1, 1000, 98, 4, "tcp", 443, 44),
        (2, 1010, 342, 4, "udp", 67, None),
        (3, 1500, 60, 4, None, None, None),
        (4, 2100, 114, 6, "tcp", 443, 40),
        (1, 3000, 1514, 4, "tcp", 443, 1460),
    ]
    assert [tuple(r) for r in frame_count(packets).collect()] == [("frameNum", 5)]
    assert {tuple(r) for r in payload_totals(packets).collect()} == {("wireLen", 1726), ("payloadLen", 1544)}
    assert [tuple(r) for r in port_traffic(packets).collect()] == [(67, 328, 1), (443, 1584, 2)]
    assert [r.port for r in port_traffic_text(packets).collect()] == ["443", "67"]
    totals = {r.trace_file[-2:]: (r.bytes, r.packets) for r in ipv4_totals(packets).collect()}
    assert totals == {"/a": (440, 3), "/b": (1500, 1)}
    stored = ingest_packets(spark, two_traces, str(tmp_path / "packets"))
    assert [tuple(r) for r in port_traffic(stored).collect()] == [(67, 328, 1), (443, 1584, 2)]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("digits", [6, 9])
def test_byte_orders_and_time_units(spark, tmp_path, order, digits):
    fraction = 123_456 if digits == 6 else 123_456_789
    path = put(tmp_path / "c", "x.pcap", capture([(7, fraction, ethernet(ipv4(udp(b"u"), 17)))], order, digits))
    rows = as_rows(read_pcap(spark, path), "ts_us", "ts_ms", "ip_src", "ip_dst", "src_port", "dst_port")
    assert rows == [(7_123_456, 7_123, "10.0.0.1", "10.0.0.2", 1000, 67)]


def test_link_layers_and_odd_packets(spark, tmp_path):
    folder = tmp_path / "c"
    inner = ipv4(tcp(b"abc", dst=80, options=b"\1" * 4), 6, options=b"\1" * 8)
    put(folder, "cooked", capture([(1, 0, cooked(inner))], link=113))
    put(folder, "empty", capture([]))
    put(folder, "raw", capture([(1, 0, inner), (1, 0, ipv6(udp(b"q"), 17))], link=101))
    hop_by_hop = struct.pack(">BBHI", 6, 0, 0, 0) + tcp(b"12345", dst=81)
    later = struct.pack(">BBHI", 17, 0, 8 << 3, 9) + b"no ports here"
    put(
        folder,
        "tagged",
        capture(
            [
                (1, 0, ethernet(inner, tags=(0x8100,))),
                (1, 0, ethernet(inner, tags=(0x88A8, 0x8100))),
                (1, 0, ethernet(ipv4(b"only the middle", 17, fragment=5))),
                (1, 0, ethernet(ipv6(hop_by_hop, 0), 0x86DD)),
                (1, 0, ethernet(ipv6(later, 44), 0x86DD)),
                (1, 0, b"\x02" * 5),
            ]
        ),
    )
    cut = capture([(1, 0, ethernet(ipv4(tcp(b"p" * 500), 6)))], snap=60)
    put(folder, "cut", cut)
    path = put(folder, "torn", capture([(1, 0, ethernet(ipv4(udp(b"u"), 17))), (1, 0, ethernet(b"gone"))])[:-3])
    packets = read_pcap(spark, path, payload=True)
    rows = {}
    for trace, *row in as_rows(
        packets, "trace_file", "ip_version", "l4", "dst_port", "tcp_payload_len", "ip_header_len", "payload"
    ):
        rows.setdefault(trace.rsplit("/", 1)[1], []).append(tuple(row))
    plain = (4, "tcp", 80, 3, 28, b"abc")
    assert rows == {
        "cooked": [plain],
        "raw": [plain, (6, "udp", 67, None, 40, None)],
        "tagged": [
            plain,
            plain,
            (4, None, None, None, 20, None),
            (6, "tcp", 81, 5, 40, b"12345"),
            (6, None, None, None, 40, None),
            (None, None, None, None, None, None),
        ],
        "cut": [(4, "tcp", 443, 500, 20, b"p" * 6)],
        "torn": [(4, "udp", 67, None, 20, None)],
    }


def test_unreadable_capture(spark, tmp_path):
    put(tmp_path / "c", "good", capture([(1, 0, ethernet(ipv4(udp(b"u"), 17)))]))
    path = put(tmp_path / "c", "bad", b"this is not a capture at all")
    with pytest.raises(ValueError, match="unreadable captures"):
        read_pcap(spark, path)
    assert read_pcap(spark, path, mode="DROPMALFORMED").count() == 1


def test_ranges_inside_a_file(spark, tmp_path):
    """Cutting a file anywhere changes nothing, even when payloads hold whole records of another capture."""
    rng = random.Random(5)
    records = []
    for i in range(400):
        inner = bytes(rng.randrange(256) for _ in range(rng.choice([0, 10, 200, 900])))
        if i in (50, 51, 200, 333):
            fake = [(1, 1, ethernet(ipv4(udp(b"f" * rng.randrange(60)), 17))) for _ in range(400)]
            inner = b"ab" + capture(fake)[24:]
        records.append((i, i, ethernet(ipv4(tcp(inner, dst=rng.randrange(1, 5)), 6))))
    data = capture(records)
    folder = put(tmp_path / "c", "one", data)
    columns = ("frame_no", "ts_us", "dst_port", "wire_len", "payload")
    whole = as_rows(read_pcap(spark, folder, payload=True), *columns)
    assert len(whole) == 400
    assert [r[1] for r in whole] == [i * 1_000_000 + i for i in range(400)]
    for size in (9000, 50_000):
        index = index_captures(spark, folder, split_bytes=size)
        assert index.count() == -(-len(data) // size)
        assert as_rows(read_pcap(spark, folder, payload=True, split_bytes=size), *columns) == whole


def damaged(good):
    """40 records with a header that cannot be one after the 20th; returns the bytes and what is lost."""
    head, tail = capture(good[:20]), capture(good[20:])[24:]
    bad = struct.pack("<IIII", 1, 1, 0x7FFFFFFF, 1) + b"some bytes that are no record"
    return head + bad + tail, (len(head), len(bad))


def test_damage_costs_its_own_bytes(spark, tmp_path):
    good = [(i, 0, ethernet(ipv4(udp(b"u" * 20), 17))) for i in range(40)]
    data, (at, size) = damaged(good)
    path = put(tmp_path / "c", "x", data)
    put(tmp_path / "c", "torn", capture(good)[:-5])
    put(tmp_path / "c", "no capture", b"this is not a capture at all")
    for split in (300, 1 << 20):
        with pytest.raises(ValueError, match=f"/x: {size} bytes at {at}|no%20capture|no capture"):
            read_pcap(spark, path, split_bytes=split)
        packets = read_pcap(spark, path, mode="DROPMALFORMED", split_bytes=split)
        rows = as_rows(packets, "trace_file", "frame_no", "ts_us")
        assert [r[1:] for r in rows if r[0].endswith("/x")] == [(i + 1, i * 1_000_000) for i in range(40)]
        assert [r[1:] for r in rows if r[0].endswith("/torn")] == [(i + 1, i * 1_000_000) for i in range(39)]
        lost = {}
        for r in capture_losses(spark, path, split_bytes=split).collect():
            lost.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["at"], r["bytes"], r["why"]))
        torn = len(capture(good[:39]))
        assert lost["torn"] == [(torn, len(capture(good)) - 5 - torn, "cut off")]
        assert sorted(lost["x"])[0][0] == at and sum(n for _, n, _ in lost["x"]) == size
        assert {why for _, _, why in lost["x"]} == {"damaged"}
        assert [(a, n) for name, v in lost.items() if name.startswith("no") for a, n, _ in v] == [(0, 28)]
    with pytest.raises(ValueError):
        read_pcap(spark, path + "/x")
    assert read_pcap(spark, path + "/torn").count() == 39


def test_damage_adds_no_rounds(spark, tmp_path, monkeypatch):
    """However many ranges follow the damage, the index is written at most three times."""
    rng = random.Random(6)
    some = [(i, 0, ethernet(ipv4(udp(rng.randbytes(50)), 17))) for i in range(440)]
    data, more = damaged(some[:40])[0], capture(some[40:])[24:]
    path = put(tmp_path / "c", "x", data + more)
    written = []
    monkeypatch.setattr(captures, "staged", lambda df, name: written.append(name) or staged(df, name))
    for split in (400, 3000):
        written.clear()
        assert read_pcap(spark, path, mode="DROPMALFORMED", split_bytes=split).count() == 440
        assert written.count("capture-index") <= 3


def test_large_gaps_are_crossed(spark, tmp_path, monkeypatch):
    good = [(i, 0, ethernet(ipv4(udp(b"u" * 20), 17))) for i in range(60)]
    gap = struct.pack("<IIII", 1, 1, 0x7FFFFFFF, 1) + b"\xff" * 9000
    path = put(tmp_path / "c", "x", capture(good[:30]) + gap + capture(good[30:])[24:])
    monkeypatch.setattr(captures, "SYNC_BYTES", 4096)
    for split in (2500, 1 << 20):
        assert read_pcap(spark, path, mode="DROPMALFORMED", split_bytes=split).count() == 60
        assert sum(r["bytes"] for r in capture_losses(spark, path, split_bytes=split).collect()) == len(gap)


def test_random_damage_anywhere_and_any_split(spark, tmp_path):
    """Whatever the ranges, the same records are found, and found and lost bytes are the file."""
    rng = random.Random(12)
    data, wanted = capture([]), 0
    for i in range(900):
        body = struct.pack("<IIII", 1_700_000_000 + i, i, 0, 0)
        frame = ethernet(ipv4(udp(rng.randbytes(rng.choice([1, 30, 200]))), 17))
        bad = i % 60 in (37, 38) and rng.random() < 0.8  # some twice in a row
        wanted += not bad
        data += body[:8] + struct.pack("<II", 0x7FFFFFFF if bad else len(frame), len(frame)) + frame
    path = put(tmp_path / "c", "x", data)
    seen = []
    for split in (1 << 20, 30_000, 1500):
        packets = read_pcap(spark, path, mode="DROPMALFORMED", split_bytes=split)
        seen.append(as_rows(packets, "frame_no", "ts_us", "wire_len"))
        lost = capture_losses(spark, path, split_bytes=split).collect()
        assert len(seen[-1]) == wanted
        assert sum(16 + size for _, _, size in seen[-1]) + sum(r["bytes"] for r in lost) + 24 == len(data)
        spans = sorted((r["at"], r["at"] + r["bytes"]) for r in lost)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert seen[0] == seen[1] == seen[2]


def test_only_asked_columns_are_decoded(spark, two_traces):
    whole = {c: as_rows(read_pcap(spark, two_traces, payload=True).orderBy("trace_file"), c) for c in ("ip_dst", "payload", "ts")}
    for asked in (["frame_no", "trace_file"], ["ts", "trace_file", "frame_no"], ["payload", "ip_dst", "frame_no", "trace_file"]):
        packets = read_pcap(spark, two_traces, columns=asked)
        assert packets.columns == asked
        for column in set(asked) & set(whole):
            assert as_rows(packets, column) == whole[column]
        assert packets.count() == 5
    with pytest.raises(ValueError, match="columns must be"):
        read_pcap(spark, two_traces, columns=["port"])
    with pytest.raises(ValueError, match="columns must be"):
        read_pcap(spark, two_traces, columns=[])


def test_layers_that_no_column_needs_are_not_parsed(monkeypatch):
    data = capture([(1, 5, ethernet(ipv4(tcp(b"x" * 44), 6)))])
    args = frames.FileHeader(data), data, np.array([24]), "t", 1

    def fail(*_):
        raise AssertionError("decoded")

    monkeypatch.setattr(frames, "_ip_text", fail)
    assert frames.packet_batch(*args, ["dst_port", "wire_len"], False).to_pylist() == [{"dst_port": 443, "wire_len": 98}]
    monkeypatch.setattr(frames, "_ip_layer", fail)
    assert frames.packet_batch(*args, ["frame_no", "ts_us"], False).to_pylist() == [{"frame_no": 1, "ts_us": 1_000_005}]


def test_small_ranges_share_tasks(spark, tmp_path):
    """Ranges far below the size of a task are dealt to as many tasks as there are cores, not to one for each."""
    data = capture([(i, 0, ethernet(ipv4(udp(b"u" * 50), 17))) for i in range(440)])
    packets = read_pcap(spark, put(tmp_path / "c", "x", data), split_bytes=400)
    assert packets.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < len(data) // 400
    assert packets.count() == 440


@pytest.mark.parametrize("order", "<>")
def test_chains_of_all_places_at_once(order):
    """``chained`` says of every place what ``trusted`` says, or that the block is too short."""
    rng = random.Random(7)
    for _ in range(60):
        records = [(rng.choice([1, 1, 2, 90_000]), 1, b"\0" * rng.choice([1, 3, 40])) for _ in range(rng.randrange(1, 60))]
        data = capture(records, order)[24:][rng.randrange(3) :] + b"\0" * rng.choice([0, 5, 40])
        header = FileHeader(capture([], order))
        part = data[: rng.randrange(16, len(data) + 1)]
        near = header.likely(part)
        for links in (2, 32):
            known, unsure = header.chained(part, near, len(data), links)
            for i, at in enumerate(near.tolist()):
                assert unsure[i] or known[i] == header.trusted(data, at, len(data), links)


def test_damage_is_searched_in_small_parts(monkeypatch):
    """What is searched for the next record grows with the damage, not with a fixed look for each."""
    good = [(i, 0, ethernet(ipv4(udp(b"u" * 20), 17))) for i in range(2000)]
    bad = struct.pack("<IIII", 1, 1, 0x7FFFFFFF, 1) + b"no record"
    data = capture([]) + b"".join(capture(good[i : i + 40])[24:] + bad for i in range(0, 2000, 40))
    looked, likely = [], FileHeader.likely
    monkeypatch.setattr(FileHeader, "likely", lambda self, block: looked.append(len(block)) or likely(self, block))
    lost = []
    walked = captures._walk(FileHeader(data[:24]), pa.BufferReader(data), 24, len(data), len(data), lost)
    assert sum(len(starts) for _, _, starts in walked) == 2000
    assert len(lost) == 50 and {loss["bytes"] for loss in lost} == {len(bad)}
    assert sum(looked) < len(data)
