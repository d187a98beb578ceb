"""Reassembly, the message format and message kinds."""

import random
import struct

import pytest

from tests.captures import capture, ethernet, ipv4, tcp
from tracelake.functions import scan
from tracelake.plans.ingest import ingest_messages
from tracelake.schemas import PACKETS
from tracelake.sources import reassembly
from tracelake.sources.captures import read_pcap
from tracelake.sources.reassembly import length_prefixed, reassemble, reassemble_messages
from tracelake.sources.wire import classify_messages, message_elements, package_length, parse_messages

FIELDS = ("trace_file", "frame_no", "ts_ms", "ip_src", "ip_dst", "l4", "src_port", "dst_port", "tcp_seq", "payload")


def marked(start):
    """Framing with a mark, so that some bytes begin no message."""
    if start and start[:1] != b"M":
        return 0
    return None if len(start) < 3 else 3 + int.from_bytes(start[1:3], "big")


def packet_table(spark, packets):
    rows = []
    for p in packets:
        row = dict.fromkeys(PACKETS.names)
        row.update(zip(FIELDS, p), tcp_payload_len=len(p[-1]))
        rows.append(tuple(row[c] for c in PACKETS.names))
    return spark.createDataFrame(rows, PACKETS)


def by_hand(packets, most=None):
    """Messages of each flow and bytes left over, walking the packets one at a time."""
    waiting, found = {}, []
    for trace, no, ms, src, dst, _, sport, dport, seq, payload in packets:
        flow = (trace, src, sport, dst, dport)
        held, parts = waiting.pop(flow, (b"", {}))
        data, parts = held + payload, {**parts, seq: ms}
        place = 0
        while data and (most is None or place < most):
            if data[:1] != b"M":
                data = b""
            elif len(data) < 3 or len(data) < 3 + int.from_bytes(data[1:3], "big"):
                waiting[flow] = (data, parts)
                break
            else:
                size = 3 + int.from_bytes(data[1:3], "big")
                found.append((*flow, (no << 16) + place, parts[min(parts)], parts[max(parts)], data[:size]))
                data, parts, place = data[size:], {seq: ms}, place + 1
    return sorted(found), {flow: len(held) for flow, (held, _) in waiting.items()}


def random_packets(rng, count, flows):
    packets, streams = [], {}
    for no in range(1, count + 1):
        i = rng.randrange(flows) if rng.random() < 0.5 else 0
        stream = streams.get(i, b"")
        while len(stream) < 60:
            body = bytes(rng.choice(b"Mxyz") for _ in range(rng.choice([0, 1, 5, 20, 200])))
            stream += b"M" + struct.pack(">H", len(body)) + body
            if rng.random() < 0.1:
                stream += b"junk" * rng.randrange(4)
        size = rng.choice([1, 2, 7, 30, 60])
        payload, streams[i] = stream[:size], stream[size:]
        packets.append(("t", no, 1000 + rng.randrange(500), f"s{i}", "d", "tcp", 1, 2, rng.randrange(10), payload))
    return packets


@pytest.mark.parametrize(
    "chunk_rows, most, broadcast_keys", [(1 << 20, None, 9), (1 << 20, 3, 9), (60, None, 9), (25, 3, 9), (60, None, 0)]
)
def test_reassembly_matches_a_plain_walk(spark, monkeypatch, chunk_rows, most, broadcast_keys):
    monkeypatch.setattr(scan, "BROADCAST_KEYS", broadcast_keys)
    monkeypatch.setattr(reassembly, "BROADCAST_KEYS", broadcast_keys)
    packets = random_packets(random.Random(chunk_rows), 200, 4)
    found = reassemble(packet_table(spark, packets), marked, most, chunk_rows)
    whole, left = by_hand(packets, most)
    assert sorted(tuple(r[:-1]) + (bytes(r[-1]),) for r in found.messages.collect()) == whole
    assert {tuple(r[:-1]): r.bytes for r in found.unfinished.collect()} == left


def accounted(found):
    """Bytes in messages, in losses and in what flows leave unfinished."""
    whole = sum(len(r.message) for r in found.messages.collect())
    return whole, sum(r.bytes for r in found.losses.collect()), sum(r.bytes for r in found.unfinished.collect())


@pytest.mark.parametrize("chunk_rows", [1 << 20, 30])
@pytest.mark.parametrize("size", [100, 37])
def test_one_bad_header_costs_one_message(spark, chunk_rows, size):
    """In 400 packets, wherever their cuts lie, all messages but the damaged one are found."""
    rng = random.Random(size)
    sent = [b"%04d" % i + bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 40, 96, 300]))) for i in range(400 * size // 120)]
    bad = len(sent) // 2
    stream = b"".join((b"\x7f\xff\xff\xff" if i == bad else struct.pack(">I", len(m))) + m for i, m in enumerate(sent))
    cuts = [stream[i : i + size] for i in range(0, len(stream), size)]
    packets = [("t", no, no, "s", "d", "tcp", 1, 2, no, cut) for no, cut in enumerate(cuts, 1)]
    found = reassemble(packet_table(spark, packets), length_prefixed, chunk_rows=chunk_rows)
    messages = {bytes(r.message)[4:] for r in found.messages.collect()}
    assert messages == set(sent) - {sent[bad]}
    assert {r.why for r in found.losses.collect()} <= {reassembly.TOO_LONG, reassembly.NO_MESSAGE}
    assert accounted(found) == (len(stream) - len(sent[bad]) - 4, len(sent[bad]) + 4, 0)


@pytest.mark.parametrize("most", [None, 3])
def test_every_byte_is_accounted_for(spark, most):
    """With junk, bad headers and limits, messages, losses and unfinished bytes are all that was sent, cut into chunks or not."""
    packets = random_packets(random.Random(most or 5), 300, 4)
    results = []
    for chunk_rows in (1 << 20, 40):
        found = reassemble(packet_table(spark, packets), marked, most, chunk_rows, largest=120)
        assert sum(accounted(found)) == sum(len(p[-1]) for p in packets)
        results.append(sorted(tuple(r[:-1]) + (bytes(r[-1]),) for r in found.messages.collect()))
        whys = {r.why for r in found.losses.collect()}
        assert reassembly.TOO_LONG in whys and whys <= {reassembly.TOO_LONG, reassembly.NO_MESSAGE, reassembly.TOO_MANY}
        assert max(len(r.message) for r in found.messages.collect()) <= 120
    assert results[0] == results[1] and results[0]


def test_a_long_message_adds_no_rounds(spark, monkeypatch):
    """Chunks in the middle of one message are walked as one, however many they are."""
    body = b"x" * 400  # as a length, these bytes name more than any message has
    stream = b"".join(len(part).to_bytes(4, "big") + part for part in (body, b"y" * 25, body, b"z"))
    packets = [
        ("t", i + 1, i, "a", "b", "tcp", 1, 2, i, stream[at : at + 10]) for i, at in enumerate(range(0, len(stream), 10))
    ]
    written, staged = [], reassembly.staged
    monkeypatch.setattr(reassembly, "staged", lambda df, name: written.append(name) or staged(df, name))
    found = reassemble(packet_table(spark, packets), length_prefixed, chunk_rows=4)
    assert [bytes(r["message"][4:]) for r in found.messages.orderBy("msg_no").collect()] == [body, b"y" * 25, body, b"z"]
    assert found.losses.count() == found.unfinished.count() == 0
    assert written.count("messages") <= 4


def test_a_header_without_end_is_given_up(spark):
    never = lambda start: None if start[:1] == b"H" else 0
    packets = [("t", no, no, "s", "d", "tcp", 1, 2, no, b"H" * 60_000) for no in range(1, 12)]
    found = reassemble(packet_table(spark, packets), never)
    assert found.messages.count() == 0
    whole, lost, left = accounted(found)
    assert lost + left == 660_000 and left <= reassembly.LONGEST_HEADER + 60_000


def test_length_prefix():
    assert length_prefixed(b"\0\0") is None
    assert length_prefixed(b"\0\0\0\5abc") == 9


def text(value):
    return struct.pack(">H", len(value)) + value.encode()


def element(namespace, name, content, kind=None, signed=False):
    flags = bool(kind) | 4 * signed
    out = b"jxel" + bytes([namespace, flags]) + text(name) + (text(kind) if kind else b"")
    out += struct.pack(">I", len(content)) + content
    return out + (element(0, "sig", b"signed") if signed else b"")


def package(*elements, extra=b""):
    body = b"jxmg\0" + struct.pack(">H", 1) + text("JXTASOC") + struct.pack(">H", len(elements)) + b"".join(elements)
    headers = b"\x0ccontent-type" + text("application/x-jxta-msg")
    headers += b"\x0econtent-length" + struct.pack(">HQ", 8, len(body))
    return headers + b"\0" + body + extra


def router(pipe):
    return element(1, "EndpointRouterMsg", f"<Router><Dest>\n jxta://uuid-1/PipeService/{pipe} </Dest></Router>".encode())


def advertisement(tag, pipe):
    return element(2, tag, f"<?xml version='1.0'?><jxta:PipeAdvertisement><Id>{pipe}</Id></jxta:PipeAdvertisement>".encode())


BLOCK = "application/x-jxta-msg-reliable-block"


def test_framing_and_elements():
    whole = package(element(1, "4", b"abc", BLOCK, signed=True), element(2, "close", b""))
    assert package_length(whole) == len(whole)
    assert package_length(whole + b"more") == len(whole)
    header = whole.index(b"jxmg")
    for cut in range(header):
        assert package_length(whole[:cut]) is None
    for other in (b"JXTAHELLO tcp://1.2.3.4", b"\0", b"GET / HTTP/1.1"):
        assert package_length(other) == 0
    assert message_elements(whole) == [("jxta", "4", BLOCK, b"abc"), ("JXTASOC", "close", None, b"")]
    for damaged in (whole[:-1], whole[: len(whole) // 2], whole.replace(b"jxel", b"lexj")):
        with pytest.raises((ValueError, IndexError, struct.error)):
            message_elements(damaged)


def test_capture_to_messages(spark, tmp_path):
    sent = [
        package(router("a1"), advertisement("reqPipe", "urn:a1")),
        package(router("urn:a1"), advertisement("remPipe", "urn:d1")),
        package(router("urn:d1"), element(1, "1", b"x" * 300, BLOCK), element(1, "2", b"yy", BLOCK), element(1, "oops", b"", BLOCK)),
        package(router("urn:a1"), element(1, "jxta-reliable-ack", struct.pack(">iii", 1, 2, -7) + b"\0")),
        package(router("urn:d1"), element(2, "close", b"")),
        package(router("urn:d1"), element(1, "chat", b"something else")),
        package(router("urn:a1"), element(1, "jxta-reliable-ack", b"")),
    ]
    stream = b"".join(sent)
    records = [(1, 0, ethernet(ipv4(tcp(b"JXTAHELLO tcp://10.0.0.1:9701"), 6)))]
    for i in range(0, len(stream), 110):
        records.append((2 + i, 5000, ethernet(ipv4(tcp(stream[i : i + 110], seq=100 + i), 6))))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x").write_bytes(capture(records))
    packets = read_pcap(spark, str(tmp_path / "c"), payload=True)
    rows = classify_messages(parse_messages(reassemble_messages(packets, package_length))).orderBy("msg_no").collect()
    columns = ("kind", "pipe_id", "adv_pipe_id", "payload_bytes", "seqs", "acks")
    assert [tuple(r[c] for c in columns) for r in rows] == [
        ("req", "a1", "urn:a1", 0, [], []),
        ("rem", "urn:a1", "urn:d1", 0, [], []),
        ("data", "urn:d1", None, 302, [1, 2], []),
        ("ack", "urn:a1", None, 0, [], [1, 2, -7]),
        ("close", "urn:d1", None, 0, [], []),
        ("ack", "urn:a1", None, 0, [], []),
    ]
    starts = [sum(map(len, sent[:i])) for i in range(len(sent) + 1)]
    spans = [((starts[i] // 110) * 110, ((starts[i + 1] - 1) // 110) * 110) for i in (0, 1, 2, 3, 4, 6)]
    assert [(r.first_ms, r.last_ms) for r in rows] == [((2 + a) * 1000 + 5, (2 + b) * 1000 + 5) for a, b in spans]


def test_losses_of_an_ingest(spark, tmp_path):
    """Messages that do not parse, blocks without number, junk and an unfinished message are listed with their bytes."""
    good = package(router("urn:d1"), element(1, "1", b"abc", BLOCK))
    broken = package(router("urn:d1")).replace(b"jxel", b"lexj")
    unnamed = package(router("urn:d1"), element(1, "-4", b"12345", BLOCK), element(1, "x", b"1234567", BLOCK))
    parts = [b"JXTAHELLO tcp://10.0.0.1:9701", good, broken, unnamed, good + good[:50]]
    packets = packet_table(spark, [("t", no, no, "s", "d", "tcp", 1, 2, no, part) for no, part in enumerate(parts, 1)])
    messages = ingest_messages(packets, str(tmp_path / "messages"), losses=str(tmp_path / "losses"))
    assert [tuple(r) for r in messages.orderBy("msg_no").select("kind", "seqs").collect()] == [("data", [1]), ("data", []), ("data", [1])]
    lost = spark.read.parquet(str(tmp_path / "losses"))
    rows = sorted((r["why"], r["frame_no"], (r["msg_no"] or 0) >> 16, r["bytes"]) for r in lost.collect())
    assert rows == [
        ("block without number", None, 4, 5), ("block without number", None, 4, 7), ("no message", 1, 0, len(parts[0])),
        ("not parsed", None, 3, len(broken)), ("unfinished", None, 0, 50),
    ]
    outside = sum(size for why, _, _, size in rows if why != "block without number")
    assert outside + 2 * len(good) + len(unnamed) == sum(map(len, parts))
