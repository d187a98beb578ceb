"""Field extraction from the packet records of a classic capture file, a block of records at a time."""

import socket
import struct

import numpy as np
import pyarrow as pa

# Fixed values of the file format: magic number -> (byte order, fractions of a second per microsecond).
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1),
    b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1000),
}
FILE_HEADER = 24
RECORD_HEADER = 16
LARGEST_CAPTURE = 262144
# Seconds between two records of a chain that nothing but the chain verifies.
LONGEST_PAUSE = 86_400
# Records in a chain that is believed.
TRUSTED_LINKS = 32
# Bytes that are looked at first where the next record is searched for.
FIRST_PART = 512

# Fixed values of the link layer: type -> (offset of the protocol number or None, header length).
LINK_TYPES = {0: (None, 4), 1: (12, 14), 12: (None, 0), 14: (None, 0), 101: (None, 0), 113: (14, 16), 276: (0, 20)}
VLAN_TAGS = (0x8100, 0x88A8, 0x9100)
IPV4, IPV6 = 0x0800, 0x86DD

# Fixed values of the IP layer.
TCP, UDP = 6, 17
SIZED_EXTENSIONS = (0, 43, 60)
FRAGMENT_EXTENSION = 44


class FileHeader:
    """Byte order, time unit, capture limit and link type of a capture file."""

    def __init__(self, start: bytes):
        if len(start) < FILE_HEADER or start[:4] not in MAGIC:
            raise ValueError("not a classic capture file")
        self.order, self.per_us = MAGIC[start[:4]]
        snap, link = struct.unpack_from(self.order + "II", start, 16)
        self.limit = max(snap & 0x7FFFFFFF, LARGEST_CAPTURE)
        self.link = link & 0x0FFFFFFF
        if self.link not in LINK_TYPES:
            raise ValueError(f"link type {self.link} is not supported")
        self.record = struct.Struct(self.order + "IIII")

    def trusted(self, block: bytes, at: int, left: int, links: int = TRUSTED_LINKS) -> bool:
        """Whether a chain of ``links`` records that are not empty starts at ``at``, or one of four that leaves the block, or
        one that meets the end of the file. Their times are less than ``LONGEST_PAUSE`` apart: bytes that look like a header
        and by chance lead to a record would not have its time.

        ``left`` is the number of bytes from the start of ``block`` to the end of the file. A chain that nothing else
        verifies is believed by this.
        """
        before = None
        for link in range(links):
            if at == left:
                return True
            if at + RECORD_HEADER > len(block):
                return link >= 4
            second, fraction, size, wire = self.record.unpack_from(block, at)
            if not 0 < size <= min(self.limit, wire) or wire > LARGEST_CAPTURE or fraction >= 1_000_000 * self.per_us:
                return False
            if before is not None and abs(second - before) > LONGEST_PAUSE:
                return False
            before = second
            at += RECORD_HEADER + size
            if at > left:
                return False
        return True

    def likely(self, block: bytes) -> np.ndarray:
        """Places in ``block`` whose bytes could be the header of a record that is not empty."""
        if len(block) < RECORD_HEADER:
            return np.zeros(0, np.int64)
        data = np.frombuffer(block, np.uint8).astype(np.uint32)
        step = range(4) if self.order == "<" else range(3, -1, -1)
        words = sum(data[i : len(data) - 3 + i] << (8 * k) for k, i in zip(range(4), step))
        n = len(words) - 12
        size, wire, fraction = words[8 : 8 + n], words[12 : 12 + n], words[4 : 4 + n]
        fits = (size > 0) & (size <= self.limit) & (size <= wire) & (wire <= LARGEST_CAPTURE)
        return np.flatnonzero(fits & (fraction < 1_000_000 * self.per_us))

    def chained(self, block: bytes, near: np.ndarray, left: int, links: int) -> tuple[np.ndarray, np.ndarray]:
        """What ``trusted`` says of all places ``near`` at once, and where the block is too short to say it.

        ``near`` are all places that are ``likely`` in ``block``, in order. A place leads to the one behind its record; the
        ways are doubled until they are ``links`` long.
        """
        if not len(near):
            return np.zeros(0, bool), np.zeros(0, bool)
        data = np.frombuffer(block, np.uint8)
        words = data[near[:, None] + np.arange(RECORD_HEADER)].view(np.dtype("u4").newbyteorder(self.order)).astype(np.int64)
        after, n = near + RECORD_HEADER + words[:, 2], len(near)
        ended, left_block, broken = n, n + 1, n + 2
        place = np.minimum(np.searchsorted(near, after), n - 1)
        goes_on = (near[place] == after) & (np.abs(words[place, 0] - words[:, 0]) <= LONGEST_PAUSE)
        leads = np.where(goes_on, place, broken)
        leads = np.where(after + RECORD_HEADER > len(block), left_block, leads)
        leads = np.where(after == left, ended, np.where(after > left, broken, leads))
        leads = np.concatenate([leads, [ended, left_block, broken]])
        records = np.concatenate([after <= left, np.zeros(3, bool)]).astype(np.int64)
        covered = 1
        while covered < links:
            records, leads, covered = records + records[leads], leads[leads], 2 * covered
        known = (records >= links) | (leads == ended)
        return known[:n], (~known & (leads == left_block))[:n]

    def first_trusted(self, block: bytes, left: int) -> int | None:
        """The first place in ``block`` where a trusted chain of records begins; it is looked for in growing parts."""
        begin, size = 0, FIRST_PART
        while begin + RECORD_HEADER <= len(block):
            part = block[begin : begin + size + RECORD_HEADER - 1]  # places begin to begin + size - 1
            for at in self.likely(part).tolist():
                if self.trusted(block, begin + at, left):
                    return begin + at
            begin, size = begin + size, 4 * size
        return None


class Fields:
    """Vectorised big-endian reads at one offset per record; out-of-range bytes read as zero."""

    def __init__(self, block: bytes):
        self.data = np.frombuffer(block, np.uint8)

    def u8(self, at):
        inside = at < len(self.data)
        return np.where(inside, self.data[np.where(inside, at, 0)], 0).astype(np.int64)

    def u16(self, at):
        return self.u8(at) << 8 | self.u8(at + 1)

    def u32(self, at):
        return self.u16(at) << 16 | self.u16(at + 2)


def _ip_text(block: bytes, at: np.ndarray, size: np.ndarray, known: np.ndarray) -> list:
    """Addresses as text; each distinct address is formatted once."""
    texts: dict[bytes, str] = {}
    result = []
    for start, length, ok in zip(at.tolist(), size.tolist(), known.tolist()):
        if not ok:
            result.append(None)
            continue
        raw = block[start : start + length]
        if raw not in texts:
            texts[raw] = socket.inet_ntop(socket.AF_INET if length == 4 else socket.AF_INET6, raw)
        result.append(texts[raw])
    return result


def _ip_layer(f: Fields, kind, at, end, wire, start):
    """Version, header length, payload length, transport protocol, its offset and length."""
    version = f.u8(at) >> 4
    v4 = (kind == IPV4) & (version == 4) & (at + 20 <= end)
    v6 = (kind == IPV6) & (version == 6) & (at + 40 <= end)
    header = np.where(v4, (f.u8(at) & 15) * 4, 40)
    v4 &= header >= 20
    total = f.u16(at + 2)
    total = np.where(total == 0, wire - (at - start), total)  # left empty by segmentation offload
    payload = np.where(v4, np.maximum(total - header, 0), f.u16(at + 4))
    proto = np.where(v4, f.u8(at + 9), f.u8(at + 6))
    first = np.where(v4, (f.u16(at + 6) & 0x1FFF) == 0, True)
    inner, inner_len = at + header, payload
    while True:
        fragment = v6 & (proto == FRAGMENT_EXTENSION) & (inner + 8 <= end)
        sized = v6 & np.isin(proto, SIZED_EXTENSIONS) & (inner + 8 <= end)
        if not (fragment | sized).any():
            break
        length = np.where(fragment, 8, np.where(sized, (f.u8(inner + 1) + 1) * 8, 0))
        first &= ~fragment | (f.u16(inner + 2) >> 3 == 0)
        proto = np.where(fragment | sized, f.u8(inner), proto)
        inner, inner_len = inner + length, np.maximum(inner_len - length, 0)
    return v4, v6, header, payload, proto, first, inner, inner_len


def packet_batch(
    header: FileHeader, block: bytes, starts: np.ndarray, trace: str, first_no: int, names: list[str], payload: bool
) -> pa.RecordBatch:
    """The columns ``names`` of the ``packets`` rows of the records that begin at ``starts`` in ``block``.

    Layers that none of the columns needs are not decoded: record headers alone tell frames, times and lengths.
    """
    fixed = np.frombuffer(
        b"".join(block[s : s + RECORD_HEADER] for s in starts.tolist()), np.dtype("u4").newbyteorder(header.order)
    )
    sec, fraction, size, wire = fixed.reshape(-1, 4).T.astype(np.int64)

    def column(values, known=None, kind=pa.int32()):
        return pa.array(values, kind, mask=None if known is None else ~known)

    us = sec * 1_000_000 + fraction // header.per_us
    columns = {
        "trace_file": pa.array([trace] * len(starts), pa.string()),
        "frame_no": column(first_no + np.arange(len(starts)), kind=pa.int64()),
        "ts_us": column(us, kind=pa.int64()),
        "ts_ms": column(us // 1000, kind=pa.int64()),
        "wire_len": column(wire),
        "cap_len": column(size),
    }
    if columns.keys() >= set(names):
        return pa.RecordBatch.from_pydict({name: columns[name] for name in names})
    f = Fields(block)
    begin = starts + RECORD_HEADER
    end = begin + size
    at_kind, link_len = LINK_TYPES[header.link]
    at = begin + link_len
    if at_kind is None:
        kind = np.where(f.u8(at) >> 4 == 6, IPV6, IPV4)
    else:
        kind = f.u16(begin + at_kind)
        while (tagged := np.isin(kind, VLAN_TAGS) & (at + 4 <= end)).any():
            kind = np.where(tagged, f.u16(at + 2), kind)
            at = np.where(tagged, at + 4, at)
    v4, v6, ip_header, ip_payload, proto, first, inner, inner_len = _ip_layer(f, kind, at, end, wire, begin)
    ip = v4 | v6
    tcp = ip & first & (proto == TCP) & (inner + 20 <= end)
    udp = ip & first & (proto == UDP) & (inner + 8 <= end)
    offset = (f.u8(inner + 12) >> 4) * 4
    tcp &= offset >= 20
    tcp_len = np.maximum(inner_len - offset, 0)

    def addresses(name, nth):
        if name not in names:
            return None
        return pa.array(_ip_text(block, np.where(v4, at + 12, at + 8) + nth * address, address, ip), pa.string())

    address = np.where(v4, 4, 16)
    body = [None] * len(starts)
    if payload:
        ends = np.minimum(inner + offset + tcp_len, end)
        cuts = zip((inner + offset).tolist(), ends.tolist(), tcp.tolist())
        body = [block[a:b] if ok else None for a, b, ok in cuts]
    columns |= {
        "ip_version": column(np.where(v4, 4, 6), ip),
        "ip_src": addresses("ip_src", 0),
        "ip_dst": addresses("ip_dst", 1),
        "ip_header_len": column(ip_header, ip),
        "ip_payload_len": column(ip_payload, ip),
        "ip_total_len": column(ip_header + ip_payload, ip),
        "ip_proto": column(proto, ip),
        "l4": pa.array(np.where(tcp, "tcp", "udp"), pa.string(), mask=~(tcp | udp)),
        "src_port": column(f.u16(inner), tcp | udp),
        "dst_port": column(f.u16(inner + 2), tcp | udp),
        "tcp_seq": column(f.u32(inner + 4), tcp, pa.int64()),
        "tcp_payload_len": column(tcp_len, tcp),
        "payload": pa.array(body, pa.binary()),
    }
    return pa.RecordBatch.from_pydict({name: columns[name] for name in names})
