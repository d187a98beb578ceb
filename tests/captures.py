"""Capture files written byte by byte for the tests."""

import socket
import struct

MAGICS = {("<", 6): 0xA1B2C3D4, (">", 6): 0xA1B2C3D4, ("<", 9): 0xA1B23C4D, (">", 9): 0xA1B23C4D}


def capture(records, order="<", digits=6, link=1, snap=65535):
    """``records`` are ``(seconds, fraction, bytes)`` or ``(seconds, fraction, bytes, wire length)``."""
    out = struct.pack(order + "IHHiIII", MAGICS[order, digits], 2, 4, 0, 0, snap, link)
    for sec, fraction, data, *wire in records:
        kept = data[:snap]
        out += struct.pack(order + "IIII", sec, fraction, len(kept), wire[0] if wire else len(data)) + kept
    return out


def ethernet(inner, kind=0x0800, tags=(), pad=0):
    out = b"\x02" * 12
    for tag in tags:
        out += struct.pack(">HH", tag, 7)
    return out + struct.pack(">H", kind) + inner + b"\0" * pad


def cooked(inner, kind=0x0800):
    return struct.pack(">HHH8sH", 0, 1, 6, b"\x02" * 8, kind) + inner


def ipv4(inner, proto, src="10.0.0.1", dst="10.0.0.2", fragment=0, options=b""):
    header = 20 + len(options)
    return (
        struct.pack(">BBHHHBBH", 0x40 | header // 4, 0, header + len(inner), 1, fragment, 64, proto, 0)
        + socket.inet_aton(src) + socket.inet_aton(dst) + options + inner
    )


def ipv6(inner, proto, src="fd00::1", dst="fd00::2"):
    addresses = socket.inet_pton(socket.AF_INET6, src) + socket.inet_pton(socket.AF_INET6, dst)
    return struct.pack(">IHBB", 6 << 28, len(inner), proto, 64) + addresses + inner


def tcp(payload=b"", src=1000, dst=443, seq=1, options=b""):
    return struct.pack(">HHIIBBHHH", src, dst, seq, 0, (20 + len(options)) // 4 << 4, 16, 0, 0, 0) + options + payload


def udp(payload=b"", src=1000, dst=67):
    return struct.pack(">HHHH", src, dst, 8 + len(payload), 0) + payload
