"""Peer-to-peer messages: the published TCP framing and binary message format, and message kinds.

Splitting a message into elements is a small per-message helper. Everything that looks inside the
elements is built-in column expressions.
"""

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.sources.reassembly import FLOW

# Fixed values of the TCP framing: a package is headers (length, name, length, value), an empty name,
# and as many bytes as the length header says.
FIRST_HEADERS = (b"content-type", b"content-length", b"srcEA")
LENGTH_HEADER = b"content-length"

# Fixed values of the binary message format.
MESSAGE_MARK, ELEMENT_MARK = b"jxmg", b"jxel"
BUILT_IN_NAMESPACES = ("", "jxta")
HAS_TYPE, HAS_ENCODING, HAS_SIGNATURE = 1, 2, 4


@dataclass(frozen=True)
class ElementNames:
    """Which elements carry the socket protocol. Namespace and tags of the socket are fixed values."""

    block_namespace: str = "jxta"
    block_type: str = "application/x-jxta-msg-reliable-block"
    ack_name: str = "jxta-reliable-ack"
    socket_namespace: str = "JXTASOC"
    close_tag: str = "close"
    request_tag: str = "reqPipe"
    response_tag: str = "remPipe"
    router_name: str = "EndpointRouterMsg"


def package_length(start: bytes) -> int | None:
    """``Measure`` of the TCP framing; a greeting line or any other text is no message."""
    if start and not any(bytes([len(n)]) + n[: len(start) - 1] == start[: len(n) + 1] for n in FIRST_HEADERS):
        return 0
    at, length = 0, None
    while at < len(start):
        size = start[at]
        at += 1
        if size == 0:
            if length is None:
                return 0
            return at + length
        name, at = start[at : at + size], at + size
        if at + 2 > len(start):
            return None
        (size,) = struct.unpack_from(">H", start, at)
        value, at = start[at + 2 : at + 2 + size], at + 2 + size
        if name == LENGTH_HEADER and len(value) == size:
            length = int.from_bytes(value, "big")
    return None


def _text(message: bytes, at: int) -> tuple[str, int]:
    (size,) = struct.unpack_from(">H", message, at)
    end = at + 2 + size
    if end > len(message):
        raise ValueError("text beyond the message")
    return message[at + 2 : end].decode(), end


def message_elements(package: bytes) -> list[tuple[str, str, str | None, bytes]]:
    """``(namespace, name, type, content)`` of each element of a framed message."""
    at = package.index(MESSAGE_MARK)
    version, names = struct.unpack_from(">BH", package, at + 4)
    if version != 0:
        raise ValueError(f"message version {version} is not supported")
    at += 7
    namespaces = list(BUILT_IN_NAMESPACES)
    for _ in range(names):
        name, at = _text(package, at)
        namespaces.append(name)
    (count,) = struct.unpack_from(">H", package, at)
    at += 2
    elements, open_signatures = [], 0
    while len(elements) < count or open_signatures:
        if package[at : at + 4] != ELEMENT_MARK:
            raise ValueError("element mark is missing")
        namespace, flags = struct.unpack_from(">BB", package, at + 4)
        name, at = _text(package, at + 6)
        kind = None
        if flags & HAS_TYPE:
            kind, at = _text(package, at)
        if flags & HAS_ENCODING:
            _, at = _text(package, at)
        (size,) = struct.unpack_from(">I", package, at)
        content, at = package[at + 4 : at + 4 + size], at + 4 + size
        if at > len(package):
            raise ValueError("element beyond the message")
        if open_signatures:  # follows the element that it signs
            open_signatures -= 1
        else:
            elements.append((namespaces[namespace], name, kind, content))
        open_signatures += bool(flags & HAS_SIGNATURE)
    return elements


_PARSED = (
    "trace_file string, msg_no bigint, first_ms bigint, last_ms bigint, bytes bigint, "
    "elements array<struct<namespace:string,name:string,type:string,content:binary>>"
)
_ELEMENT = pa.struct([("namespace", pa.string()), ("name", pa.string()), ("type", pa.string()), ("content", pa.binary())])
_PARSED_COLUMNS = pa.schema(
    [
        ("trace_file", pa.string()),
        ("msg_no", pa.int64()),
        ("first_ms", pa.int64()),
        ("last_ms", pa.int64()),
        ("bytes", pa.int64()),
        ("elements", pa.list_(_ELEMENT)),
    ]
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _ELEMENT.names
    for batch in batches:
        parsed, packages = [], batch.column("message").to_pylist()
        for package in packages:
            try:
                parsed.append([dict(zip(names, e)) for e in message_elements(package)])
            except (ValueError, IndexError, struct.error):
                parsed.append(None)
        columns = [batch.column(n) for n in _PARSED_COLUMNS.names[:-2]]
        sizes = pa.array(map(len, packages), pa.int64())
        elements = pa.array(parsed, pa.list_(_ELEMENT))
        yield pa.RecordBatch.from_arrays([*columns, sizes, elements], schema=_PARSED_COLUMNS)


def parse_messages(messages: DataFrame) -> DataFrame:
    """Size and elements of each reassembled message; no elements for what follows the framing but not the format."""
    return messages.drop(*FLOW[1:]).mapInArrow(_parse, _PARSED)


NOT_PARSED, NO_NUMBER = "not parsed", "block without number"


def message_losses(parsed: DataFrame, names: ElementNames = ElementNames()) -> DataFrame:
    """trace_file, msg_no, why and bytes of what ``classify_messages`` leaves out: messages whose elements do not parse, and
    blocks whose name is no number of 0 or more (one row each). Messages of no kind of the protocol are no losses."""
    broken = parsed.where("elements is null").select("trace_file", "msg_no", F.lit(NOT_PARSED).alias("why"), "bytes")
    blocks = parsed.select("trace_file", "msg_no", F.explode(_blocks(names)).alias("block"))
    size = F.length("block.content").cast("bigint").alias("bytes")
    unnamed = blocks.where(F.coalesce(F.col("block.name").try_cast("int"), F.lit(-1)) < 0)
    return broken.unionByName(unnamed.select("trace_file", "msg_no", F.lit(NO_NUMBER).alias("why"), size))


def _blocks(names: ElementNames) -> Column:
    return F.filter("elements", lambda e: (e["namespace"] == names.block_namespace) & (e["type"] == names.block_type))


def int32_list(content: Column) -> Column:
    """F-9: a big-endian array of 32-bit numbers; left-over bytes are ignored."""
    number = F.call_function("div", F.length(content), F.lit(4)).cast("int")
    places = F.when(number > 0, F.sequence(F.lit(0), number - 1)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.conv(F.hex(F.substring(content, i * 4 + 1, F.lit(4))), 16, 10).cast("bigint")
    return F.transform(places, lambda i: F.when(word(i) >= 1 << 31, word(i) - (1 << 32)).otherwise(word(i)).cast("int"))


def _tag_text(content: Column, tag: str) -> Column:
    return F.regexp_extract(content.cast("string"), rf"<(?:\w+:)?{tag}\b[^>]*>\s*([^<\s]+)\s*</", 1)


def classify_messages(parsed: DataFrame, names: ElementNames = ElementNames()) -> DataFrame:
    """SRC-7: the ``messages`` rows; the first kind that matches wins, other messages are left out.

    ``pipe_id`` is the service parameter of the destination address, ``adv_pipe_id`` the identifier in
    the pipe advertisement of a request or response. Block names that are no number of 0 or more are
    left out.
    """

    def element(match) -> Column:
        return F.get(F.filter("elements", match), F.lit(0))["content"]

    def socket_element(tag: str) -> Column:
        return element(lambda e: (e["namespace"] == names.socket_namespace) & (e["name"] == tag))

    with_elements = parsed.withColumns(
        {
            "blocks": _blocks(names),
            "ack": element(lambda e: e["name"] == names.ack_name),
            "close": socket_element(names.close_tag),
            "req": socket_element(names.request_tag),
            "rem": socket_element(names.response_tag),
            "router": element(lambda e: e["name"] == names.router_name),
        }
    )
    kind = (
        F.when(F.size("blocks") > 0, "data")
        .when(F.col("ack").isNotNull(), "ack")
        .when(F.col("close").isNotNull(), "close")
        .when(F.col("req").isNotNull(), "req")
        .when(F.col("rem").isNotNull(), "rem")
    )
    advertisement = F.when(F.col("kind").isin("req", "rem"), F.coalesce("req", "rem"))
    nothing = F.array().cast("array<int>")
    numbers = F.filter(F.transform("blocks", lambda e: e["name"].try_cast("int")), lambda n: n >= 0)
    sizes = F.transform("blocks", lambda e: F.length(e["content"]).cast("bigint"))
    return (
        with_elements.withColumn("kind", kind)
        .where("kind is not null")
        .select(
            "trace_file",
            "msg_no",
            "kind",
            F.nullif(F.regexp_extract(_tag_text(F.col("router"), "Dest"), "^[^:]+://[^/]*/[^/]+/(.+)$", 1), F.lit("")).alias(
                "pipe_id"
            ),
            F.nullif(_tag_text(advertisement, "Id"), F.lit("")).alias("adv_pipe_id"),
            "first_ms",
            "last_ms",
            F.aggregate(F.coalesce(sizes, F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, b: a + b).alias(
                "payload_bytes"
            ),
            F.when(F.col("kind") == "data", numbers)
            .otherwise(nothing)
            .alias("seqs"),
            F.when(F.col("kind") == "ack", int32_list(F.col("ack"))).otherwise(nothing).alias("acks"),
        )
    )
