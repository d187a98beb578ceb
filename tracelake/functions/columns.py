"""Scalar expressions: time buckets, service ports, tokens and text forms."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: word delimiters are space, tab, line feed, carriage return and form feed.
WORD_DELIMITERS = "[ \\t\\n\\r\\f]+"


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp; independent of the session zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.call_function("div", F.timestamp_diff("MICROSECOND", origin, ts), F.lit(1000).cast("bigint"))


def second_bucket(ms: Column) -> Column:
    """PRJ-7, F-5: the whole second that a millisecond time falls in."""
    return F.call_function("div", ms, F.lit(1000).cast("bigint"))


def packet_bytes() -> Column:
    """PRJ-5: bytes at IP level, link header left out."""
    return F.col("ip_header_len").cast("bigint") + F.col("ip_payload_len").cast("bigint")


def words(text: Column) -> Column:
    """F-1: whitespace tokens; the empty pieces at both ends are dropped."""
    return F.filter(F.split(text, WORD_DELIMITERS), lambda word: word != "")


def file_name(path: Column) -> Column:
    """F-2: last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def pair_text(first: Column, second: Column) -> Column:
    """F-4, PRJ-14: two numbers as ``"a b"``."""
    return F.concat_ws(" ", first.cast("string"), second.cast("string"))


def pair_values(text: Column) -> tuple[Column, Column]:
    """F-3, PRJ-14: the two numbers of ``pair_text``; malformed text gives nulls."""
    parts = F.split(text, " ")
    return parts.getItem(0).try_cast("bigint"), parts.getItem(1).try_cast("bigint")


def array_text(values: Column) -> Column:
    """F-11: ``(n)[a b ]``; an empty array gives ``(0)[]``."""
    body = F.array_join(F.transform(values, lambda v: F.concat(v.cast("string"), F.lit(" "))), "")
    return F.concat(F.lit("("), F.size(values).cast("string"), F.lit(")["), body, F.lit("]"))
