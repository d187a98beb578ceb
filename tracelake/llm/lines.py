"""Lines that many documents share: dropped everywhere but in one document.

Lines are exploded, normalised and hashed; documents are counted for each hash; what is found too often goes, and the
others are put together again by their positions. Everything is a DataFrame or a column expression.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.staging import staged

# The white space that is stripped, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Hashes with more than this part of all long lines meet their lines by a broadcast: there can be no more of them.
HOT_SHARE = 10_000


def line_key(line: Column) -> Column:
    """A line without the white space at both ends, A to Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def fingerprint(text: Column) -> Column:
    """16 bytes of the text's SHA-256: equal for equal texts only."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def long_lines(documents: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """One row (id, print, place, line) for each line whose key has ``min_chars`` code points; line: the key's hash.

    id and print, the hash of the text, name a row of the documents; rows that agree in both have the same lines.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    whole = documents.select(F.col(key).alias("id"), fingerprint(content).alias("print"), F.split(content, "\n").alias("lines"))
    lines = whole.select("id", "print", F.posexplode("lines").alias("place", "line"))
    long = lines.where(F.char_length(F.btrim("line", F.lit(BLANKS))) >= min_chars)
    return long.select("id", "print", "place", fingerprint(line_key(F.col("line"))).alias("line"))


def shared_lines(lines: DataFrame, min_documents: int) -> DataFrame:
    """(line, largest, uses) of the hashes that at least ``min_documents`` different ids hold.

    largest: the largest id that holds it; uses: its lines. A hash with a third of all lines is counted by id first, so
    it meets in one task only as one row for each task before.
    """
    by_document = lines.groupBy("line", "id").agg(F.count(F.lit(1)).alias("uses"))
    by_line = by_document.groupBy("line").agg(
        F.count("id").alias("documents"), F.max("id").alias("largest"), F.sum("uses").alias("uses")
    )
    return by_line.where(F.col("documents") >= min_documents).drop("documents")


def dropped_places(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, print, dropped): the positions of the shared lines, but for those in the largest id that holds them.

    A hash with more than one in ``HOT_SHARE`` of all lines, of which there are ``HOT_SHARE`` at most, is broadcast; the
    lines of all other hashes meet theirs in a shuffle, where none is large.
    """
    hot = F.col("uses") > F.lit(lines.count() / HOT_SHARE)
    often, seldom = F.broadcast(shared.where(hot)), shared.where(~hot)
    found = lines.join(often, "line").unionByName(lines.join(often, "line", "left_anti").join(seldom, "line"))
    gone = found.where(~F.col("id").eqNullSafe(F.col("largest")))
    return gone.groupBy("id", "print").agg(F.collect_set("place").alias("dropped"))


def dedup_lines(
    documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_documents: int = 5
) -> DataFrame:
    """The documents without the lines that at least ``min_documents`` documents share, and n_lines, n_dropped.

    A line counts by its key (``line_key``). Keys shorter than ``min_chars`` code points always stay. Of the others, those
    found in ``min_documents`` documents lose all their lines, except in the largest document key that holds them, where
    every one stays. The lines that are left are joined by \\n in their order. n_lines counts before, n_dropped the dropped.

    - Null or empty text: one empty line, which stays; the text is then empty. A text that loses all its lines is empty.
    - Rows of the same document key are one document. A null key is no document: it is not counted, and loses what others
      share.
    - Texts are read whole, whatever their length: a document's lines are one row, never more.
    - All columns are returned; columns named n_lines or n_dropped are replaced. An empty table gives an empty result.
    """
    lines = staged(long_lines(documents, key, text, min_chars), "lines")
    shared = staged(shared_lines(lines, min_documents), "shared-lines")
    dropped = dropped_places(lines, shared)
    content = F.coalesce(F.col(text), F.lit(""))
    # Split before the join: the lines are then a column there, not an expression done anew for every line.
    whole = documents.select(
        F.struct(*[F.col(c) for c in documents.columns if c != text]).alias("row"),
        F.col(key).alias("id"),
        fingerprint(content).alias("print"),
        F.split(content, "\n").alias("lines"),
    )
    same = whole["id"].eqNullSafe(dropped["id"]) & (whole["print"] == dropped["print"])
    met = whole.join(dropped, same, "left").select("row", "lines", "dropped")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("dropped", F.expr("array()")))
    rest = F.array_join(F.transform(places, lambda i: F.get(F.col("lines"), i)), "\n")
    counts = {
        "n_lines": F.size("lines").cast("bigint"),
        "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint"),
    }
    columns = [
        rest.alias(text) if c == text else F.col("row")[c].alias(c) for c in documents.columns if c.lower() not in counts
    ]
    return met.select(*columns, *(value.alias(name) for name, value in counts.items()))
