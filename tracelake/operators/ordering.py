"""How far a flow reaches, and the order of its messages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scan import CHUNK_ROWS, chunk_of


def in_scope(
    messages: DataFrame, scope: str = "trace", chunk_rows: int = CHUNK_ROWS, number_step: int = 1
) -> DataFrame:
    """Add ``scope`` (what a flow may not cross), ``pos`` (message order in it) and ``chunk``.

    ``scope="trace"`` keeps flows inside one capture; ``"global"`` lets them run on through the
    captures in file-name order. ``number_step`` is the usual distance of two ``msg_no``; a chunk spans
    ``chunk_rows`` such steps.
    """
    chunk = chunk_of("msg_no", chunk_rows * number_step)
    if scope == "trace":
        return messages.withColumns({"scope": F.col("trace_file"), "pos": F.col("msg_no"), "chunk": chunk})
    if scope == "global":
        return messages.withColumns(
            {
                "scope": F.lit(""),
                "pos": F.struct("trace_file", "msg_no"),
                "chunk": F.struct("trace_file", chunk.alias("piece")),
            }
        )
    raise ValueError(f"scope must be 'trace' or 'global', not {scope!r}")
