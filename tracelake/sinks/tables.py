"""Text and folder-per-key outputs. Every writer refuses a path that already exists (SNK-6), unless told to replace folders.

Values are written as they are, without quotes or escapes, so a value must not hold the separator (but for the last one) or
a line break. A null is written as ``NULL``'s marker.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "\\N"
EMPTY_FOLDER = "__EMPTY__"
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"  # fixed value: what Spark names the folder of nulls


def _line(columns: list[str], sep: str) -> Column:
    return F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL)) for c in columns]).alias("value")


def _fields(fields: list[T.StructField], sep: str) -> list[Column]:
    """The columns of a line; the last one takes what is left of it."""
    parts = F.split(F.col("value"), f"\\Q{sep}\\E", len(fields))
    texts = [F.get(parts, F.lit(i)) for i in range(len(fields))]
    return [F.when(t != NULL, t).cast(f.dataType).alias(f.name) for t, f in zip(texts, fields, strict=True)]


def write_tab(df: DataFrame, path: str) -> None:
    """SNK-1: tab-separated text."""
    df.select(_line(df.columns, "\t")).write.mode("errorifexists").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """SNK-2: all columns as text, separated by a space."""
    df.select(_line(df.columns, " ")).write.mode("errorifexists").text(path)


def read_lines_as(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Read what ``write_tab`` (or, with a space, ``write_report``) wrote."""
    return spark.read.text(path).select(*_fields(_parsed(schema), sep))


def _parsed(schema: str) -> list[T.StructField]:
    return T.StructType.fromDDL(schema).fields


def write_by_key(
    df: DataFrame, path: str, key: Column, name: str = "folder", sep: str = " ", replace: bool = False
) -> None:
    """SNK-3, SNK-4, SNK-5: one folder per value of ``key``, any column expression.

    With the name of an existing column, that column moves from the lines to the folder name. Rows are gathered by key, so
    that a small key is one file, and a key with many rows is split again: folders get files by their size, not by the
    number of tasks. Null and the empty text have folders of their own.

    With ``replace``, the path may exist: the folders of the keys in ``df`` are replaced as a whole, and all others stay.
    Files are made in a staging folder and only committed tasks' files are moved to their place when the job commits, so
    neither a failed job nor a lost executor leaves a half folder or takes a former one away. ``df`` must not read ``path``.
    """
    keyed = df.withColumn(name, key)
    if dict(keyed.dtypes)[name] == "string":
        keyed = keyed.withColumn(name, F.when(F.col(name) == "", EMPTY_FOLDER).otherwise(F.col(name)))
    line = _line([c for c in df.columns if c != name], sep)
    gathered = keyed.select(line, name).hint("rebalance", name)
    writer = gathered.write.mode("overwrite" if replace else "errorifexists")
    writer.option("partitionOverwriteMode", "dynamic" if replace else "static").partitionBy(name).text(path)


def write_series(df: DataFrame, path: str, key: str, order: list[str], sep: str = " ") -> None:
    """SO-3, SNK-5: one folder per value of the text column ``key``, whose files in the order of their names hold the lines
    sorted by ``order`` (and, where that ties, by the line).

    Rows are dealt out by ranges of key and order, so a large series is many files and many small series share a task. What
    ``write_by_key`` says on lines and nulls holds here, too.
    """
    line = _line([c for c in df.columns if c != key], sep)
    # A key that cannot be null, else Spark sorts once more by the key alone when it writes.
    named = F.when(F.col(key) == "", EMPTY_FOLDER).otherwise(F.coalesce(key, F.lit(NULL_FOLDER)))
    keyed = df.select(F.coalesce(named, F.lit(NULL_FOLDER)).alias(key), *[F.col(c).alias(f"__{c}") for c in order], line)
    places = [key, *[f"__{c}" for c in order], "value"]
    dealt = keyed.repartitionByRange(*places).sortWithinPartitions(*places)
    dealt.select("value", key).write.mode("errorifexists").partitionBy(key).text(path)


def read_by_key(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    """Read what ``write_by_key`` wrote; ``schema`` names the line columns, then the folder column."""
    *fields, folder = _parsed(schema)
    lines = spark.read.schema(T.StructType([T.StructField("value", T.StringType()), folder])).text(path)
    found = F.col(folder.name)
    if isinstance(folder.dataType, T.StringType):
        found = F.when(found == EMPTY_FOLDER, "").otherwise(found).alias(folder.name)
    return lines.select(*_fields(fields, sep), found)
