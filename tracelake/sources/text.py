"""Lines of text."""

from pyspark.sql import DataFrame, SparkSession


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: the lines of a text file or folder, in a column ``value``."""
    return spark.read.text(path)
