"""Running sums inside large groups, without a task that holds a whole group."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running_before(
    rows: DataFrame, by: list[str], run: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows that come before it in its group.

    A group (the columns ``by``, which hold no null) is ordered by ``run``, a non-null integer that splits it into runs
    of a size one task can sort, and then by ``order``. Runs are summed first and their sums added up: a group meets in
    one task only as one row for each of its runs. With a value of 1 the result numbers a group gaplessly from 0.
    ``name`` must not be a column of ``rows``; neither may ``__run``, ``__value``, ``__sum`` or ``__first``.
    """
    keys = [*by, "__run"]
    cut = rows.withColumn("__run", run).withColumn("__value", value)
    listed = ", ".join(by)
    before = F.expr(
        f"sum(__sum) over (partition by {listed} order by __run rows between unbounded preceding and 1 preceding)"
    )
    sums = cut.groupBy(*keys).agg(F.sum("__value").alias("__sum"))
    firsts = sums.select(*keys, F.coalesce(before, F.lit(0)).alias("__first"))
    placed = cut.repartition(*keys).withColumn("__order", F.struct(*order))
    inside = F.expr(
        f"sum(__value) over (partition by {listed}, __run order by __order rows between unbounded preceding and current row)"
    )
    return (
        placed.withColumn(name, inside - F.col("__value"))
        .join(firsts, keys)
        .withColumn(name, (F.col(name) + F.col("__first")).cast("bigint"))
        .drop("__run", "__value", "__order", "__first")
    )


def numbered_runs(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` dealt out by ranges of ``order``, with the number of its range in ``name``: a ``run`` for rows of one group.

    The numbers rise with the order. They depend on how Spark dealt the rows, so the result has to be written down
    before it is used twice.
    """
    return rows.repartitionByRange(*order).withColumn(name, F.spark_partition_id().cast("bigint"))


def runs_for(rows: int) -> int:
    """Into how many runs a table is cut: as many as a run of one group then has rows at most."""
    return max(1, math.isqrt(rows))
