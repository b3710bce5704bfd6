"""Consecutive numbers in sort order, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgersieve.sources.kept import kept


def consecutive_numbers(rows: DataFrame, order: str, number: str) -> DataFrame:
    """Number distinct texts in column ``order`` 1, 2, 3 ... in text order.

    The rows are cut into as many ranges of the order as there are shuffle partitions and
    written, each with the number of its range; a text's number is what lies in the ranges
    before its own, of which there is one row each, plus its place within.
    """
    cut = kept(
        rows.repartitionByRange(order).withColumn("range_no", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("range_no").agg(F.count("*").alias("in_range"))
    before = sizes.select(
        "range_no",
        (F.sum("in_range").over(Window.orderBy("range_no")) - F.col("in_range")).alias("before"))
    within = F.row_number().over(Window.partitionBy("range_no").orderBy(order))
    return (
        cut.withColumn("within", within)
        .join(before, "range_no")
        .withColumn(number, (F.col("before") + F.col("within")).cast("long"))
        .select(*rows.columns, number)
    )
