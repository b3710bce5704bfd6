"""Exact quantiles per group for groups of any size.

``percentile`` and ``median`` gather all distinct values of a group in one task,
so a group with a third of all rows would not fit. Here the rows are counted into
logarithmic bins first, PER_E_FOLD of them for each factor e, which partial sums reduce to
counters per group and task. The bins a wanted rank falls into are found from the counters,
and only the distinct values in those bins are shuffled and ordered. What a task sees of one
group at the end is limited by the width of a bin, 1/4096 of the value, however many rows the
group has. A bin can hold many rows only if they are that close; equal ones are counted before
the shuffle, and a bin of more than MANY rows is cut twice more into PARTS equal parts between its
least and greatest value. A bin spans at most 2^41 doubles, so what is left spans some hundred,
whatever the distribution.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersieve.sources.kept import kept

PER_E_FOLD = 4096
#: Rows of a bin from which on it is cut into parts, and their number.
MANY = 100_000
PARTS = 65_536
RUNNING = (Window.unboundedPreceding, Window.currentRow)


def _bin() -> Column:
    """Order-preserving: a greater ``value`` never falls into a lower bin."""
    # exp(-800) is below the smallest double, so shifted bins of positive values are
    # positive; infinities have the outermost bins
    shift, last = 800 * PER_E_FOLD, 1600 * PER_E_FOLD
    return F.expr(f"""
        CAST(CASE WHEN abs(value) = DOUBLE('Infinity') THEN sign(value) * {last}
                  WHEN value > 0 THEN floor(ln(value) * {PER_E_FOLD}) + {shift}
                  WHEN value < 0 THEN -(floor(ln(-value) * {PER_E_FOLD}) + {shift})
                  ELSE 0 END AS BIGINT)""")


def _cut(inside: DataFrame, keys: Sequence[str], wanted: str, size: str) -> DataFrame:
    """Distinct values of bins, reduced to those parts of the bins that hold a wanted rank.

    A part counts as a bin of its own afterwards.
    """
    place = f"CASE WHEN hi > lo THEN floor((value - lo) / (hi - lo) * {PARTS}) ELSE 0 END"
    named = inside.withColumn("part", F.expr(f"bin * {PARTS + 1} + {place}"))
    in_bin = Window.partitionBy(*keys, "bin").orderBy("part").rowsBetween(*RUNNING)
    parts = (
        named.groupBy(*keys, "bin", "part").agg(
            F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
            F.max("bin_below").alias("bin_below"), F.max(size).alias(size))
        .withColumn("up_to", F.col("bin_below") + F.sum("n").over(in_bin))
        .withColumn("below", F.col("up_to") - F.col("n"))
        .filter(wanted)
        .select(*keys, "part", "lo", "hi", F.col("below").alias("bin_below"))
    )
    return named.select(*keys, "part", "value", "n", size).join(parts, [*keys, "part"]).select(
        *keys, F.col("part").alias("bin"), "value", "n", "bin_below", size, "lo", "hi")


def grouped_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: Column,
    shares: Mapping[str, float],
    size: str = "group_rows",
) -> DataFrame:
    """One row per group: a column per wanted share, linearly interpolated, and the row count.

    Rows without a value (not-a-number is none) do not count. ``rows`` is read once for the
    counters and once for the values, each time only in the columns needed. The wanted bins,
    a few rows per group, are written in between: the planner then knows their size and,
    where it is small, leaves ``rows`` unshuffled.
    """
    keys = list(keys)
    values = rows.select(*keys, value.cast("double").alias("value")).filter(
        "value IS NOT NULL AND NOT isnan(value)").withColumn("bin", _bin())

    def covers(share: float, side: str) -> str:
        rank = f"{side}({share}D * ({size} - 1))"
        return f"({rank} >= below AND {rank} < up_to)"

    wanted = " OR ".join(
        covers(share, side) for share in set(shares.values()) for side in ("floor", "ceil"))

    counted = values.groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    within = Window.partitionBy(*keys).orderBy("bin").rowsBetween(*RUNNING)
    bins = kept(
        counted.withColumn("up_to", F.sum("n").over(within))
        .withColumn(size, F.sum("n").over(Window.partitionBy(*keys)))
        .withColumn("below", F.col("up_to") - F.col("n"))
        .filter(wanted)
        .select(*keys, "bin", F.col("below").alias("bin_below"), size, "lo", "hi",
                (F.col("n") > MANY).alias("many")),
        "bins",
    )
    def values_in(bins: DataFrame) -> DataFrame:
        return values.join(bins, [*keys, "bin"]).groupBy(*keys, "bin", "value").agg(
            F.count("*").alias("n"),
            *(F.max(name).alias(name) for name in ("bin_below", size, "lo", "hi")))

    # Cutting bins changes no result; plans without it are half as long, so it is left out
    # where no bin needs it.
    if bins.filter("many").isEmpty():
        inside = values_in(bins)
    else:
        many = values_in(bins.filter("many"))
        for _ in range(2):
            many = _cut(many, keys, wanted, size)
        inside = values_in(bins.filter("NOT many")).unionByName(many)

    in_bin = Window.partitionBy(*keys, "bin").orderBy("value").rowsBetween(*RUNNING)
    ranked = (
        inside
        .withColumn("up_to", F.col("bin_below") + F.sum("n").over(in_bin))
        .withColumn("below", F.col("up_to") - F.col("n"))
    )
    picks = [
        F.expr(f"max(CASE WHEN {covers(share, side)} THEN value END) AS {name}_{side}")
        for name, share in shares.items() for side in ("floor", "ceil")
    ]
    picked = ranked.groupBy(*keys).agg(F.max(size).alias(size), *picks)
    return picked.select(
        *keys, size, *(F.expr(_between(name, share, size)) for name, share in shares.items()))


def _between(name: str, share: float, size: str) -> str:
    low, high = f"{name}_floor", f"{name}_ceil"
    if share == 0.5:
        return f"({low} + {high}) / 2 AS {name}"
    part = f"({share}D * ({size} - 1) - floor({share}D * ({size} - 1)))"
    return f"""CASE WHEN {part} < 0.5 THEN {low} + ({high} - {low}) * {part}
                    ELSE {high} - ({high} - {low}) * (1 - {part}) END AS {name}"""
