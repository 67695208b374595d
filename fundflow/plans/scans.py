"""Running totals over a global order, with hot keys cut into slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.plans.shared import discard, stored

#: Rows of a slice share the upper bits of their number.
_SLICE_BITS = 33


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, a number that ascends in this order, in the shared
    folder. Numbers of one range of the order share all but their last 33 bits."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(rows, "unnumbered")  # ranges are sampled, which would compute them twice
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "numbered")
    discard(rows)
    return out


def slice_of(at: str) -> Column:
    """The range of :func:`numbered` that a number lies in."""
    return F.call_function("shiftright", F.col(at), F.lit(_SLICE_BITS))


def running(events: DataFrame, key: str, value: str, also: str | None = None) -> DataFrame:
    """``events`` with the totals of what a key has had *before* each of them.

    ``before`` is the running sum of ``value``, ``low`` its least value so far
    (0 at most), and ``also_before`` the running sum of another column. Rows of
    a key are summed per slice of ``at`` first, and slices are added up after
    that, so one key's rows are spread over as many tasks as there are slices.
    """
    also = also or value
    sliced = events.withColumn("_slice", slice_of("at"))
    here = Window.partitionBy(key, "_slice").orderBy("at")
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn("_sum", F.sum(value).over(here)).withColumn("_low", F.min("_sum").over(earlier)).withColumn("_also", F.sum(also).over(here))
    slices = local.groupBy(key, "_slice").agg(F.sum(value).alias("_s"), F.min("_sum").alias("_l"), F.sum(also).alias("_a"))
    past = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    carried = slices.withColumn("_s0", F.coalesce(F.sum("_s").over(past), zero)).withColumn("_l0", F.min(F.col("_s0") + F.col("_l")).over(past)).withColumn("_a0", F.coalesce(F.sum("_a").over(past), zero))
    both = local.join(carried.select(key, "_slice", "_s0", "_l0", "_a0"), [key, "_slice"])
    return both.select(
        *events.columns,
        (F.col("_s0") + F.col("_sum") - F.col(value)).alias("before"),
        F.least(zero, F.coalesce("_l0", zero), F.coalesce(F.col("_s0") + F.col("_low"), zero)).alias("low"),
        (F.col("_a0") + F.col("_also") - F.col(also)).alias("also_before"),
    )
