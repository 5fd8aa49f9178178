"""Global ranks and running sums of ordered rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import store_table, task_count

ROWS_PER_BLOCK = 200_000
GROUP = 512


def with_offsets(rows: DataFrame, order: list[Column | str], weight: Column, name: str = "offset") -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over all rows that come before in ``order``; null weights count 0.

    Rows are range-partitioned into blocks of about ``ROWS_PER_BLOCK`` and stored, so that a block keeps its rows
    under retries. One window adds up inside each block, one over the blocks of a group and one over the groups, of
    which there is one for every hundred million rows. Rows that ``order`` leaves equal get an order of their
    own, so they too are dealt over several blocks. ``rows`` should be narrow.
    """
    id_, block, group, own, inside, over = (f"_offsets_{c}" for c in ("id", "block", "group", "own", "inside", "over"))
    stored = store_table(rows.withColumn(own, F.coalesce(weight, F.lit(0)).cast("long")).withColumn(id_, F.monotonically_increasing_id()))
    blocks = task_count(rows.sparkSession, stored.count(), ROWS_PER_BLOCK)
    by = [*order, id_]
    dealt = store_table(stored.repartitionByRange(blocks, *by).withColumn(block, F.spark_partition_id()))

    def before(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sums = dealt.groupBy(block).agg(F.sum(own).alias(own)).withColumn(group, F.expr(f"{block} div {GROUP}"))
    groups = sums.groupBy(group).agg(F.sum(own).alias(own)).select(group, before(own, Window.orderBy(group)).alias(over))
    starts = sums.withColumn(inside, before(own, Window.partitionBy(group).orderBy(block))).join(groups, group)
    starts = starts.select(block, (F.col(inside) + F.col(over)).alias(over))
    within = dealt.withColumn(inside, before(own, Window.partitionBy(block).orderBy(*by)))
    return within.join(starts, block).withColumn(name, F.col(over) + F.col(inside)).drop(id_, block, own, inside, over)


def with_rank(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Adds ``name``: 1 for the first row in ``order``, 2 for the next, through all rows."""
    return with_offsets(rows, order, F.lit(1), name).withColumn(name, F.col(name) + 1)
