"""Row order. Spark frames have none, so order-dependent steps use a key column.

``with_order`` adds an increasing id without a job (unique, not dense); it is the
order of files and of rows in them. ``ordinals`` numbers rows densely from 0, with
one small aggregate (rows of each partition) and no single-task window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.staging import staged

ORDER = "__row__"


def free_name(df: DataFrame, wanted: str) -> str:
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def with_order(df: DataFrame, order: str = ORDER) -> DataFrame:
    return df if order in df.columns else df.withColumn(order, F.monotonically_increasing_id())


def ordinals(df: DataFrame, name: str, order: str = ORDER) -> DataFrame:
    """``df`` with dense 0-based ``name`` after the order of ``order``.

    Ids of ``monotonically_increasing_id`` hold the partition in their upper 31
    bits, so the running total over partitions gives each one its offset. One row
    for each partition is what the driver's side of the join holds. Rows are counted
    and numbered in two passes, so ``df`` is staged: after a sort or a shuffle each
    pass would deal them, and their ids, anew."""
    df = staged(df)
    part = F.shiftright(F.col(order), 33)
    sizes = df.groupBy(part.alias("__part__")).agg(F.count("*").alias("__n__"), F.min(order).alias("__low__"))
    before = Window.orderBy("__part__").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part__", "__low__", F.coalesce(F.sum("__n__").over(before), F.lit(0)).alias("__start__"))
    within = Window.partitionBy("__part__").orderBy(order)
    numbered = df.withColumn("__part__", part).join(starts, "__part__")
    return numbered.withColumn(name, (F.row_number().over(within) - 1 + F.col("__start__")).cast("long")).select(*df.columns, name)
