"""Global row numbers without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.operators.clustering import cut


def with_rank(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``rows`` numbered from 0 in the given order, which must be total: rows are dealt to tasks by ranges and sorted and numbered there, before they
    are written (a row's id is its task's number, then its place), and the sizes of the ranges before are added (a row a task is summed)."""
    keyed = rows.withColumns({f"cf_k{k}": c for k, c in enumerate(order)})
    keys = [c for c in keyed.columns if c.startswith("cf_k")]
    dealt = cut(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("cf_id", F.monotonically_increasing_id()).drop(*keys))
    part, inside = F.shiftright("cf_id", 33), F.col("cf_id").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("cf_part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("cf_part", (F.sum("n").over(Window.orderBy("cf_part")) - F.col("n")).alias("cf_before"))
    return dealt.withColumn("cf_part", part).join(F.broadcast(before), "cf_part").withColumn(name, (inside + F.col("cf_before")).cast("long")).drop("cf_part", "cf_before", "cf_id")
