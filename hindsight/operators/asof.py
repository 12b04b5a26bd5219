"""As-of join: each row with what was in force at its time.

Time is cut into blocks. What a block starts with is the last of the earlier blocks' last
rows, found over one row per key and block; inside a block, both sides stream past a window in
order of time. So a key with all rows is spread over its blocks, no range join is made, and
nothing but one row per key and block is ordered beyond a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_MS = 86_400_000


def as_of(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, values: tuple[str, ...], by: tuple[str, ...] = (), order: str | None = None, block_ms: int = BLOCK_MS) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` at or before its time, by equal ``by``; nulls if there is none.

    Of rows of equal time the one with the largest ``order`` counts, then that of the largest
    values. Rows of ``right`` without a time are in force nowhere; rows of ``left`` without one
    stay, with nulls. Null keys equal each other. ``values`` must not name columns of ``left``.
    """
    taken = set(values) & set(left.columns)
    if taken:
        raise ValueError(f"both sides have {', '.join(sorted(taken))}")
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    at = lambda ts: [F.col(ts).cast("long").alias("_at"), F.floor(F.col(ts) / block_ms).alias("_block")]
    kept = F.struct(*[F.col(v) for v in values])
    last = F.col(order) if order else F.lit(0)
    writes = right.where(F.col(right_ts).isNotNull()).select(*keys, *at(right_ts), last.alias("_order"), kept.alias("_in_force"))
    rows = left.select(*keys, *at(left_ts), F.struct(*left.columns).alias("_row"))
    newest = F.max(F.struct("_at", "_order", "_in_force"))
    ends = writes.groupBy(*names, "_block").agg(newest.alias("_end"))
    starts = rows.groupBy(*names, "_block").agg(F.lit(1).alias("_wanted"))
    marks = ends.select(*names, "_block", "_end", F.lit(None).cast("int").alias("_wanted")).unionByName(starts.withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)))
    marks = marks.groupBy(*names, "_block").agg(F.max("_end").alias("_end"), F.max("_wanted").alias("_wanted"))
    earlier = Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier)).where("_wanted = 1 and _carry is not null")
    # what a block starts with is a write just before it
    carried = carried.select(*names, (F.col("_block") * block_ms - 1).alias("_at"), "_block", F.lit(None).cast(writes.schema["_order"].dataType).alias("_order"), F.col("_carry._in_force").alias("_in_force"))
    none = F.lit(None)
    both = writes.unionByName(carried).withColumns({"_kind": F.lit(0), "_row": none.cast(rows.schema["_row"].dataType)})
    both = both.unionByName(rows.withColumns({"_kind": F.lit(1), "_order": none.cast(writes.schema["_order"].dataType), "_in_force": none.cast(writes.schema["_in_force"].dataType)}))
    stream = Window.partitionBy(*names, "_block").orderBy("_at", "_kind", "_order", "_in_force")
    found = both.withColumn("_found", F.last("_in_force", ignorenulls=True).over(stream)).where("_kind = 1")
    found = found.withColumn("_found", F.when(F.col("_at").isNotNull(), F.col("_found")))
    return found.select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])
