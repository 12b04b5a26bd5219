"""The lens: events to windowed, mergeable sufficient statistics.

Input is ``ts_ms long, value double, keys map<string,string>, weight double``; a null
weight stands for one event, null times or values are dropped. Output has a row per
window: group_label (null in the mixed view), window_start, window_end (exclusive),
count, mean, sum_sq, sum_w, sum_w2, min_v, max_v, valid. Empty windows are not output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MISSING_KEY, VALID_COUNT, Lens, parse_decay

STATS = ("count", "mean", "sum_sq", "sum_w", "sum_w2", "min_v", "max_v", "valid")


def floor_to_window(ts: Column, window_ms: int, origin: Column) -> Column:
    """Start of the window that holds ``ts``; right for times before the origin too."""
    return ts - F.pmod(ts - origin, F.lit(window_ms))


def group_label(keys: Column, names: tuple[str, ...]) -> Column:
    """Key values joined by | in declared order; a missing key reads (none)."""
    return F.concat_ws("|", *[F.coalesce(F.element_at(keys, k), F.lit(MISSING_KEY)) for k in names])


def with_decay(events: DataFrame, lens: Lens, now_ms: int | None = None) -> DataFrame:
    """Drop or down-weight old events; the anchor is the segment's last event, or ``now_ms``."""
    if lens.decay is None:
        return events
    decay = parse_decay(lens.decay)
    if lens.decay_anchor == "now":
        if now_ms is None:
            raise ValueError("decay_anchor now needs now_ms")
        anchored = events.withColumn("_anchor", F.lit(now_ms))
    else:
        anchored = events.crossJoin(F.broadcast(events.agg(F.max("ts_ms").alias("_anchor"))))  # one row
    age = F.col("_anchor") - F.col("ts_ms")
    if decay.kind == "step":
        return anchored.where(age <= decay.ms).drop("_anchor")
    fade = F.exp(-F.greatest(age, F.lit(0)) / F.lit(decay.ms))
    return anchored.withColumn("weight", F.col("weight") * fade).drop("_anchor")


def _pool(df: DataFrame, keys: list[str], merged: bool) -> DataFrame:
    """Aggregate events, or windows if ``merged``, to sums per key."""
    if merged:
        sums = [F.sum("count").alias("count"), F.sum("sum_wv").alias("sum_wv")]
        sums += [F.sum(c).alias(c) for c in ("sum_sq", "sum_w", "sum_w2")]
        sums += [F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v")]
    else:
        w, v = F.col("weight"), F.col("value")
        sums = [F.count("*").alias("count"), F.sum(w * v).alias("sum_wv"), F.sum(w * v * v).alias("sum_sq"), F.sum(w).alias("sum_w"), F.sum(w * w).alias("sum_w2")]
        sums += [F.min(v).alias("min_v"), F.max(v).alias("max_v")]
    return df.groupBy(*keys).agg(*sums).where("sum_w > 0")


def apply_lens(events: DataFrame, lens: Lens | dict, now_ms: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Windows of a segment, mixed and, with ``group_by``, per group on the same grid.

    One aggregation over the events; the mixed view pools the groups' windows. Coarse
    windows come straight from the events, except under exponential decay, where fine
    windows without weight vanish first. Columns ``by`` part the events into segments with
    windows of their own (on an epoch grid, without decay from a segment's end).
    """
    lens = Lens.of(lens) if isinstance(lens, dict) else lens
    events = events.where("ts_ms is not null and value is not null").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    events = with_decay(events, lens, now_ms)
    if lens.grid == "epoch":
        origin = F.lit(int(lens.origin or 0))
    else:
        events = events.crossJoin(F.broadcast(events.agg(F.min("ts_ms").alias("_origin"))))  # one row
        origin = F.col("_origin")
    events = events.withColumn("group_label", group_label(F.col("keys"), lens.group_by) if lens.group_by else F.lit(None).cast("string"))
    two_steps = lens.downsample_factor > 1 and lens.decay is not None and parse_decay(lens.decay).kind == "exp"
    first_ms = lens.window_ms if two_steps else lens.output_ms
    if by and (lens.grid != "epoch" or lens.decay is not None and lens.decay_anchor != "now"):
        raise ValueError("segments side by side need an epoch grid and no decay from their ends")
    keys = [*by, "group_label", "window_start"]
    events = events.withColumn("window_start", floor_to_window(F.col("ts_ms"), first_ms, origin))
    if two_steps:
        events = events.withColumn("coarse", floor_to_window(F.col("ts_ms"), lens.output_ms, origin))
        fine = _pool(events, [*keys, "coarse"], False)
        windows = _pool(fine.drop("window_start").withColumnRenamed("coarse", "window_start"), keys, True)
    else:
        windows = _pool(events, keys, False)
    if lens.group_by:
        mixed = _pool(windows, [*by, "window_start"], True).withColumn("group_label", F.lit(None).cast("string"))
        windows = windows.unionByName(mixed)
    return windows.select(
        *by,
        "group_label",
        "window_start",
        (F.col("window_start") + lens.output_ms).alias("window_end"),
        "count",
        (F.col("sum_wv") / F.col("sum_w")).alias("mean"),
        "sum_sq", "sum_w", "sum_w2", "min_v", "max_v",
        (F.col("count") >= VALID_COUNT).alias("valid"),
    )
