"""Quantile sketches beside a lens's windows: mergeable, so coarser windows and groups are made of finer ones.

A sketch is one binary column of bounded size. It serves looks at a window's spread; references
are pooled from sums only and never from sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Lens
from .lens import floor_to_window, group_label

#: Size of a sketch: ranks are off by about 1.65 / K of the window's events; up to K events a sketch holds them all.
K = 400


def window_sketches(events: DataFrame, lens: Lens, k: int = K) -> DataFrame:
    """group_label, window_start, count, sketch on the lens's grid, per group of a grouping lens.

    Null times and values are left out, and values that are not numbers. Weights are no ranks:
    a lens with decay is refused, an event counts once whatever its weight.
    """
    if lens.grid != "epoch" or lens.decay is not None:
        raise ValueError("sketches need an epoch grid and no decay")
    sound = events.where("ts_ms is not null and value is not null and not isnan(value)")
    start = floor_to_window(F.col("ts_ms"), lens.output_ms, F.lit(int(lens.origin or 0))).alias("window_start")
    label = (group_label(F.col("keys"), lens.group_by) if lens.group_by else F.lit(None).cast("string")).alias("group_label")
    return sound.groupBy(label, start).agg(F.count("*").alias("count"), F.kll_sketch_agg_double(F.col("value").cast("double"), k).alias("sketch"))


def merged(sketches: DataFrame, *by: str, k: int = K) -> DataFrame:
    """One sketch per ``by`` of the sketches of its parts."""
    return sketches.groupBy(*by).agg(F.sum("count").alias("count"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """``sketches`` with a column q<rank in %> for each rank: the least value that so large a share of the events is not above."""
    named = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(r))).alias(f"q{round(r * 100)}") for r in ranks]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *named)
