"""Retention as predicates: freshness by stream time, a thinned and weighted reference zone, segments, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Lens
from .lens import apply_lens

#: Events of one bucket when aged events are numbered; only bucket counts pass through one task.
BUCKET_EVENTS = 100_000


def validate(retention_ms: float, reference_ms: float | None = None, ratio: int | None = None) -> None:
    if not retention_ms > 0:
        raise ValueError("retention must be above 0")
    if (reference_ms is None) != (ratio is None):
        raise ValueError("reference width and ratio are set together")
    if ratio is not None and not (ratio == int(ratio) and ratio >= 2):
        raise ValueError("the ratio is a whole number of 2 or more")


def _last(events: DataFrame) -> DataFrame:
    return F.broadcast(events.agg(F.max("ts_ms").alias("_last")))  # one row


def fresh(events: DataFrame, retention_ms: int) -> DataFrame:
    """Events not older than ``retention_ms`` before the last one."""
    return events.crossJoin(_last(events)).where(F.col("ts_ms") >= F.col("_last") - retention_ms).drop("_last")


def thinned(events: DataFrame, retention_ms: int, reference_ms: int, ratio: int) -> DataFrame:
    """Every ``ratio``-th aged event in arrival order, standing for ``ratio`` events, within ``reference_ms``.

    Numbers come from counts per bucket of ``seq`` plus the rank inside the bucket, so no
    task ever orders all aged events. Events without ``seq`` come first, in order of time.
    """
    aged = events.crossJoin(_last(events)).where(F.col("ts_ms") < F.col("_last") - retention_ms).drop("_last")
    kept = numbered(aged).where(F.col("_i") % ratio == 0).drop("_i").withColumn("weight", F.lit(float(ratio)))
    return kept.crossJoin(_last(kept)).where(F.col("ts_ms") >= F.col("_last") - reference_ms).drop("_last")


def numbered(events: DataFrame, start: int = 0) -> DataFrame:
    """``events`` with _i, their number in order of ``seq`` after ``start``; those without ``seq`` come first, in order of time."""
    events = events.withColumn("_bucket", F.coalesce(F.floor(F.col("seq") / BUCKET_EVENTS), F.lit(-1)))
    counts = events.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for BUCKET_EVENTS events
    offsets = counts.select("_bucket", (before + start).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("seq", "ts_ms"))
    return events.join(offsets, "_bucket").withColumn("_i", F.col("_before") + place).drop("_bucket", "_before")


def zones(events: DataFrame, retention_ms: int, reference_ms: int | None = None, ratio: int | None = None) -> DataFrame:
    """What a buffer would hold: the fresh zone and, if configured, the thinned one before it."""
    validate(retention_ms, reference_ms, ratio)
    held = fresh(events, retention_ms)
    return held if ratio is None else held.unionByName(thinned(events, retention_ms, reference_ms, ratio))


def segment(events: DataFrame, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Events of a span, both ends included."""
    if from_ms is not None:
        events = events.where(F.col("ts_ms") >= from_ms)
    if to_ms is not None:
        events = events.where(F.col("ts_ms") <= to_ms)
    return events


def replay(events: DataFrame, lens: Lens | dict, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """A new lens over an old span."""
    return apply_lens(segment(events, from_ms, to_ms), lens)


def replay_with_reference(events: DataFrame, lens: Lens | dict, from_ms: int, to_ms: int) -> tuple[DataFrame, DataFrame]:
    """Windows of a span and of the equally long span before it; the shared end point counts in both."""
    return replay_spans(events, lens, (from_ms, to_ms), (from_ms - (to_ms - from_ms), from_ms))


def replay_spans(events: DataFrame, lens: Lens | dict, observed: tuple[int, int], reference: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Windows of two spans, ends included.

    On an epoch grid both come from one scan and one aggregation, and are kept: windows are
    few, and all comparisons read them again. A lost part is made again from the events.
    :func:`release` frees them when the results have been written.
    """
    lens = Lens.of(lens) if isinstance(lens, dict) else lens
    if lens.grid != "epoch" or lens.decay is not None:
        return replay(events, lens, *observed), replay(events, lens, *reference)
    events = segment(events, min(observed[0], reference[0]), max(observed[1], reference[1]))
    sides = F.array(*[F.when(F.col("ts_ms").between(*span), F.lit(i)) for i, span in enumerate((observed, reference))])
    both = apply_lens(events.withColumn("side", F.explode(F.array_compact(sides))), lens, by=("side",)).persist()
    return tuple(keeping(both.where(f"side = {i}").drop("side"), both) for i in (0, 1))


def keeping(frame: DataFrame, source: DataFrame) -> DataFrame:
    """``frame``, remembering which kept windows it is made of."""
    frame.kept_windows = getattr(source, "kept_windows", source)
    return frame


def release(frame: DataFrame) -> None:
    """Free the windows that a replay kept, when what is made of them has been written."""
    kept = getattr(frame, "kept_windows", None)
    if kept is not None:
        kept.unpersist()


def sizes(events: DataFrame, retention_ms: int, reference_ms: int | None = None, ratio: int | None = None) -> DataFrame:
    """One row: size of the fresh zone and of the thinned one behind it."""
    validate(retention_ms, reference_ms, ratio)
    held = fresh(events, retention_ms).agg(F.count("*").alias("size"))
    aged = held.select(F.lit(0).cast("long").alias("reference_size")) if ratio is None else thinned(events, retention_ms, reference_ms, ratio).agg(F.count("*").alias("reference_size"))
    return held.crossJoin(aged)  # one row each


def live_spans(now_ms: int, window_ms: int, count: int = 3, origin: int = 0) -> tuple[tuple[int, int], tuple[int, int]]:
    """Inclusive spans of the last ``count`` whole windows and of as many before them."""
    end = origin + (now_ms - origin) // window_ms * window_ms
    span = window_ms * count
    return (end - span, end - 1), (end - 2 * span, end - span - 1)


def live_lookback_ms(window_ms: int, count: int = 3) -> int:
    return 2 * window_ms * count


def most_window_ms(retention_ms: int, count: int = 3) -> int:
    """Widest window whose live spans fit the retention."""
    return retention_ms // (2 * count)
