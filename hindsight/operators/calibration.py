"""Measured error rates of the comparison: all trials in one plan, grouped by trial."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import sidak_z
from ..model import VALID_COUNT, Curation, Lens
from .curator import frame, with_neighbours
from .lens import apply_lens


def trial_windows(trials: DataFrame, window_ms: int = 1000) -> DataFrame:
    """Windows of every trial (group_label) and side (is_obs) for ``trials(trial_id, is_obs, ts_ms, value)``: events are read once; all after works on windows."""
    keys = F.create_map(F.lit("trial"), F.col("trial_id").cast("string"))
    events = trials.select("is_obs", "ts_ms", "value", keys.alias("keys"), F.lit(1.0).alias("weight"))
    return apply_lens(events, Lens(window_ms=window_ms, origin=0, group_by=("trial",)), by=("is_obs",)).where("group_label is not null").persist()


def judged_trials(trials: DataFrame, window_ms: int = 1000, config: Curation = Curation()) -> DataFrame:
    """trial_id, windows, hit, blind: whether a trial's package has any tile but the baseline.

    A trial is a group, so pools, scores, steps and gaps of all trials come from one frame; the
    family is the trial's own. Its spans share no window start, so none diverges.
    """
    windows = trial_windows(trials, window_ms)
    observed, reference = (windows.where(side).drop("is_obs") for side in ("is_obs", "not is_obs"))
    rows = with_neighbours(frame(observed, reference, config, grouped=True), window_ms, config)
    counted = F.col("count") >= VALID_COUNT
    per_trial = rows.groupBy("group_label").agg(
        F.count_if(counted).alias("windows"), F.max(F.when(F.col("scorable"), F.abs("gate_z"))).alias("most_z"), F.bool_and(F.when(counted, ~F.col("sound"))).alias("blind"),
        F.bool_or(F.col("gap_end").isNotNull() | F.col("run").isNotNull()).alias("other"),
    ).where("windows > 0")
    hit = F.coalesce(F.col("most_z") >= sidak_z(F.lit(config.spike_z), F.col("windows")), F.lit(False))
    return per_trial.select(F.col("group_label").cast("long").alias("trial_id"), "windows", (hit | F.col("other")).alias("hit"), "blind")


def alarm_rate(trials: DataFrame, window_ms: int = 1000, config: Curation = Curation()) -> DataFrame:
    """One row: trials, blind ones, and the share of the others with any tile but the baseline."""
    seen = F.when(~F.col("blind"), F.col("hit").cast("double"))
    judged = judged_trials(trials, window_ms, config)
    return judged.agg(F.count("*").alias("trials"), F.sum(F.col("blind").cast("long")).alias("blind"), F.round(F.avg(seen), 6).alias("rate"))


def false_positives(quiet: DataFrame, window_ms: int = 1000, config: Curation = Curation()) -> DataFrame:
    """trial_id of the quiet trials that raise an alarm."""
    return judged_trials(quiet, window_ms, config).where("hit and not blind").select("trial_id")
