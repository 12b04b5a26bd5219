"""The curator: compare observed windows with reference windows, return tiles and a package header.

A unit is the mixed view or, under a grouping lens, one group paired with the reference
group of the same label. Groups without a usable reference are reported as unscored,
never compared with the mixed pool. All inputs are windows as ``apply_lens`` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import kish_n, pooled_variance, sidak_z
from ..model import VALID_COUNT, Curation

MIXED = ""
SHAPES = ("spike", "dip", "step_up", "step_down", "divergence", "gap", "baseline")
_RANK = {"spike": 0, "dip": 0, "step_up": 1, "step_down": 1, "divergence": 2, "gap": 3, "baseline": 4}
TILE = ("shape_tag", "group_label", "region_start", "region_end", "magnitude")


def _pooled(where: Column | None = None) -> list[Column]:
    """Sums of windows as a reference: those that meet ``where``."""
    of = lambda c: c if where is None else F.when(where, c)
    w, w2 = F.sum(of(F.col("sum_w"))), F.sum(of(F.col("sum_w2")))
    return [
        w.alias("ref_w"), w2.alias("ref_w2"), (F.sum(of(F.col("mean") * F.col("sum_w"))) / w).alias("ref_mean"),
        F.sum(of(F.col("sum_sq"))).alias("ref_sq"), F.sum(of(F.col("count"))).alias("ref_count"), F.count(of(F.lit(1))).alias("ref_windows"),
    ]


def _with_variance(pooled: DataFrame) -> DataFrame:
    return pooled.withColumn("ref_n", kish_n(F.col("ref_w"), F.col("ref_w2"))).withColumn(
        "ref_var", pooled_variance(F.col("ref_w"), F.col("ref_w2"), F.col("ref_mean"), F.col("ref_sq"))
    )


def pool_stats(windows: DataFrame) -> DataFrame:
    """One row per unit: ref_w, ref_w2, ref_n, ref_mean, ref_var, ref_count, ref_windows."""
    return _with_variance(_units(windows).groupBy("unit").agg(*_pooled()))


def usable(n: Column, var: Column) -> Column:
    """A reference of three effective events or more that varies at all."""
    return F.coalesce((n >= 3) & (var > 0), F.lit(False))


def _units(windows: DataFrame) -> DataFrame:
    """Windows with their unit; under a grouping lens only the groups are units."""
    return windows.withColumn("unit", F.coalesce("group_label", F.lit(MIXED)))


def unscored_groups(observed: DataFrame, reference: DataFrame) -> DataFrame:
    """group_label of the observed groups that cannot be compared."""
    groups = observed.where("group_label is not null").select("group_label").distinct()
    pools = pool_stats(reference).where(usable(F.col("ref_n"), F.col("ref_var"))).select(F.col("unit").alias("group_label"))
    return groups.join(pools, "group_label", "left_anti")


def _lattice() -> list[Column]:
    """Moments and range of a unit's windows, for :func:`_lattice_step`."""
    w = F.sum("sum_w")
    return [(F.sum("sum_sq") / w).alias("_sq"), (F.sum(F.col("mean") * F.col("sum_w")) / w).alias("_m"), F.min("min_v").alias("_lo"), F.max("max_v").alias("_hi")]


def _lattice_step() -> Column:
    """The distance of the two values of a unit that has only two, else null."""
    lo, hi = F.col("_lo"), F.col("_hi")
    predicted = lo * lo + (hi * hi - lo * lo) * (F.col("_m") - lo) / F.nullif(hi - lo, F.lit(0.0))
    two_valued = F.abs(F.col("_sq") - predicted) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(predicted))
    return F.when(two_valued, hi - lo)


def gate_z(mean: Column, n_eff: Column, se: Column, step: Column, ref_mean: Column) -> Column:
    """Deviation in standard errors, shrunk by half a lattice step if the unit has one."""
    deviation = mean - ref_mean
    half = F.when(step.isNotNull(), 0.5 * step / n_eff).otherwise(0.0)
    return F.signum(deviation) * F.greatest(F.abs(deviation) - half, F.lit(0.0)) / F.nullif(se, F.lit(0.0))


def frame(observed: DataFrame, reference: DataFrame, config: Curation = Curation(), grouped: bool = False) -> DataFrame:
    """The observed windows with all that shapes are told from; every detector reads this one frame.

    One aggregation by unit gives pool and lattice of both sides; one exchange by unit, sorted by
    time, serves the join with it and what windows know of their neighbours. Columns: the
    window's own, unit, ref_*, step, n_eff, se, raw_z, gate_z, judged (its unit is compared),
    sound (it has a usable reference), scorable, other (the reference's mean at the same time).
    The mixed view is there too if the units are groups, unjudged.
    """
    both = _units(observed).withColumn("side", F.lit(0)).unionByName(_units(reference).withColumn("side", F.lit(1)))
    units = _with_variance(both.groupBy("unit").agg(*_pooled(F.col("side") == 1), *_lattice())).withColumn("step", _lattice_step()).drop("_sq", "_m", "_lo", "_hi")
    other = F.max(F.when(F.col("side") == 1, F.col("mean"))).over(Window.partitionBy("unit", "window_start"))
    rows = both.join(units, "unit").withColumn("other", other).where("side = 0").drop("side")
    mine = F.col("group_label").isNotNull() if grouped else F.col("group_label").isNull()
    rows = rows.where(mine | F.col("group_label").isNull()).withColumn("sound", usable(F.col("ref_n"), F.col("ref_var")))
    judged = mine & F.col("sound") if grouped or config.strict_reference else mine
    rows = rows.withColumn("n_eff", kish_n(F.col("sum_w"), F.col("sum_w2"))).withColumn("judged", judged).withColumn("followed", mine & F.col("sound") if grouped else mine)
    se = F.sqrt(F.col("ref_var") * (1 / F.col("n_eff") + 1 / F.nullif(F.col("ref_n"), F.lit(0.0))))
    rows = rows.withColumn("scorable", F.coalesce(F.col("judged") & (F.col("count") >= VALID_COUNT) & (F.col("n_eff") > 0), F.lit(False))).withColumn("se", se)
    return rows.withColumns(
        {
            "raw_z": (F.col("mean") - F.col("ref_mean")) / F.nullif(F.col("se"), F.lit(0.0)),
            "gate_z": gate_z(F.col("mean"), F.col("n_eff"), F.col("se"), F.col("step"), F.col("ref_mean")),
        }
    )


def _tag(rows: DataFrame, config: Curation) -> DataFrame:
    rows = rows.withColumn("threshold", sidak_z(F.lit(config.spike_z), F.col("family_n")))
    tag = F.when(F.col("gate_z") >= F.col("threshold"), "spike").when(F.col("gate_z") <= -F.col("threshold"), "dip")
    return rows.withColumn("tag", F.when(F.col("scorable"), tag))


def score_windows(observed: DataFrame, reference: DataFrame, config: Curation = Curation(), grouped: bool = False) -> DataFrame:
    """Scorable windows with n_eff, se, raw_z, gate_z, the family-wise threshold and spike/dip tag."""
    scored = frame(observed, reference, config, grouped).where("scorable")
    family = F.broadcast(scored.agg(F.count("*").alias("family_n")))  # one row
    return _tag(scored.crossJoin(family), config)


def with_neighbours(rows: DataFrame, window_ms: int, config: Curation) -> DataFrame:
    """A :func:`frame` with gap_end (where a hole after the window ends) and, at the last window of a run beyond the step threshold, run (its dir, start and z)."""
    order = Window.partitionBy("unit").orderBy("window_start")
    following = F.lead("window_start").over(order)
    wide = F.col("followed") & (following - F.col("window_end") >= (config.min_gap_ms or 2 * window_ms))
    base = F.coalesce(F.nullif(F.col("ref_mean"), F.lit(0.0)), F.lit(1.0))
    delta = F.when(F.col("judged") & F.col("sound"), (F.col("mean") - F.col("ref_mean")) / base)
    rows = rows.withColumn("gap_end", F.when(wide, following))
    rows = rows.withColumn("_dir", F.when(delta >= config.step_threshold, 1).when(delta <= -config.step_threshold, -1).otherwise(0))
    changed = F.when(F.col("_dir") == F.lag("_dir").over(order), 0).otherwise(1)
    rows = rows.withColumns({"_new": changed, "_last": ~F.coalesce(F.lead("_dir").over(order) == F.col("_dir"), F.lit(False))})
    rows = rows.withColumn("_run", F.sum("_new").over(order))
    run = Window.partitionBy("unit", "_run")
    w, w2, wv = (F.sum(c).over(run) for c in (F.col("sum_w"), F.col("sum_w2"), F.col("mean") * F.col("sum_w")))
    rows = rows.withColumns({"_n": F.count("*").over(run), "_w": w, "_w2": w2, "_wv": wv, "_start": F.min("window_start").over(run)})
    se = F.sqrt(F.col("ref_var") * (1 / kish_n(F.col("_w"), F.col("_w2")) + 1 / F.col("ref_n")))
    z = F.when(se > 0, F.abs(F.col("_wv") / F.col("_w") - F.col("ref_mean")) / se).otherwise(0.0)
    ends = F.col("_last") & (F.col("_dir") != 0) & (F.col("_n") >= config.step_windows)
    rows = rows.withColumn("run", F.when(ends, F.struct(F.col("_dir").alias("dir"), F.col("_start").alias("start"), z.alias("z"))))
    return rows.drop("_dir", "_new", "_last", "_run", "_n", "_w", "_w2", "_wv", "_start")


def detect(observed: DataFrame, reference: DataFrame, window_ms: int, config: Curation = Curation(), grouped: bool = False) -> DataFrame:
    """Every tile the comparison gives, unranked, the quietest window as the baseline there would be: TILE."""
    rows = frame(observed, reference, config, grouped)
    off = F.struct((~F.col("valid")).alias("invalid"), F.abs(F.col("mean") - F.col("ref_mean")).alias("off"), F.col("window_start").alias("start"))
    mixed = F.col("group_label").isNull()
    diff = F.when(mixed, F.abs(F.col("mean") - F.col("other")))
    all_of_it = F.broadcast(
        rows.agg(
            F.count_if("scorable").alias("family_n"), F.avg(diff).alias("avg_diff"), F.stddev_pop(diff).alias("std_diff"), F.min_by(F.when(mixed, F.col("window_start")), F.when(mixed, off)).alias("quietest"),
        )
    )  # one row
    rows = _tag(with_neighbours(rows, window_ms, config).crossJoin(all_of_it), config)
    apart = (diff - F.col("avg_diff")) / F.nullif(F.col("std_diff"), F.lit(0.0))
    start, end = F.col("window_start"), F.col("window_end")

    def tile(when: Column, tag: Column | str, a: Column, b: Column, magnitude: Column) -> Column:
        named = F.lit(tag) if isinstance(tag, str) else tag
        return F.when(when, F.struct(named.alias("shape_tag"), a.alias("region_start"), b.alias("region_end"), magnitude.cast("double").alias("magnitude")))

    tiles = [
        tile(F.col("tag").isNotNull(), F.col("tag"), start, end, F.abs("raw_z")),
        tile(F.col("run").isNotNull(), F.when(F.col("run.dir") > 0, "step_up").otherwise("step_down"), F.col("run.start"), start, F.col("run.z")),
        tile(F.col("gap_end").isNotNull(), "gap", end, F.col("gap_end"), F.lit(None)),
        tile(apart >= config.divergence_z, "divergence", start, end, apart),
        tile(mixed & (start == F.col("quietest")), "baseline", start, end, F.lit(None)),
    ]
    return rows.select("group_label", F.inline(F.array_compact(F.array(*tiles)))).select(*TILE)


def spikes(observed: DataFrame, reference: DataFrame, config: Curation = Curation(), grouped: bool = False) -> DataFrame:
    hits = score_windows(observed, reference, config, grouped).where("tag is not null")
    return hits.select(F.col("tag").alias("shape_tag"), "group_label", F.col("window_start").alias("region_start"), F.col("window_end").alias("region_end"), F.abs("raw_z").alias("magnitude"))


def steps(observed: DataFrame, reference: DataFrame, config: Curation = Curation(), grouped: bool = False) -> DataFrame:
    """Runs of consecutive emitted windows that stay beyond the step threshold on one side."""
    return detect(observed, reference, 0, config, grouped).where("shape_tag in ('step_up', 'step_down')")


def gaps(observed: DataFrame, reference: DataFrame, window_ms: int, config: Curation = Curation(), grouped: bool = False) -> DataFrame:
    """Holes between consecutive windows of a unit, at least min_gap_ms or two windows wide."""
    return detect(observed, reference, window_ms, config, grouped).where("shape_tag = 'gap'")


def divergences(observed: DataFrame, reference: DataFrame, config: Curation = Curation()) -> DataFrame:
    """Mixed windows of equal start whose means differ unusually."""
    return detect(observed, reference, 0, config).where("shape_tag = 'divergence'")


def quietest(observed: DataFrame, reference: DataFrame) -> DataFrame:
    """The baseline tile there would be: the mixed window nearest the reference mean, valid ones first."""
    return detect(observed, reference, 0).where("shape_tag = 'baseline'")


def with_baseline(tiles: DataFrame, candidate: DataFrame) -> DataFrame:
    """``tiles`` and the candidate, unless a tile starts where it does. Either is made once."""
    both = tiles.withColumn("found", F.lit(1)).unionByName(candidate.withColumn("found", F.lit(0)))
    taken = F.max("found").over(Window.partitionBy("region_start"))
    return both.withColumn("taken", taken).where("found = taken").drop("found", "taken")


def baseline(observed: DataFrame, reference: DataFrame, others: DataFrame) -> DataFrame:
    """The baseline tile, unless another starts there."""
    return with_baseline(others, quietest(observed, reference)).where("shape_tag = 'baseline'")


def unreachable_tails(observed: DataFrame, reference: DataFrame, config: Curation = Curation(), grouped: bool = False) -> DataFrame:
    """unit, direction, attainable_z, required_z where no window of the unit could pass the gate."""
    rows = score_windows(observed, reference, config, grouped).where("ref_var > 0 and se > 0")
    pick = F.max_by(F.struct("n_eff", "se", "step", "ref_mean", "threshold"), F.struct(F.col("n_eff"), -F.col("window_start")))
    best = rows.groupBy("unit").agg(pick.alias("b"), F.max("max_v").alias("hi"), F.min("min_v").alias("lo")).select("unit", "b.*", "hi", "lo")
    at = lambda c: gate_z(F.col(c), F.col("n_eff"), F.col("se"), F.col("step"), F.col("ref_mean"))
    both = best.select("unit", "threshold", F.explode(F.array(F.struct(F.lit("spike").alias("direction"), at("hi").alias("z")), F.struct(F.lit("dip").alias("direction"), (-at("lo")).alias("z")))).alias("t"))
    return both.where("t.z < threshold").select("unit", F.col("t.direction").alias("direction"), F.col("t.z").alias("attainable_z"), F.col("threshold").alias("required_z"))


def curate(observed: DataFrame, reference: DataFrame | None, window_ms: int, config: Curation = Curation(), grouped: bool = False) -> DataFrame:
    """The ranked tiles: by magnitude, then shape, then time; at most max_tiles, in order of time.

    Without a reference the observation is its own and divergence is not looked for.
    """
    found = detect(observed, observed if reference is None else reference, window_ms, config, grouped)
    if reference is None:
        found = found.where("shape_tag <> 'divergence'")
    # a baseline tile stays unless another tile starts there
    others = F.max((F.col("shape_tag") != "baseline").cast("int")).over(Window.partitionBy("region_start"))
    found = found.withColumn("_others", others).where("shape_tag <> 'baseline' or _others = 0").drop("_others") if config.include_baseline else found.where("shape_tag <> 'baseline'")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv]), F.col("shape_tag"))
    best = found.orderBy(F.coalesce("magnitude", F.lit(0.0)).desc(), rank, "region_start", F.coalesce("group_label", F.lit(MIXED)), "shape_tag").limit(config.max_tiles)
    return best.orderBy("region_start", rank, F.coalesce("group_label", F.lit(MIXED)), "shape_tag")


def tile_text(tiles: DataFrame) -> DataFrame:
    """``tiles`` with a short label and a description for people."""
    where = F.when(F.col("group_label").isNotNull(), F.concat(F.lit(" in "), "group_label")).otherwise("")
    said = F.lit("a quiet window near the reference mean")
    for shape, text in {
        "spike": "mean above the reference by %.1f standard errors", "dip": "mean below the reference by %.1f standard errors",
        "step_up": "a run of windows above the reference, %.1f standard errors", "step_down": "a run of windows below the reference, %.1f standard errors",
        "divergence": "observation and reference differ more than usual, %.3f deviations",
    }.items():
        said = F.when(F.col("shape_tag") == shape, F.format_string(text, "magnitude")).otherwise(said)
    said = F.when(F.col("shape_tag") == "gap", F.format_string("no events for %.1f s", (F.col("region_end") - F.col("region_start")) / 1000)).otherwise(said)
    return tiles.select("*", F.concat(F.replace("shape_tag", F.lit("_"), F.lit(" ")), where).alias("label"), said.alias("description"))


#: Names a header shows of a list; the whole lists are :func:`unscored_groups` and :func:`unreachable_tails`.
SHOWN_NAMES = 50


def _shown(rows: DataFrame, name: Column, as_: str) -> DataFrame:
    """One row: the first SHOWN_NAMES names in order, joined by commas, and ... if there are more."""
    first = rows.select(name.alias("name")).orderBy("name").limit(SHOWN_NAMES + 1)
    names = F.sort_array(F.collect_list("name"))
    return first.agg(F.array_join(F.concat(F.slice(names, 1, SHOWN_NAMES), F.when(F.size(names) > SHOWN_NAMES, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>"))), ",").alias(as_))


def package_header(observed: DataFrame, reference: DataFrame, config: Curation = Curation(), grouped: bool = False) -> DataFrame:
    """One row: global statistics, whether the reference is usable, family size and thresholds, span, unscored groups and tails out of reach."""
    mixed = pool_stats(reference.where("group_label is null")).select(
        F.col("ref_mean").alias("mean"), F.sqrt("ref_var").alias("std_dev"), usable(F.col("ref_n"), F.col("ref_var")).alias("reference_usable")
    )
    seen = observed.where("group_label is null").agg(F.count("*").alias("window_count"), F.sum("count").alias("event_count"), (F.max("window_end") - F.min("window_start")).alias("span_ms"))
    family = frame(observed, reference, config, grouped).agg(F.count_if("scorable").alias("family_n"))
    groups = unscored_groups(observed, reference)
    unscored = groups.agg(F.count("*").alias("unscored_groups")).crossJoin(_shown(groups, F.col("group_label"), "unscored_labels"))
    tails = _shown(unreachable_tails(observed, reference, config, grouped), F.concat_ws(":", "unit", "direction"), "unreachable")
    out = seen.join(mixed, F.lit(True), "left").crossJoin(family).crossJoin(unscored).crossJoin(tails)  # one row each; no reference leaves nulls
    out = out.withColumn("reference_usable", F.coalesce("reference_usable", F.lit(False)))
    return out.withColumns({"base_z": F.lit(config.spike_z), "effective_z": sidak_z(F.lit(config.spike_z), F.col("family_n"))})
