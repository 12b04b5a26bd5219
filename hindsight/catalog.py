"""All queries of the observation engine by name, with the SQL that checks them (in oracle.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .functions.stats import family_alpha, kish_n, norm_cdf, norm_ppf, sidak_z
from .model import Curation, Lens
from .operators import brain, calibration, coverage, curator, retention, vectors
from .operators.lens import apply_lens
from .oracle import ALERT_WINDOW, DAY, END, HOUR, MID, RESETS, TICK, WINDOW
from .plans.registry import Registry, resolve
from .sources import events as source
from .sources import fixtures
from .sources.storage import shared_folder
from .streaming import rules, session, summary, views

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 4
#: Means of two-digit values end in 5 too often to be rounded to a few digits.
MEAN_DIGITS = 7
WINDOW_COLUMNS = ("group_label", "window_start", "window_end", "count", "mean", "sum_sq", "sum_w", "min_v", "max_v", "valid")
GROUPED = Lens(window_ms=DAY, origin=0, group_by=("event_type",))
PLAIN = Lens(window_ms=DAY, origin=0)
#: Narrow enough that the random events cross it, so the queries return tiles.
SENSITIVE = Curation(spike_z=0.8, step_threshold=0.02, step_windows=2, divergence_z=0.5)


#: Means of sums that merge in another order than the SQL's, short enough in any case not to end in 5 there.
MERGED_DIGITS = 10


def rounded(df: DataFrame, *names: str, mean_digits: int = MEAN_DIGITS) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    wanted = names or df.columns
    kinds = dict(df.dtypes)
    digits = lambda c: mean_digits if c == "mean" and "sum_sq" in wanted else DIGITS
    return df.select(*[F.round(c, digits(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in wanted])


def _events(spark: SparkSession, sf_dir: str, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    return source.lens_events(source.read_events(spark, sf_dir, from_ms, to_ms))


def _two_valued(spark: SparkSession, sf_dir: str, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    return source.two_valued(source.read_events(spark, sf_dir, from_ms, to_ms))


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.test_events(source.read_events(spark, sf_dir))


def _lens(lens: Lens, make=_events) -> Query:
    return lambda spark, sf_dir: rounded(apply_lens(make(spark, sf_dir), lens), *WINDOW_COLUMNS)


def _sides(spark: SparkSession, sf_dir: str, lens: Lens, make=_events) -> tuple[DataFrame, DataFrame]:
    return retention.replay_with_reference(make(spark, sf_dir, 2 * MID - END, END), lens, MID, END)


def _kish(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_lens(_events(spark, sf_dir), Lens(window_ms=DAY, origin=0, decay="exp(tau=432000s)"))
    return rounded(out.select("window_start", "sum_w", "sum_w2", kish_n(F.col("sum_w"), F.col("sum_w2")).alias("n_eff")))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = curator.pool_stats(_sides(spark, sf_dir, GROUPED)[1])
    return rounded(pools.select("unit", "ref_w", "ref_n", "ref_mean", "ref_var", "ref_count", "ref_windows"))


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = curator.pool_stats(_sides(spark, sf_dir, GROUPED, _two_valued)[1])
    return pools.select("unit", curator.usable(F.col("ref_n"), F.col("ref_var")).alias("usable"))


def _numbers(spark: SparkSession, expression: Callable[[Column], dict[str, Column]]) -> DataFrame:
    return rounded(spark.range(1, 61).select(F.col("id").alias("n"), *[c.alias(k) for k, c in expression(F.col("id")).items()]))


def _scores(lens: Lens, make=_events) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = curator.score_windows(*_sides(spark, sf_dir, lens, make), SENSITIVE, bool(lens.group_by))
        return rounded(out.select("unit", "window_start", "n_eff", "step", "raw_z", "gate_z", "family_n", "threshold", "tag"))

    return run


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(window_ms=HOUR, origin=0, group_by=("event_type", "bucket"))
    return _tiles(curator.gaps(*_sides(spark, sf_dir, lens), HOUR, Curation(), True))


def _tiles(frame: DataFrame) -> DataFrame:
    return rounded(frame, *curator.TILE)


def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(curator.curate(*_sides(spark, sf_dir, PLAIN), DAY, SENSITIVE))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = retention.live_spans(END - DAY - 1, DAY, 5)
    out = curator.score_windows(*retention.replay_spans(_events(spark, sf_dir, spans[1][0], spans[0][1]), PLAIN, *spans), SENSITIVE)
    return rounded(out.select("unit", "window_start", "n_eff", "step", "raw_z", "gate_z", "family_n", "threshold", "tag"))


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed, reference = _sides(spark, sf_dir, PLAIN)
    return _tiles(curator.baseline(observed, reference, curator.spikes(observed, reference, SENSITIVE)))


def _divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = source.read_events(spark, sf_dir)
    one = apply_lens(source.lens_events(events.where("user_id % 2 = 0")), PLAIN)
    return _tiles(curator.divergences(one, apply_lens(source.lens_events(events.where("user_id % 2 = 1")), PLAIN), SENSITIVE))


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(apply_lens(source.arriving_late(_events(spark, sf_dir)), PLAIN), *WINDOW_COLUMNS)


def _agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.agent_stats(_tests(spark, sf_dir), TICK, WINDOW)


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.domain_stats(_tests(spark, sf_dir), TICK, WINDOW)


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each (schema, view) resolves to after the writes the oracle lists."""
    registry = Registry()
    for scope, window in oracle.WRITES:
        registry.set(scope, {"window_ms": window})
    looks = spark.createDataFrame(oracle.LOOKUPS, "schema string, view string")
    return resolve(registry.history(spark), looks, "window_ms").withColumn("window_ms", F.col("window_ms").cast("long"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = session.snapshot_frames(_tests(spark, sf_dir), TICK, WINDOW)
    gap = F.aggregate("domains", F.lit(0).cast("long"), lambda n, d: n + d["gap"])
    count = F.aggregate("agents", F.lit(0).cast("long"), lambda n, a: n + a["event_count"])
    return frame.select("tick_ts", F.size("agents").cast("long").alias("agents"), count.alias("events"), gap.alias("gap"), "touched")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    lenses = {"fine": Lens(window_ms=6 * HOUR, origin=0), "by_type": GROUPED, "coarse": Lens(window_ms=6 * HOUR, origin=0, downsample_factor=8)}
    return rounded(views.through_lenses(_events(spark, sf_dir), lenses).select("view", *WINDOW_COLUMNS))


def _shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    from .model import Rules

    stats = _agents(spark, sf_dir)
    both = brain.shadowed(brain.regressions(stats), brain.regressions(stats, replace(Rules(), delta=0.05)))
    return both.groupBy("source", "type").agg(F.count("*").alias("n"))


def _frame_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the frames show of the registry: how many writes, and the last one."""
    frames = session.snapshot_frames(_tests(spark, sf_dir), TICK, WINDOW, _deltas(spark))
    return frames.select("tick_ts", "touched", F.size("writes").cast("long").alias("writes"), F.try_element_at("writes", F.lit(-1))["params"].alias("last_write"))


def _shape_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every shape: the top tiles of days and the gaps of groups by the hour."""
    by_hour = Lens(window_ms=HOUR, origin=0, group_by=("event_type", "bucket"))
    tiles = curator.curate(*_sides(spark, sf_dir, PLAIN), DAY, SENSITIVE).unionByName(curator.gaps(*_sides(spark, sf_dir, by_hour), HOUR, Curation(), True))
    return curator.tile_text(tiles).select("shape_tag", "region_start", "label", "description")


def _deltas(spark: SparkSession) -> DataFrame:
    """The registry's history after the writes of the delta."""
    registry = Registry()
    for scope, row, at_ms in oracle.DELTAS:
        registry.set(scope, row, at_ms)
    return registry.history(spark)


def _delta_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brain.regressions(brain.with_delta(_agents(spark, sf_dir), _deltas(spark), session.SCHEMA))


def _stream(spark: SparkSession, sf_dir: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The events table as a stream of files, in a session of its own: a stream keeps the number of partitions its state began with, one for each core."""
    path = f"{sf_dir}/events.parquet"
    spark = spark.newSession()
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return extract(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"))  # a pattern: one file or a folder of them


def _stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a stream over the whole table, run until the table has been seen."""
    at = shared_folder(spark, "stream-decisions")
    ticks = rules.tick_stream(_stream(spark, sf_dir, source.test_events), TICK, WINDOW, f"{HOUR} milliseconds")
    decisions = rules.agent_decisions(ticks, deltas=rules.deltas_of(_deltas(spark), session.SCHEMA))
    rules.start_decisions(decisions, rules.decisions_sink(f"{at}/found"), f"{at}/state", availableNow=True).awaitTermination()
    return spark.read.schema(rules.DECISION).json(f"{at}/found").select("tick_ts", "type", "subject")


def _stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a stream whose events come in any order, corrected as they come."""
    at = shared_folder(spark, "stream-windows")
    table = summary.CorrectedTable(spark, f"{at}/windows", GROUPED)
    table.start(_stream(spark, sf_dir, source.lens_events), 400 * DAY, f"{at}/state", availableNow=True).awaitTermination()
    return rounded(table.windows(), *WINDOW_COLUMNS, mean_digits=MERGED_DIGITS)


def _from_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay answered from window statistics that two batches left, raw events only at its ends."""
    store = summary.SummaryStore(spark, shared_folder(spark, "summary"), HOUR, 6, ("event_type", "bucket"))
    store.add(_events(spark, sf_dir, to_ms=MID - 1), 0)
    store.add(_events(spark, sf_dir, from_ms=MID), 1)
    return rounded(store.replay(lambda a, b: _events(spark, sf_dir, a, b), GROUPED, *oracle.SPAN), *WINDOW_COLUMNS, mean_digits=MERGED_DIGITS)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test events whose weight is a mutation score."""
    return _tests(spark, sf_dir).withColumn("weight", F.pmod(F.col("seq") * 13, F.lit(101)) / 100)


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = spark.createDataFrame(oracle.TAGS, "version string, since_ms long, tag string, lo int, hi int")
    return vectors.tag_rollup(vectors.in_dictionary(_tests(spark, sf_dir), dictionary))


def queries() -> dict[str, Query]:
    """Name to query; each takes (spark, sf_dir)."""
    return {
        "lens_tumbling": _lens(PLAIN),
        "lens_epoch_origin": _lens(Lens(window_ms=6 * HOUR, origin=3 * HOUR)),
        "lens_first_event": _lens(Lens(window_ms=DAY)),
        "lens_group_by": _lens(GROUPED),
        "lens_group_by_multi": _lens(Lens(window_ms=DAY, origin=0, group_by=("event_type", "bucket"))),
        "lens_unkeyed": _lens(Lens(window_ms=DAY, origin=0, group_by=("event_type", "absent"))),
        "lens_downsample": _lens(Lens(window_ms=6 * HOUR, origin=0, downsample_factor=4)),
        "lens_decay_step": _lens(Lens(window_ms=DAY, origin=0, decay="step(cutoff=now-864000s)")),
        "lens_decay_exp": _lens(Lens(window_ms=DAY, origin=0, decay="exp(tau=432000s)")),
        "lens_decay_exp_grouped": _lens(Lens(window_ms=6 * HOUR, origin=0, downsample_factor=4, group_by=("event_type",), decay="exp(tau=432000s)")),
        "lens_weighted_kish": _kish,
        "retention_segment": lambda s, d: retention.segment(_events(s, d, MID, END), MID, END).select("seq", "ts_ms", F.round("value", 2).alias("value")),
        "retention_thinned": lambda s, d: retention.zones(_events(s, d), 5 * DAY, 15 * DAY, 3).select("seq", "ts_ms", "weight"),
        "replay_thinned": lambda s, d: rounded(retention.replay(retention.zones(_events(s, d), 5 * DAY, 15 * DAY, 3), PLAIN), *WINDOW_COLUMNS),
        "retention_resized": lambda s, d: retention.zones(_events(s, d), 3 * DAY).select("seq", "ts_ms", "weight"),
        "retention_sizes": lambda s, d: retention.sizes(_events(s, d), 5 * DAY, 15 * DAY, 3),
        "pool_reference": _pool,
        "reference_usable": _usable,
        "unscored_groups": lambda s, d: curator.unscored_groups(*_sides(s, d, GROUPED, _two_valued)),
        "sidak_threshold": lambda s, d: _numbers(s, lambda n: {"z": sidak_z(F.lit(2.0), n)}),
        "family_alpha": lambda s, d: _numbers(s, lambda n: {"alpha": family_alpha(n / 20), "cdf": norm_cdf(n / 20 - 1.5), "ppf": norm_ppf(n / 61)}),
        "curate_spike_dip": _scores(PLAIN),
        "curate_spike_dip_lattice": _scores(PLAIN, _two_valued),
        "curate_grouped": _scores(GROUPED),
        "curate_steps": lambda s, d: _tiles(curator.steps(*_sides(s, d, PLAIN), SENSITIVE)),
        "curate_gaps": _gaps,
        "curate_divergence": _divergence,
        "curate_baseline": _baseline,
        "unreachable_tails": lambda s, d: rounded(curator.unreachable_tails(*_sides(s, d, GROUPED, _two_valued_tight), Curation(), True)),
        "curate_top_tiles": _curated,
        "tile_text": lambda s, d: curator.tile_text(curator.spikes(*_sides(s, d, GROUPED), Curation(spike_z=0.1), True)).select("shape_tag", "region_start", "label", "description"),
        "tile_text_shapes": _shape_texts,
        "snapshot_writes": _frame_writes,
        "package_header": lambda s, d: rounded(curator.package_header(*_sides(s, d, GROUPED), Curation(), True)),
        "live_spans_curated": _live,
        "domain_rollup": lambda s, d: coverage.rollup(_tests(s, d)),
        "domain_coverage": lambda s, d: coverage.coverage(_tests(s, d)),
        "coverage_gaps": lambda s, d: coverage.coverage_gaps(_tests(s, d), "commit_hash"),
        "primary_domain": lambda s, d: _tests(s, d).groupBy(coverage.primary_domain(F.col("areas")).alias("domain")).agg(F.count("*").alias("n")),
        "observed_tests": lambda s, d: rounded(apply_lens(source.observe(_tests(s, d)), Lens(window_ms=DAY, origin=0, group_by=("agentId", "domain"))), *WINDOW_COLUMNS),
        "observed_agent": lambda s, d: rounded(apply_lens(source.of_agent(_tests(s, d), "agent-A"), PLAIN), *WINDOW_COLUMNS),
        "tick_agent_stats": lambda s, d: rounded(_agents(s, d)),
        "tick_domain_stats": _domains,
        "snapshot_frames": _frames,
        "parallel_views": _views,
        "tick_touched_bits": lambda s, d: coverage.touched_bits(_tests(s, d), TICK, WINDOW),
        "brain_baseline_ewma": lambda s, d: rounded(brain.baselines(_agents(s, d))),
        "brain_ar": lambda s, d: brain.regressions(_agents(s, d)),
        "brain_rc": lambda s, d: brain.replays(_agents(s, d)),
        "brain_cg": lambda s, d: brain.coverage_alerts(coverage.domain_stats(_tests(s, d), TICK, ALERT_WINDOW)),
        "brain_decisions": lambda s, d: brain.decisions(_agents(s, d), coverage.domain_stats(_tests(s, d), TICK, ALERT_WINDOW)).select("tick_ts", "type", "subject"),
        "brain_reset": lambda s, d: brain._reroutes(brain.judged(_agents(s, d), resets=RESETS)),
        "brain_shadow": _shadow,
        "brain_delta_as_of": _delta_as_of,
        "agent_blindness": lambda s, d: brain.blindness(coverage.agent_stats(_tests(s, d), HOUR, HOUR), HOUR),
        "stream_decisions": _stream_decisions,
        "stream_corrected_windows": _stream_windows,
        "replay_from_summary": _from_summary,
        "coverage_cumulative": lambda s, d: vectors.cumulative_coverage(_tests(s, d), TICK),
        "coverage_weights": lambda s, d: vectors.weight_vectors(_scored(s, d), DAY),
        "coverage_contributions": lambda s, d: vectors.contributions(_scored(s, d)),
        "coverage_delta_24h": lambda s, d: vectors.coverage_deltas(_tests(s, d)),
        "flaky_quarantine": lambda s, d: rounded(vectors.quarantines(_tests(s, d))),
        "agent_regressions_7d": lambda s, d: rounded(vectors.regressions(_tests(s, d))),
        "tag_rollup": _tags,
        "late_arrival_equivalence": _late,
        "registry_resolution": _registry,
        "calibration_false_alarm": lambda s, d: calibration.alarm_rate(fixtures.trials(s, 500)),
        "calibration_quiet_trials": lambda s, d: fixtures.quiet_false_positives(s, 500),
        "calibration_power": lambda s, d: calibration.alarm_rate(fixtures.trials(s, 500, burst=0.90)),
    }


def _two_valued_tight(spark: SparkSession, sf_dir: str, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Two-valued events whose groups hardly vary: most windows cannot reach the spike gate."""
    return source.lens_events(source.read_events(spark, sf_dir, from_ms, to_ms).withColumn("value", F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(1.0)))


def oracle_sql() -> dict[str, str]:
    return oracle.queries()
