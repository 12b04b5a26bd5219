"""Behaviours with hand-computed truth."""

import pytest
from pyspark.sql import functions as F

from hindsight.model import Curation, Lens, parse_decay, validate_observe
from hindsight.operators import brain, coverage, curator, retention
from hindsight.operators.lens import apply_lens
from hindsight.plans.registry import Registry, bind_retention, bind_window, parse_scope
from hindsight.sources import events as source
from hindsight.sources import fixtures

EVENT = "ts_ms long, value double, keys map<string,string>, weight double, seq long"


def events(spark, rows):
    return spark.createDataFrame([(t, float(v), k or {}, w, i) for i, (t, v, k, w) in enumerate(rows)], EVENT)


def plain(spark, pairs):
    return events(spark, [(t, v, None, None) for t, v in pairs])


def test_half_open_windows(spark):
    got = apply_lens(plain(spark, [(0, 1), (999, 1), (1000, 10)]), {"window_ms": 1000}).orderBy("window_start").collect()
    assert [(r.window_start, r["count"], r.mean) for r in got] == [(0, 2, 1.0), (1000, 1, 10.0)]


def test_grids(spark):
    rows = plain(spark, [(1234, 1), (1300, 2)])
    start = lambda lens: apply_lens(rows, lens).first().window_start
    assert start({"window_ms": 1000}) == 1234
    assert start({"window_ms": 1000, "align": "epoch"}) == 1000
    assert start({"window_ms": 1000, "origin": 200}) == 1200


def test_times_before_the_origin(spark):
    assert apply_lens(plain(spark, [(-1, 1)]), {"window_ms": 1000, "origin": 0}).first().window_start == -1000


def test_empty_and_null_events(spark):
    rows = spark.createDataFrame([(None, 1.0, {}, 1.0, 0), (5, None, {}, 1.0, 1)], EVENT)
    assert apply_lens(rows, {"window_ms": 10, "group_by": ["k"]}).count() == 0


def test_downsampling_is_exact(spark):
    rows = plain(spark, [(i * 137, i % 7) for i in range(300)])
    fine = apply_lens(rows, {"window_ms": 1000, "origin": 0, "downsample_factor": 5}).orderBy("window_start").collect()
    assert fine == apply_lens(rows, {"window_ms": 5000, "origin": 0}).orderBy("window_start").collect()


def test_missing_key_and_label_order(spark):
    rows = events(spark, [(0, 1, {"a": "x"}, None), (1, 2, {"b": ""}, None)])
    labels = {r.group_label for r in apply_lens(rows, {"window_ms": 10, "origin": 0, "group_by": ["a", "b"]}).collect()}
    assert labels == {None, "x|(none)", "(none)|"}


def test_step_decay_keeps_its_edge(spark):
    rows = plain(spark, [(0, 1), (500, 1), (1000, 1)])
    assert apply_lens(rows, {"window_ms": 10_000, "origin": 0, "decay": "step(cutoff=500ms)"}).first()["count"] == 2


@pytest.mark.parametrize("text", ["exp(tau=0s)", "exp(tau=5)", "linear(5s)", "step(cutoff=-5s)"])
def test_bad_decay(text):
    with pytest.raises(ValueError):
        parse_decay(text)


@pytest.mark.parametrize(
    "params",
    [{"window_ms": 0}, {"window_ms": -1}, {"window_ms": float("nan")}, {"window_ms": float("inf")}, {"origin": float("nan")}, {"align": "x"},
     {"downsample_factor": 0}, {"downsample_factor": 1.5}, {"group_by": "a"}, {"group_by": [1]}, {"decay_anchor": "x"}, {"decay": "soon"}, {"agg_func": "median"}],
)
def test_rejected_lens_leaves_no_trace(params):
    registry = Registry()
    with pytest.raises(ValueError):
        registry.set("observe:*", params)
    assert registry.rows() == [] and registry.get_observe("a") is None
    with pytest.raises(ValueError):
        validate_observe(params)


def test_scopes():
    assert parse_scope("observe:a:v1#fine") == ("observe", "a:v1", "fine")
    for bad in ("observe", "other:a", "observe:", "observe:#v"):
        with pytest.raises(ValueError):
            parse_scope(bad)


def test_bindings(spark):
    registry, seen, kept = Registry(), [], []
    registry.set("observe:*", {"window_ms": 10})
    bind_window(registry, seen.append, "a", "fine")
    registry.set("observe:a#other", {"window_ms": 20})
    registry.set("observe:a", {"window_ms": 10})
    registry.set("observe:a#fine", {"window_ms": 30})
    assert seen == [10, 30]
    bind_retention(registry, kept.append)
    registry.set("pipeline:*", {"retention_window_ms": 5})
    with pytest.warns(UserWarning):
        registry.set("pipeline:*", {"retention_window_ms": -1})
    assert kept == [5]
    assert registry.history(spark).count() == 6


def test_eviction_and_thinning(spark):
    rows = plain(spark, [(0, 1), (500, 1), (2000, 1)])
    assert [r.ts_ms for r in retention.fresh(rows, 1000).collect()] == [2000]
    many = plain(spark, [(i * 10, 1) for i in range(100)])
    kept = retention.thinned(many, 500, 10_000, 5)
    assert [r.seq for r in kept.orderBy("seq").collect()] == [4, 9, 14, 19, 24, 29, 34, 39, 44]
    for bad in ((0, None, None), (1, 5, None), (1, 5, 1)):
        with pytest.raises(ValueError):
            retention.validate(*bad)


def test_live_spans():
    assert retention.live_spans(10_500, 1000, 3) == ((7000, 9999), (4000, 6999))


def four_agents(spark):
    rows = []
    for w in range(5):
        for a in "abcd":
            for i in range(25):
                fails = 5 if (w == 4 and a == "c") else 1
                rows.append((w * 1000 + i * 40, 0 if i < fails else 1, {"agentId": f"agent-{a}"}, None))
    return events(spark, rows)


def test_grouping_recovers_a_diluted_dip(spark):
    rows = four_agents(spark)
    sides = lambda lens: (retention.replay(rows, lens, 4000, 4999), retention.replay(rows, lens, 0, 2999))
    mixed = Lens(window_ms=1000, origin=0)
    assert curator.spikes(*sides(mixed)).count() == 0
    tiles = curator.spikes(*sides(Lens(window_ms=1000, origin=0, group_by=("agentId",))), grouped=True).collect()
    assert [(t.shape_tag, t.group_label) for t in tiles] == [("dip", "agent-c")]


def test_lattice_gate(spark):
    reference = [(i * 10, 0 if i % 25 == 0 else 1) for i in range(300)]
    observed = [(100_000 + i * 10, 0 if i < 9 else 1) for i in range(100)]
    lens = Lens(window_ms=1000, origin=0)
    ref, obs = apply_lens(plain(spark, reference), lens), apply_lens(plain(spark, observed), lens)
    row = curator.score_windows(obs, ref).first()
    assert row.tag is None and row.raw_z < -2.1 and row.gate_z > -2.0
    nearly = [(t, 0.001 if i == 0 else v) for i, (t, v) in enumerate(observed)]
    assert curator.score_windows(apply_lens(plain(spark, nearly), lens), ref).first().tag == "dip"


def test_step_down(spark):
    pairs = [(w * 1000 + i * 100, (1.0 if w < 10 else 0.6) + 0.01 * (i % 2)) for w in range(15) for i in range(10)]
    windows = apply_lens(plain(spark, pairs), Lens(window_ms=1000, origin=0))
    tiles = curator.steps(windows, windows, Curation(step_threshold=0.25)).collect()
    assert [(t.shape_tag, t.region_start) for t in tiles] == [("step_down", 10_000)]


def test_blind_is_not_quiet(spark):
    rows = events(spark, [(i, 1, {"g": "flat"}, None) for i in range(10)])
    windows = apply_lens(rows, Lens(window_ms=100, origin=0, group_by=("g",)))
    assert [r.group_label for r in curator.unscored_groups(windows, windows).collect()] == ["flat"]
    header = curator.package_header(windows, windows, grouped=True).first()
    assert header.reference_usable is False and header.unscored_groups == 1


def test_primary_domain_and_gaps(spark):
    rows = spark.createDataFrame([([40, 41, 3],), ([3, 40],), ([],), ([300],)], "areas array<int>")
    assert [r[0] for r in rows.select(coverage.primary_domain(F.col("areas"))).collect()] == ["payment", "auth", "(none)", "(none)"]


STATS = "tick_ts long, agent_id string, pass_rate double, flaky_rate double, event_count long"


def ticks(spark, rates):
    return spark.createDataFrame([(i * 1000, "a", r, 0.0, 50) for i, r in enumerate(rates)], STATS)


def test_regression_fires_on_the_second_low_tick(spark):
    got = brain.regressions(ticks(spark, [0.95] * 12 + [0.7] * 4 + [0.95] * 2 + [0.7] * 3)).orderBy("tick_ts").collect()
    assert [r.tick_ts for r in got] == [13_000, 19_000]


@pytest.mark.parametrize(("dip", "fires"), [(1, False), (2, True), (7, True), (8, False)])
def test_replay_after_a_short_dip(spark, dip, fires):
    got = brain.replays(ticks(spark, [0.95] * 12 + [0.5] * dip + [0.95] * 3)).collect()
    assert bool(got) is fires
    if fires:
        assert (got[0].from_ts, got[0].to_ts) == (12_000 - 5000, (12 + dip) * 1000 + 5000)


def test_coverage_alert_on_the_fifth_tick(spark):
    gaps = [5] * 7 + [0] + [9] * 5 + [4] * 6
    stats = spark.createDataFrame([(i, "ui", 0, 0, g) for i, g in enumerate(gaps)], "tick_ts long, domain string, covered_bits long, required_bits long, gap long")
    assert [r.tick_ts for r in brain.coverage_alerts(stats).orderBy("tick_ts").collect()] == [4, 12]


TESTS = "ts_ms long, agent_id string, result string, areas array<int>, seq long"


def sparse_tests(spark):
    """Events in two bursts with nothing between."""
    rows = [(t, "a", "pass" if t % 3 else "fail", [t // 100 % 256, 7], t) for t in [*range(1000, 3001, 100), *range(40_000, 42_001, 100)]]
    return spark.createDataFrame(rows, TESTS)


def test_empty_ticks_count(spark):
    tests = sparse_tests(spark)
    got = {(r.tick_ts, r.domain): r for r in coverage.domain_stats(tests, 1000, 5000).collect()}
    assert {t for t, _ in got} == set(range(1000, 47_001, 1000))
    assert all(got[t, d].covered_bits == 0 and got[t, d].gap == n for t in range(9000, 40_000, 1000) for d, n in (("auth", 32), ("payment", 32), ("ui", 48), ("utils", 32)))
    assert {r.touched for r in coverage.touched_bits(tests, 1000, 5000).where("tick_ts between 9000 and 39000").collect()} == {0}
    assert coverage.agent_stats(tests, 1000, 5000).where("tick_ts between 9000 and 39000").count() == 0
    alerts = brain.coverage_alerts(coverage.domain_stats(tests, 1000, 5000))
    assert {r.tick_ts for r in alerts.where("subject = 'payment'").collect()} == {5000}
    for frame in (coverage.domain_stats, coverage.agent_stats, coverage.touched_bits):
        assert frame(tests.limit(0), 1000, 5000).count() == 0


def test_ticks_include_both_ends(spark):
    tests = spark.createDataFrame([(1000, "a", "pass", [1], 0), (6000, "a", "fail", [2], 1)], TESTS)
    got = {r.tick_ts: (r.event_count, r.pass_rate) for r in coverage.agent_stats(tests, 1000, 5000).collect()}
    assert got[6000] == (2, 0.5) and got[1000] == (1, 1.0) and got[7000] == (1, 0.0) and got[11_000] == (1, 0.0) and 12_000 not in got


def test_reset_keeps_what_was_learned(spark):
    stats = ticks(spark, [0.95] * 12 + [0.7] * 8)
    got = brain.judged(stats, resets=[15_000]).orderBy("tick_ts").collect()
    assert [r.tick_ts for r in got if r.fired_ar] == [13_000, 17_000] and got[-1].observations == 20
    twice = ticks(spark, [0.95] * 12 + [0.5] * 2 + [0.95] * 3 + [0.5] * 2 + [0.95])
    assert [r.tick_ts for r in brain.replays(twice).collect()] == [14_000]
    assert sorted(r.tick_ts for r in brain._replays(brain.judged(twice, resets=[16_000]), brain.Rules()).collect()) == [14_000, 19_000]


def test_rule_state_streams(spark):
    stats = spark.range(40_000).selectExpr("id * 1000 tick_ts", "'a' agent_id", "0.95 - (id % 50) / 1000 pass_rate", "0.0 flaky_rate", "9L event_count")
    assert brain.baselines(stats).agg(F.max("observations")).first()[0] == 40_000


def test_delta_of_a_schema_row():
    assert brain.rules_of({"baseline_delta": 0.2}).delta == 0.2
    assert all(brain.rules_of(row).delta == 0.10 for row in (None, {}, {"baseline_delta": -1}, {"baseline_delta": "x"}, {"baseline_delta": float("nan")}))


def test_shadow_log_is_bounded_and_isolated(spark):
    log = brain.ShadowLog(bound=3)
    taken = brain.regressions(ticks(spark, [0.95] * 12 + [0.7] * 4))
    for _ in range(3):
        assert len(log.run(taken, lambda: taken)) == 1
    assert [e["seq"] for e in log.entries] == [4, 5, 6] and log.tallies == {("primary", "rerouteSchema"): 3, ("shadow", "rerouteSchema"): 3}
    log.run(taken, lambda: 1 / 0)
    assert log.errors == 1 and log.last == 7


def test_applying_decisions(spark):
    from hindsight.streaming.session import apply_decisions

    rows = four_agents(spark)
    registry = Registry()
    last = rows.agg(F.max("ts_ms")).first()[0]
    ask = spark.createDataFrame([(last, "replayRequest", "a", last - 5000, last, brain.FINE_SCOPE, 1000, "agentId"), (last, "rerouteSchema", "a", None, None, None, None, None)], "tick_ts long, type string, subject string, from_ts long, to_ts long, scope string, window_ms long, group_by string")
    done = apply_decisions(ask, registry, rows)
    assert [d["applied"] for d in done] == [True, False]
    assert registry.get_observe("test_result:v1", "fine") == {"window_ms": 1000, "group_by": ["agentId"]}
    assert done[0]["header"].count() == 1 and done[0]["tiles"].columns == list(curator.TILE)
    refused = apply_decisions(ask.withColumn("window_ms", F.lit(-1).cast("long")), registry, rows)
    assert "rejected" in refused[0] and not refused[0]["applied"]


def test_session_controls(spark, tmp_path):
    from hindsight.streaming.session import SCHEMA, Session

    registry = Registry()
    registry.set(f"observe:{SCHEMA}#coarse", {"window_ms": 2000, "origin": 0})
    tests = fixtures.stream(spark, 3000, start_ms=0, scenario="AR").persist()
    session = Session(spark, registry, lambda: tests)
    for bad in (lambda: session.start_scenario("X", 0), lambda: session.set_baseline_delta(-1), lambda: session.set_coarse_downsample(0), lambda: session.replay(5, 5), lambda: session.replay(0, float("nan"))):
        with pytest.raises(ValueError):
            bad()
    session.set_baseline_delta(0.05)
    session.set_coarse_downsample(2)
    assert session.rules().delta == 0.05 and registry.get_observe(SCHEMA, "coarse") == {"window_ms": 2000, "origin": 0, "downsample_factor": 2}
    assert session.start_scenario("AR", 0).count() == 3000 and session.start_scenario("CG", 5).count() == 3000 and session.scenario == "AR" and session.resets == [0]
    tiles, header = session.replay(20_000, 40_000)
    assert header.first().window_count == 21 and tiles.count() <= 12
    with pytest.warns(UserWarning, match="looks back"):
        session.retention_ms = 10_000
        session.live(50_000)
    turn = session.tick(30_000)
    from hindsight.streaming.session import write_turn

    folder = str(tmp_path / "sink")
    write_turn(turn, folder)
    write_turn(turn, folder)
    assert spark.read.json(f"{folder}/frames").count() == 2
    assert turn["frame"].count() == 1 and len(turn["writes"]) == 3 and session.status()["scenario"] == "AR"
    assert session.decide().where("type = 'rerouteSchema' and subject = 'agent-C'").count() >= 1


def test_views(spark):
    from hindsight.streaming.views import ObservationOverlay, through_lenses

    rows = four_agents(spark)
    lenses = {"a": Lens(window_ms=1000, origin=0, group_by=("agentId",)), "b": Lens(window_ms=3000, origin=0), "c": Lens(window_ms=1000), "d": Lens(window_ms=1000, origin=0, decay="exp(tau=2s)")}
    both = through_lenses(rows, lenses)
    for name, lens in lenses.items():
        want = sorted(map(str, apply_lens(rows, lens).select("group_label", "window_start", "window_end", "count", F.round("mean", 9)).collect()))
        got = both.where(F.col("view") == name).select("group_label", "window_start", "window_end", "count", F.round("mean", 9)).collect()
        assert sorted(map(str, got)) == want
    registry = Registry()
    overlay = ObservationOverlay(registry)
    view = overlay.add(rows, "s", "v", max_events=10)
    assert view.windows() is None
    registry.set("observe:s", {"window_ms": 1000, "origin": 0})
    assert view.windows().agg(F.sum("count")).first()[0] == 10
    overlay.push("s", rows.limit(1).withColumn("seq", F.lit(10**6)))
    assert view.held().where("seq = 1000000").count() == 1
    overlay.remove("s", "v")
    registry.set("observe:s", {"window_ms": 7000, "origin": 0})
    assert view.lens().window_ms == 1000 and overlay.keys() == []


def test_weighted_bits_and_area_ranges(spark):
    rows = fixtures.stream(spark, 4000)
    sizes = {r.agent_id: (r.lo, r.hi) for r in rows.groupBy("agent_id").agg(F.min(F.size("areas")).alias("lo"), F.max(F.size("areas")).alias("hi")).collect()}
    assert sizes == {"agent-A": (2, 6), "agent-B": (4, 12), "agent-C": (2, 6), "agent-D": (2, 5)}
    assert rows.where(F.size("areas") != F.size(F.array_distinct("areas"))).count() == 0
    bits = rows.select("agent_id", F.explode("areas").alias("bit")).withColumn("domain", coverage.domain_of_bit(F.col("bit")))
    share = {(r.agent_id, r.domain): r.n for r in bits.groupBy("agent_id", "domain").agg(F.count("*").alias("n")).collect()}
    assert share["agent-B", "ui"] > 2 * share["agent-B", "auth"] and share["agent-A", "auth"] > share["agent-A", "utils"]


def test_truth_trials(spark):
    from hindsight.operators import calibration

    rates = {}
    for kind in fixtures.TRUTHS:
        rows, span = fixtures.truth_trials(spark, kind, 60)
        rates[kind] = calibration.alarm_rate(rows).first().rate
        assert (span is None) == (kind == "QUIET")
    assert rates["QUIET"] < 0.2 and rates["AR"] > 0.9 and rates["RC"] == 1.0
    with pytest.raises(ValueError):
        fixtures.truth_trials(spark, "X", 1)


@pytest.mark.parametrize(
    ("p", "events", "burst", "published"),
    [(0.95, 200, None, 0.0690), (0.95, 500, None, 0.0525), (0.95, 1000, None, 0.0440), (0.50, 1000, None, 0.0290), (0.99, 1000, None, 0.0810), (0.95, 1000, 0.90, 0.444), (0.95, 1000, 0.92, 0.211), (0.95, 1000, 0.60, 1.0)],
)
def test_published_rates(spark, p, events, burst, published):
    """Error rates published for 2000 trials, within four standard errors of 400 trials."""
    from hindsight.operators import calibration

    got = calibration.alarm_rate(fixtures.trials(spark, 400, events=events, p=p, burst=burst)).first()
    assert got.trials == 400 and abs(got.rate - published) <= 4 * (published * (1 - published) / 400 + published * (1 - published) / 2000) ** 0.5


def test_adviser(spark):
    from hindsight.operators import adviser
    from hindsight.streaming.session import snapshot_frames

    answer = """Sure: {"decisions": [{"type": "rerouteSchema", "reason": " low ", "agentId": "a"}, {"type": "quarantine", "reason": "x"},
      {"type": "schemaUpdate", "reason": "gap", "domain": "ui"}, {"type": "replayRequest", "reason": "dip", "lens": {"window_ms": 500}, "fromTs": 5},
      {"type": "replayRequest", "reason": "dip", "lens": {"window_ms": -5}}, {"type": "other", "reason": "x"}, 3, {"type": "schemaUpdate", "reason": " ", "domain": "ui"}]} done"""
    got = adviser.parse_decisions(answer, "observe:x#fine")
    assert [d["type"] for d in got["decisions"]] == ["rerouteSchema", "schemaUpdate", "replayRequest"] and got["rejected"] == 5 and not got["unparseable"]
    assert got["decisions"][2] == {"type": "replayRequest", "reason": "dip", "subject": None, "scope": "observe:x#fine", "lens": {"window_ms": 500}, "fromTs": 5}
    assert adviser.parse_decisions("no", "s")["unparseable"] and adviser.parse_decisions('{"decisions": 1}', "s")["unparseable"]
    assert adviser.parse_verdict('x {"verdict": "anomaly", "locationTs": 7, "shape": 3}') == {"verdict": "anomaly", "locationTs": 7} and adviser.parse_verdict('{"verdict": "maybe"}') is None
    assert adviser.score_verdict({"verdict": "anomaly", "locationTs": 900}, (1000, 2000), 100) == {"verdict_correct": True, "location_correct": True}
    assert adviser.score_verdict({"verdict": "anomaly", "locationTs": 2100}, (1000, 2000), 100)["location_correct"] is False
    assert adviser.score_verdict({"verdict": "none"}, None, 100) == {"verdict_correct": True, "location_correct": None} and not adviser.score_verdict(None, None, 1)["verdict_correct"]
    frames = snapshot_frames(sparse_tests(spark), 1000, 5000).persist()
    asked = []
    helper = adviser.Adviser(lambda prompt: asked.append(prompt) or answer, "observe:x#fine")
    assert len(helper.propose(frames, 0)) == 3 and helper.propose(frames, 5000) == [] and len(helper.propose(frames, 15_000)) == 3
    assert "Observation: 5 ticks" in asked[0] and "ui: " in asked[0] and helper.rejected == 10
    helper.ask = lambda prompt: helper.reset() or answer
    assert helper.propose(frames, 40_000) == []


def test_arms(spark):
    from hindsight.operators import adviser

    rows = four_agents(spark)
    windows = apply_lens(rows, {"window_ms": 1000, "origin": 0})
    tiles, header = curator.curate(windows, windows, 1000), curator.package_header(windows, windows)
    raw, curated, context = (adviser.render_arm(a, windows, tiles, header) for a in adviser.ARMS)
    assert "mean=" in raw and "base threshold: 2.0" in context and context.startswith(curated) and "1.9" not in context.split("base threshold")[1]
    with pytest.raises(ValueError):
        adviser.render_arm("other", windows, tiles, header)


def test_registry_hands_out_copies(spark):
    registry = Registry()
    registry.set("observe:a", {"group_by": ["k"]})
    registry.get_observe("a")["group_by"].append("x")
    registry.rows()[0][2]["group_by"] = []
    assert registry.get_observe("a") == {"group_by": ["k"]} and registry.rows()[0][2] == {"group_by": ["k"]}


def test_plans_read_events_once_and_push_bounds(spark, sf_dir):
    from hindsight import catalog

    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    segment = plan(catalog.queries()["retention_segment"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts" in segment and "LessThan(ts" in segment
    observed, reference = catalog._sides(spark, sf_dir, catalog.PLAIN)
    curated = observed.unionByName(reference)
    assert curated._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2
    assert "InMemoryRelation" in curated._jdf.queryExecution().withCachedData().toString()


def test_sizes(spark):
    rows = plain(spark, [(i * 100, 1) for i in range(100)])
    assert tuple(retention.sizes(rows, 2000, 6000, 3).first()) == (21, 21) and tuple(retention.sizes(rows, 2000).first()) == (21, 0)
    assert retention.thinned(rows.withColumn("seq", F.lit(None).cast("long")), 2000, 6000, 3).count() == 21


def test_late_arrival_changes_nothing(spark):
    rows = plain(spark, [(i * 50, i % 3) for i in range(200)])
    late = source.arriving_late(rows, 0.5)
    key = ("window_start", "count", "mean", "sum_sq")
    lens = Lens(window_ms=1000, origin=0)
    assert apply_lens(late, lens).select(*key).orderBy("window_start").collect() == apply_lens(rows, lens).select(*key).orderBy("window_start").collect()


def test_scenarios(spark):
    rows = fixtures.stream(spark, 2000, scenario="CG")
    assert rows.where("ts_ms < 30000").select(F.explode("areas").alias("b")).where("b between 16 and 23").count() == 0
    assert rows.where("ts_ms >= 30000").select(F.explode("areas").alias("b")).where("b between 16 and 23").count() > 0


def test_generators_are_seeded():
    one, two = fixtures.seeded(0), fixtures.seeded(1)
    assert [next(one) for _ in range(5)] == [next(two) for _ in range(5)]
    assert all(0 <= u < 1 for u, _ in zip(fixtures.mulberry32(42), range(100), strict=False))


def test_live_session(spark, tmp_path):
    from hindsight.streaming.live import LiveSession

    rows = four_agents(spark)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    registry, got = Registry(), []
    registry.set("observe:*", {"window_ms": 1000, "origin": 0, "group_by": ["agentId"]})
    session = LiveSession(spark, registry, str(tmp_path / "table"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    session.start(stream, lambda tiles: got.extend(tiles.collect()), str(tmp_path / "state"), spans=2).awaitTermination()
    assert session.retained().count() == rows.count()
    assert {t.tick_ts for t in got} == {rows.agg(F.max("ts_ms")).first()[0]}


def test_live_session_extracts(spark, tmp_path):
    from hindsight.streaming.live import LiveSession

    tests = fixtures.stream(spark, 500, start_ms=1)
    tests.coalesce(1).write.parquet(str(tmp_path / "in"))
    registry, got = Registry(), []
    registry.set("observe:*", {"window_ms": 1000, "origin": 0})
    session = LiveSession(spark, registry, str(tmp_path / "table"), extract=source.observe)
    session.start(spark.readStream.schema(tests.schema).parquet(str(tmp_path / "in")), lambda tiles: got.append(tiles.count()), str(tmp_path / "state")).awaitTermination()
    assert session.retained().count() == 500 and len(got) == 1 and set(session.retained().columns) == {"ts_ms", "value", "keys", "weight", "seq"}


def test_effective_window():
    from hindsight.model import effective_window_ms

    assert effective_window_ms({"window_ms": 500, "downsample_factor": 4}, 7) == 2000
    assert effective_window_ms({"downsample_factor": 4}, 7) == 7 and effective_window_ms(None, 7) == 7


def test_live_session_prunes_and_expires(spark, tmp_path):
    from hindsight.streaming import live

    rows = plain(spark, [(h * live.BUCKET_MS + m * 60_000, m % 3) for h in range(6) for m in range(60)])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    registry, got = Registry(), []
    registry.set("observe:*", {"window_ms": 600_000, "origin": 0})
    registry.set("pipeline:*", {"retention_window_ms": 2 * live.BUCKET_MS})
    session = live.LiveSession(spark, registry, str(tmp_path / "table"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    session.start(stream, lambda tiles: got.extend(tiles.collect()), str(tmp_path / "state"), spans=2).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "table")).select("bucket").distinct().toPandas().bucket) == [3, 4, 5]
    assert session.retained().count() == 121 and got
    assert "PartitionFilters: [isnotnull(bucket" in live.LiveSession(spark, registry, str(tmp_path / "table")).retained()._jdf.queryExecution().executedPlan().toString()
