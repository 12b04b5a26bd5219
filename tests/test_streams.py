"""Stateful streams against the batch operators, across restarts."""

import pytest
from pyspark.sql import functions as F

from hindsight.model import Rules
from hindsight.operators import brain, coverage
from hindsight.plans.registry import RegistryLog
from hindsight.sources import events as source

HOUR, DAY = 3_600_000, 86_400_000
TICK, WINDOW = 6 * HOUR, DAY
SCHEMA = "test_result:v1"


@pytest.fixture(scope="module")
def tests(spark, sf_dir):
    return source.test_events(source.read_events(spark, sf_dir)).cache()


def feed(tests, folder, name, low, high):
    """Append the events of a span as one file, late ones of the span before included."""
    tests.where(f"arrival >= {low} and arrival < {high}").coalesce(1).write.parquet(f"{folder}/{name}")


def test_rules_on_the_stream_equal_the_batch_across_a_restart(spark, tests, tmp_path):
    from hindsight.streaming import rules as live

    ends = tests.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    mid = (ends[0] + ends[1]) // 2
    registry = RegistryLog(spark, str(tmp_path / "registry"))
    registry.set(f"schema:{SCHEMA}", {"baseline_delta": 0.02})
    # some events come up to 5 hours late
    arriving = tests.withColumn("arrival", F.col("ts_ms") + F.when(F.col("seq") % 7 == 0, F.col("seq") % 5 * HOUR).otherwise(0))
    rules = Rules(warmup=5)
    found = str(tmp_path / "decisions")

    def run(part, low, high):
        feed(arriving, tmp_path / "in", part, low, high)
        stream = spark.readStream.schema(arriving.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        deltas = live.deltas_of(RegistryLog(spark, str(tmp_path / "registry")).history(spark), SCHEMA)
        decisions = live.agent_decisions(live.tick_stream(stream, TICK, WINDOW, "6 hours"), rules, deltas, silent_ms=9 * HOUR)
        query = live.start_decisions(decisions, live.decisions_sink(found), str(tmp_path / "state"), availableNow=True)
        query.awaitTermination()

    run("a", 0, mid)
    registry.set(f"schema:{SCHEMA}", {"baseline_delta": 0.0001}, at_ms=mid)
    run("b", mid, 2**62)
    until = ends[1] - 6 * HOUR - 1
    got = {tuple(r) for r in spark.read.schema(live.DECISION).json(found).select("tick_ts", "type", "subject", "from_ts", "to_ts").collect()}
    stats = coverage.agent_stats(tests, TICK, WINDOW)
    judged = brain.with_delta(stats, registry.history(spark), SCHEMA)
    none = F.lit(None).cast("long")
    batch = brain.regressions(judged, rules).withColumns({"from_ts": none, "to_ts": none}).unionByName(brain.replays(judged, rules).select("tick_ts", "type", "subject", "from_ts", "to_ts"))
    want = {tuple(r) for r in batch.where(f"tick_ts < {until}").select("tick_ts", "type", "subject", "from_ts", "to_ts").collect()}
    quiet = brain.blindness(stats.where(f"tick_ts < {until}"), 9 * HOUR, until)
    want |= {tuple(r) for r in quiet.select("tick_ts", "type", "subject", none, none).collect()}
    assert got == want and {t for _, t, *_ in got} >= {"rerouteSchema"}
    early = {r for r in want if r[0] < mid}
    assert early == {r for r in got if r[0] < mid}
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "agent").load(str(tmp_path / "state"))
    assert state.count() == tests.select("agent_id").distinct().count()


def test_coverage_rule_on_the_stream(spark, tests, tmp_path):
    from hindsight.streaming import rules as live

    sparse = tests.where(f"floor(ts_ms / {DAY}) % 5 <> 3").withColumn("arrival", F.col("ts_ms"))  # days without events
    window = 9 * HOUR
    feed(sparse, tmp_path / "in", "a", 0, 2**62)
    stream = spark.readStream.schema(sparse.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    rows = live.domain_decisions(live.domain_stream(stream, TICK, window), TICK)
    live.start_decisions(rows, live.decisions_sink(str(tmp_path / "out")), str(tmp_path / "state"), availableNow=True).awaitTermination()
    got = {tuple(r) for r in spark.read.schema(live.DECISION).json(str(tmp_path / "out")).select("tick_ts", "type", "subject").collect()}
    until = sparse.agg(F.max("ts_ms")).first()[0] - 1
    batch = brain.coverage_alerts(coverage.domain_stats(sparse, TICK, window)).where(f"tick_ts < {until}")
    assert got == {tuple(r) for r in batch.select("tick_ts", "type", "subject").collect()} and len(got) > 3


def test_registry_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    one, two = RegistryLog(spark, folder), RegistryLog(spark, folder)
    heard = []
    one.on_change(lambda scope, row: heard.append((str(scope), row)))
    one.set("observe:a", {"window_ms": 1000})
    two.set("observe:a#fine", {"window_ms": 250}, at_ms=7)  # two has not seen the first
    one.set("pipeline:*", {"retention_window_ms": 5})
    with pytest.raises(ValueError):
        one.set("observe:a", {"window_ms": -1})
    three = RegistryLog(spark, folder)
    assert three.rows() == one.rows() and [n for n, *_ in one.rows()] == [1, 2, 3] and two.refresh() == 1
    assert three.get_observe("a", "fine") == {"window_ms": 250} and three.get_pipeline() == {"retention_window_ms": 5}
    assert [s for s, _ in heard] == ["observe:a", "observe:a#fine", "pipeline:*"]
    (tmp_path / "log" / "000000000004.json").touch()  # a writer that died
    three.set("observe:*", {"window_ms": 9})
    assert RegistryLog(spark, folder).get_observe("b") == {"window_ms": 9}
    assert [r.at_ms for r in three.history(spark).orderBy("seq").collect()] == [None, 7, None, None]


def plain_rows(frame):
    """Rows in order of what is exact in them; doubles compare with a tolerance, as sums merge in any order."""
    exact = lambda r: tuple(x for x in r if not isinstance(x, float))
    return [tuple(pytest.approx(x, rel=1e-9) if isinstance(x, float) else x for x in r) for r in sorted(map(tuple, frame.collect()), key=lambda r: repr(exact(r)))]


def bare(frame):
    return [tuple(x.expected if hasattr(x, "expected") else x for x in r) for r in plain_rows(frame)]


def test_summary_store_answers_without_the_raw_middle(spark, sf_dir, tmp_path):
    import shutil

    from hindsight.model import Lens
    from hindsight.operators.lens import apply_lens
    from hindsight.streaming.summary import SummaryStore

    events = source.lens_events(source.read_events(spark, sf_dir)).withColumn("day", F.floor(F.col("ts_ms") / DAY)).cache()
    events.repartition("day").write.partitionBy("day").parquet(str(tmp_path / "raw"))
    first = events.agg(F.min("day")).first()[0]
    a, b = first * DAY + 5 * HOUR + 7, (first + 20) * DAY + 1234
    lenses = [
        Lens(window_ms=DAY, origin=0, group_by=("bucket",)), Lens(window_ms=6 * HOUR, origin=3 * HOUR), Lens(window_ms=HOUR, origin=0, downsample_factor=8, group_by=("bucket", "event_type")),
        Lens(window_ms=DAY), Lens(window_ms=DAY, origin=0, group_by=("absent",)),
    ]
    want = [plain_rows(apply_lens(events.where(f"ts_ms between {a} and {b}"), x)) for x in lenses]
    store = SummaryStore(spark, str(tmp_path / "store"), HOUR, 6, ("event_type", "bucket"))
    for n in range(3):
        store.add(events.where(f"pmod(hash(seq), 3) = {n}"), n)
    store.add(events.where("pmod(hash(seq), 3) = 2"), 2)  # tried again
    read = lambda x, y: spark.read.parquet(str(tmp_path / "raw")).where(f"day between {x // DAY} and {y // DAY} and ts_ms between {x} and {y}")
    assert [bare(store.replay(read, x, a, b)) for x in lenses] == want
    assert [store.level_of(x) for x in lenses] == [3, 0, 3, None, None]
    store.compact()
    store.add(events.limit(0), 3)
    for day in range(first + 2, first + 19):
        shutil.rmtree(tmp_path / "raw" / f"day={day}")  # no raw event of the middle is left
    assert [bare(store.replay(read, x, a, b)) for x in lenses[:3]] == want[:3]
    assert bare(store.replay(read, lenses[0], a, a + HOUR)) == plain_rows(apply_lens(events.where(f"ts_ms between {a} and {a + HOUR}"), lenses[0]))


def test_late_events_correct_their_windows(spark, sf_dir, tmp_path):
    from hindsight.model import Lens
    from hindsight.operators.lens import apply_lens
    from hindsight.streaming.summary import CorrectedTable

    lens = Lens(window_ms=6 * HOUR, origin=HOUR, group_by=("event_type",))
    events = source.lens_events(source.read_events(spark, sf_dir))
    late = events.withColumn("arrival", F.col("ts_ms") + F.when(F.col("seq") % 5 == 0, 9 * DAY).otherwise(0))
    ends = late.agg(F.min("arrival"), F.max("arrival")).first()
    table = CorrectedTable(spark, str(tmp_path / "out"), lens)
    for i in range(3):
        step = (ends[1] - ends[0]) // 3 + 1
        feed(late, tmp_path / "in", str(i), ends[0] + i * step, ends[0] + (i + 1) * step)
        stream = spark.readStream.schema(late.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        table.start(stream, 10 * DAY, str(tmp_path / "state"), availableNow=True).awaitTermination()
    want = apply_lens(events, lens).where("group_label is not null").select(*[c for c in table.windows().columns])
    assert bare(table.windows()) == plain_rows(want)
    with pytest.raises(ValueError):
        table.lens = Lens(window_ms=1000)
        table.start(stream, 1, str(tmp_path / "other"))


def live_events(spark, rows):
    return spark.createDataFrame([(ts, float(seq % 3), {"k": "a"}, 1.0, seq) for seq, ts in enumerate(rows)], "ts_ms long, value double, keys map<string,string>, weight double, seq long")


def test_live_table_thins_like_the_batch(spark, tmp_path):
    from hindsight.operators import retention
    from hindsight.plans.registry import Registry
    from hindsight.streaming.live import BUCKET_MS, LiveSession

    rows = live_events(spark, [i * BUCKET_MS // 25 for i in range(400)]).cache()
    registry = Registry()
    registry.set("pipeline:*", {"retention_window_ms": 3 * BUCKET_MS})
    folder = str(tmp_path / "table")
    cuts = [0, 30, 31, 120, 200, 201, 330, 400]
    session = LiveSession(spark, registry, folder, reference=(6 * BUCKET_MS, 4))
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        session.take(rows.where(f"seq >= {a} and seq < {b}"), n)
        if n == 3:
            session.take(rows.where(f"seq >= {a} and seq < {b}"), n)  # tried again
        if n == 4:  # another session goes on
            session = LiveSession(spark, registry, folder, reference=(6 * BUCKET_MS, 4))
        want = retention.zones(rows.where(f"seq < {b}"), 3 * BUCKET_MS, 6 * BUCKET_MS, 4)
        if session._columns is not None:
            assert bare(session.both_zones().select("seq", "ts_ms", "weight")) == plain_rows(want.select("seq", "ts_ms", "weight")), n
    assert min(session._buckets()) >= 12 and session.zone()._counter()["aged"] == 400 - 76


def test_live_table_compacts(spark, tmp_path):
    from hindsight.plans.registry import Registry
    from hindsight.streaming.live import LiveSession

    rows = live_events(spark, [i * 1000 for i in range(60)])
    session = LiveSession(spark, Registry(), str(tmp_path / "table"))
    for n in range(6):
        session.take(rows.where(f"seq % 6 = {n}"), n)
    assert session._batches(0) == ([0, 1, 2, 3, 4, 5], -1) and session.compact(above=3) == [0] and session._batches(0) == ([-6], 5)
    session.take(rows.where("seq = 0"), 6)
    assert session.retained().count() == 61 and session.compact(above=1) == [0] and session._batches(0) == ([-7], 6)
    again = LiveSession(spark, Registry(), str(tmp_path / "table"))
    assert again.retained().count() == 61 and again._newest() == 59_000


def test_sketches_merge(spark, sf_dir):
    from hindsight.model import Lens
    from hindsight.operators import sketches

    events = source.lens_events(source.read_events(spark, sf_dir))
    fine = sketches.window_sketches(events, Lens(window_ms=HOUR, origin=0, group_by=("event_type",)))
    coarse = sketches.quantiles(sketches.merged(fine, "group_label")).collect()
    values = events.select(F.element_at("keys", "event_type").alias("k"), "value").toPandas()
    for row in coarse:
        mine = values[values.k == row.group_label].value
        assert row["count"] == len(mine)
        for q in (50, 90, 99):
            assert abs((mine <= row[f"q{q}"]).mean() - q / 100) < 0.02
    with pytest.raises(ValueError):
        sketches.window_sketches(events, Lens(window_ms=HOUR))


def test_views_share_one_table(spark, tmp_path):
    from hindsight.model import Lens
    from hindsight.operators.lens import apply_lens
    from hindsight.plans.registry import Registry
    from hindsight.streaming.views import ObservationOverlay

    rows = live_events(spark, [i * 100 for i in range(300)]).cache()
    registry, overlay = Registry(), None
    registry.set("observe:s#a", {"window_ms": 1000, "origin": 0, "group_by": ["k"]})
    registry.set("observe:s", {"window_ms": 2000})
    overlay = ObservationOverlay(registry)
    overlay.add(rows.where("seq < 50"), "s", "a", max_events=80)
    overlay.push("s", rows.where("seq >= 50 and seq < 100"))
    late = overlay.add(rows.where("seq >= 90 and seq < 100"), "s", "b")
    overlay.push("s", rows.where("seq >= 100 and seq < 150"))
    overlay.push("unknown", rows)
    both = overlay.windows()
    names = [c for c in both.columns if c != "view"]
    for view, lens, low in (("a", Lens(window_ms=1000, origin=0, group_by=("k",)), 70), ("b", Lens(window_ms=2000), 90)):
        want = apply_lens(rows.where(f"seq >= {low} and seq < 150"), lens).select(*names)
        assert bare(both.where(F.col("view") == f"s#{view}").select(*names)) == plain_rows(want)
    scans = lambda: overlay.windows()._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    before = scans()
    for n in range(3):
        overlay.push("s", rows.where(f"seq = {200 + n}"))
    assert scans() == before
    overlay.remove("s", "b")
    overlay.push("s", rows.where("seq = 250"))
    assert late.held().count() == 63 and overlay.keys() == [("s", "a")]


def test_decisions_are_applied_on_the_stream(spark, tmp_path):
    from hindsight.model import Lens
    from hindsight.operators import curator, retention
    from hindsight.plans.registry import Registry
    from hindsight.sources import fixtures
    from hindsight.streaming import rules as live

    tests = fixtures.stream(spark, 6000, start_ms=1_000_000, scenario="RC").cache()
    feed(tests.withColumn("arrival", F.col("ts_ms")), tmp_path / "in", "a", 0, 2**62)
    stream = spark.readStream.schema(tests.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    registry = Registry()
    decisions = live.agent_decisions(live.tick_stream(stream, 1000, 3000))
    live.start_decisions(decisions, live.applying_sink(registry, lambda: source.observe(tests), str(tmp_path / "out")), str(tmp_path / "state"), availableNow=True).awaitTermination()
    taken = spark.read.schema(live.DECISION).json(str(tmp_path / "out" / "decisions")).where("type = 'replayRequest'").collect()
    assert taken and registry.get_observe(SCHEMA, "fine") == {"window_ms": 1000, "group_by": ["agentId"]}
    lens = Lens(window_ms=1000, group_by=("agentId",))
    want = set()
    for row in taken:
        sides = retention.replay_with_reference(source.observe(tests), lens, row.from_ts, row.to_ts)
        want |= {(row.subject, t.shape_tag, t.group_label, t.region_start) for t in curator.curate(*sides, 1000, curator.Curation(), True).collect()}
    got = spark.read.json(str(tmp_path / "out" / "tiles")).select("subject", "shape_tag", "group_label", "region_start").collect()
    assert {tuple(r) for r in got} == want and any(t[1] == "dip" for t in want)
