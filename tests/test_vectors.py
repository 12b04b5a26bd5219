"""As-of joins, coverage vectors, rolling rules and the tick spine against brute force and on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from hindsight.model import Curation, Lens
from hindsight.operators import coverage, curator, retention, vectors
from hindsight.operators.asof import as_of
from hindsight.sources import events as source

TESTS = "ts_ms long, test_id string, agent_id string, areas array<int>, result string, weight double, commit_hash string, seq long"


def test_as_of(spark):
    dice = random.Random(4)
    left = [(dice.choice([None, "a", "b"]), dice.choice([None, *range(-30, 60)]), i) for i in range(200)]
    right = [(dice.choice([None, "a", "b"]), dice.choice([None, *range(-30, 60)]), i, dice.choice([None, 1.5, 2.5])) for i in range(60)] + [("c", 0, 99, 1.0)]
    rows = as_of(spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, w long, n long, v double"), "t", "w", ("v", "n"), by=("k",), order="n", block_ms=10)
    got = {r.id: (r.v, r.n) for r in rows.collect()}
    for k, t, i in left:
        known = [r for r in right if r[0] == k and r[1] is not None and t is not None and r[1] <= t]
        last = max(known, key=lambda r: (r[1], r[2]), default=(None, None, None, None))
        assert got[i] == (last[3], last[2])
    assert len(got) == len(left)
    assert as_of(spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame([], "w long, v double"), "t", "w", ("v",)).where("v is null").count() == 200
    with pytest.raises(ValueError):
        as_of(spark.range(1), spark.range(1), "id", "id", ("id",))


def odd_tests(spark):
    rows = [(1000 * i, f"t{i % 3}", f"a{i % 2}", [i % 256, 255, 300, -1] if i % 4 else None, ["pass", "fail", "flaky", None][i % 4], None if i % 5 == 0 else i / 100, f"c{i // 7}", i) for i in range(60)]
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, "t", "a", [1], "pass", 1.0, "c", 99)], TESTS), rows


def test_vectors_on_awkward_rows(spark):
    frame, rows = odd_tests(spark)
    got = {r.tick_ts: r for r in vectors.cumulative_coverage(frame, 5000, {0, 1, 255}).collect()}
    seen = set()
    for tick in sorted(got):
        seen = {b for ts, _, _, areas, result, *_ in rows if ts <= tick and result == "pass" for b in areas or [] if 0 <= b < 256}
        gap = sorted(seen ^ {0, 1, 255})
        assert got[tick].gap_vec == ",".join(map(str, gap)) and got[tick].covered == len(seen)
    parts = vectors.weight_vectors(frame, 10_000)
    whole = {r.bit: r for r in vectors.merge_vectors(parts).collect()}
    touched = [(b, r) for r in rows for b in set(r[3] or [])]
    assert set(whole) == {b for b, _ in touched}
    assert all(whole[b].weight == max((r[5] for x, r in touched if x == b and r[5] is not None), default=None) for b in whole)
    assert vectors.cumulative_coverage(frame.limit(0), 5000).count() == 0 and vectors.contributions(frame.limit(0)).count() == 0
    assert vectors.unmapped_bits(frame).where("bit in (300, -1)").count() == 2


def test_rolling_rates(spark):
    frame, rows = odd_tests(spark)
    rows = [*rows, rows[3], rows[3]]
    got = {(r.key, r.tick_ts): (r.n, r.hits) for r in vectors.rolling_rates(frame, "test_id", "fail", 2000, 10_000).collect()}
    for (key, tick), (n, hits) in got.items():
        mine = [r for r in rows if r[1] == key and tick - 10_000 < r[0] <= tick]
        assert (n, hits) == (len(mine), sum(r[4] == "fail" for r in mine))
    with pytest.raises(ValueError):
        vectors.rolling_rates(frame, "test_id", "fail", 3000, 10_000)


def test_dictionary_versions(spark):
    frame, rows = odd_tests(spark)
    dictionary = spark.createDataFrame([(1, 10_000, "a.b", 0, 20), (1, 10_000, "a.c", 10, 30), (2, 30_000, "z", 255, 255)], "version int, since_ms long, tag string, lo int, hi int")
    got = {r.seq: (r.version, r.tags) for r in vectors.in_dictionary(frame, dictionary).where("ts_ms is not null").collect()}
    assert got[5] == (None, []) and got[11] == (1, ["a", "a.b", "a.c"]) and got[21] == (1, ["a", "a.c"]) and got[12] == (1, []) and got[33] == (2, ["z"])
    assert vectors.in_dictionary(frame, dictionary).count() == 63 and vectors.in_dictionary(frame, dictionary.limit(0)).where("version is null").count() == 63
    with pytest.raises(ValueError):
        vectors.in_dictionary(frame, dictionary, most_versions=1)


def test_a_stray_time_is_refused(spark):
    tests = spark.createDataFrame([(0, "a", [1], "pass"), (1_700_000_000_000, "a", [1], "pass")], "ts_ms long, agent_id string, areas array<int>, result string")
    with pytest.raises(ValueError, match="astray"):
        coverage.ticks(tests, 1000, 5000)
    assert coverage.agent_stats(tests, 1000, 5000).count() == 12
    assert coverage.ticks(tests.where("ts_ms = 0"), 1000, 5000).count() == 6 and coverage.ticks(tests.limit(0), 1000, 5000).count() == 0


def test_one_frame_for_all_detectors(spark, sf_dir):
    day = 86_400_000
    events = source.lens_events(source.read_events(spark, sf_dir))
    middle = events.agg(F.expr("floor((min(ts_ms) + max(ts_ms)) / 2)")).first()[0]
    observed, reference = retention.replay_with_reference(events, Lens(window_ms=day, origin=0, group_by=("event_type",)), middle, middle + 10 * day)
    tiles = curator.curate(observed, reference, day, Curation(spike_z=0.5), True)
    plan = tiles._jdf.queryExecution().sparkPlan().toString()
    # the units' sums, and one row of all: seen from both the rows and that row
    assert plan.count("Join") <= 3 and "CartesianProduct" not in plan
    assert tiles.count() > 0
    retention.release(observed)
    assert not spark._jsparkSession.sharedState().cacheManager().lookupCachedData(observed.kept_windows._jdf).isDefined()


def test_published_trial_shapes(spark):
    """The published magnitudes: 35 to 38 standard errors for the burst, 21.4 to 23.5 for the regression; nothing much for quiet ones."""
    from hindsight.operators import calibration
    from hindsight.sources import fixtures

    for kind, low, high in (("RC", 34, 41), ("AR", 20, 26), ("QUIET", 1, 3)):
        trials, window_ms = fixtures.ab_trials(spark, kind, 40)
        windows = calibration.trial_windows(trials, window_ms)
        rows = curator.frame(windows.where("is_obs").drop("is_obs"), windows.where("not is_obs").drop("is_obs"), Curation(), True)
        most = rows.groupBy("group_label").agg(F.max(F.abs("raw_z")).alias("z")).agg(F.avg("z"), F.count("*")).first()
        assert low < most[0] < high and most[1] == 40, (kind, most)
        hits = calibration.judged_trials(trials, window_ms).agg(F.avg(F.col("hit").cast("int"))).first()[0]
        assert hits == 1 if kind != "QUIET" else hits < 0.2
        windows.unpersist()
    with pytest.raises(ValueError):
        fixtures.ab_trials(spark, "X", 1)


def test_header_shows_some_names(spark):
    names = spark.createDataFrame([(f"g{i:03d}",) for i in range(60)], "n string")
    shown = curator._shown(names, F.col("n"), "s").first()[0].split(",")
    assert shown == [f"g{i:03d}" for i in range(curator.SHOWN_NAMES)] + ["..."]
    assert curator._shown(names.limit(0), F.col("n"), "s").first()[0] == ""
