"""The decision loop around a retained table: snapshot frames, decisions, their application, and the controls."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Curation, Lens, Rules
from ..operators import brain, coverage, curator, retention
from ..operators.asof import as_of
from ..plans.registry import BEGINNING, Registry
from ..sources import events as source
from ..sources import fixtures

SCHEMA = "test_result:v1"
#: Writes of the registry that a frame shows.
SHOWN_WRITES = 20


def snapshot_frames(tests: DataFrame, tick_ms: int, window_ms: int, history: DataFrame | None = None) -> DataFrame:
    """tick_ts, agents and domains (arrays of structs in order of name), touched: one row per tick, those with an empty window too.

    With a registry's ``history`` also writes: the last SHOWN_WRITES writes (seq, scope, params) in force by the tick, in order.
    """
    agents = coverage.agent_stats(tests, tick_ms, window_ms).groupBy("tick_ts").agg(F.sort_array(F.collect_list(F.struct("agent_id", "pass_rate", "flaky_rate", "event_count"))).alias("agents"))
    spine = coverage.ticks(tests, tick_ms, window_ms)
    domains = coverage.domain_stats(tests, tick_ms, window_ms, spine).groupBy("tick_ts").agg(F.sort_array(F.collect_list(F.struct("domain", "covered_bits", "required_bits", "gap"))).alias("domains"))
    out = domains.join(agents, "tick_ts", "left").join(coverage.touched_bits(tests, tick_ms, window_ms, spine), "tick_ts")
    none = F.array().cast(agents.schema["agents"].dataType)
    out = out.select("tick_ts", F.coalesce("agents", none).alias("agents"), "domains", "touched")
    return out if history is None else with_writes(out, history)


def with_writes(ticks: DataFrame, history: DataFrame, shown: int = SHOWN_WRITES) -> DataFrame:
    """``ticks`` with writes: the last ``shown`` writes by their time. Each write carries those before it; ticks find theirs as of their time."""
    order = Window.orderBy("at_ms", "seq")  # writes of parameters, which are few
    timed = history.withColumn("at_ms", F.coalesce("at_ms", F.lit(BEGINNING)))
    carried = timed.select("at_ms", "seq", F.collect_list(F.struct("seq", "scope", "params")).over(order.rowsBetween(1 - shown, 0)).alias("writes"))
    found = as_of(ticks, carried, "tick_ts", "at_ms", ("writes",), order="seq")
    return found.withColumn("writes", F.coalesce("writes", F.array().cast(carried.schema["writes"].dataType)))


def apply_decisions(decisions: DataFrame, registry: Registry, events: DataFrame, config: Curation = Curation()) -> list[dict[str, Any]]:
    """What becomes of a tick's decisions (a few rows): replays are looked at again, all others are proposals.

    A replay writes the lens it asks for to the registry, without the span, and returns tiles
    and header of the span against the one before. A lens the registry rejects is reported
    and stops nothing.
    """
    out = []
    for row in (r.asDict() for r in decisions.collect()):
        done: dict[str, Any] = {"decision": row, "applied": False}
        if row["type"] == "replayRequest":
            lens = {"window_ms": row["window_ms"], "group_by": row["group_by"].split(",")}
            try:
                registry.set(row["scope"], lens)
            except ValueError as refused:
                done["rejected"] = str(refused)
            else:
                observed, reference = retention.replay_with_reference(events, lens, row["from_ts"], row["to_ts"])
                tiles = curator.curate(observed, reference, Lens.of(lens).output_ms, config, True)
                header = curator.package_header(observed, reference, config, True)
                done |= {"applied": True, "tiles": retention.keeping(tiles, observed), "header": retention.keeping(header, observed)}
        out.append(done)
    return out


def write_turn(turn: dict[str, Any], folder: str) -> None:
    """Append a turn of :meth:`Session.tick` to JSON-lines tables: frames, decisions, and tiles of what was replayed."""
    turn["frame"].write.mode("append").json(f"{folder}/frames")
    turn["decisions"].write.mode("append").json(f"{folder}/decisions")
    for done in turn["packages"]:
        if done["applied"]:
            named = done["tiles"].withColumn("tick_ts", F.lit(done["decision"]["tick_ts"]))
            named.write.mode("append").json(f"{folder}/tiles")
            retention.release(done["tiles"])
    turn["decisions"].unpersist()


class Diagnostics:
    """Warnings about the live view, each once while its cause lasts."""

    def __init__(self) -> None:
        self._budget: tuple[int, int] | None = None
        self._aligned, self._blind = True, False

    def budget(self, window_ms: int, retention_ms: int, count: int = 3) -> None:
        if (window_ms, retention_ms) != self._budget:
            self._budget = window_ms, retention_ms
            if (needed := retention.live_lookback_ms(window_ms, count)) > retention_ms:
                most = retention.most_window_ms(retention_ms, count)
                warnings.warn(f"the live view looks back {needed} ms but {retention_ms} ms are retained; windows of {most} ms at most, or more retention, would fit", stacklevel=3)

    def grid(self, lens: Lens) -> None:
        aligned = lens.grid == "epoch"
        if self._aligned and not aligned:
            warnings.warn("the live lens starts its grid at each span's first event; windows of the two spans may not line up", stacklevel=3)
        self._aligned = aligned

    def blindness(self, usable: bool) -> None:
        if not usable and not self._blind:
            warnings.warn("the live reference cannot be compared with: no tiles now mean blindness, not quiet", stacklevel=3)
        self._blind = not usable


class Session:
    """Controls of an engine over a retained table of test events. A bad request raises ValueError; anything else is a fault of ours."""

    def __init__(self, spark: SparkSession, registry: Registry, tests: Callable[[], DataFrame], retention_ms: int = 60_000, rules: Rules = Rules()):
        self.spark, self.registry, self.tests, self.retention_ms, self.base_rules = spark, registry, tests, retention_ms, rules
        self.resets: list[int] = []
        self.scenario: str | None = None
        self.now_ms: int | None = None
        self.diagnostics, self.log = Diagnostics(), brain.ShadowLog()

    def rules(self) -> Rules:
        """Read at every tick, so a change of the schema row counts at once."""
        return brain.rules_of(self.registry.get_schema(SCHEMA), self.base_rules)

    def start_scenario(self, name: str, now_ms: int, events: int = 3000, seed: int = 1) -> DataFrame:
        """The stream of a scenario; a second call while one runs changes nothing. Detections start anew."""
        if name not in fixtures.SCENARIOS:
            raise ValueError(f"scenario must be one of {', '.join(fixtures.SCENARIOS)}")
        if self.scenario is None:
            self.scenario = name
            self.resets.append(now_ms)
        return fixtures.stream(self.spark, events, start_ms=now_ms, scenario=self.scenario, seed=seed)

    def stop(self) -> None:
        self.scenario = None

    def set_baseline_delta(self, value: float, at_ms: int | None = None) -> None:
        """``at_ms``: the time from which it is in force; null, the time after the last tick."""
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value < float("inf"):
            raise ValueError("baseline_delta must be a finite number of 0 or more")
        now = None if self.now_ms is None else self.now_ms + 1
        self.registry.set(f"schema:{SCHEMA}", {"baseline_delta": value}, now if at_ms is None else at_ms)

    def set_coarse_downsample(self, factor: int) -> None:
        """Changes the factor of the coarse lens and nothing else of it."""
        row = self.registry.get_observe(SCHEMA, "coarse") or {}
        self.registry.set(f"observe:{SCHEMA}#coarse", row | {"downsample_factor": factor})

    def replay(self, from_ms: float, to_ms: float, window_ms: int = 1000, config: Curation = Curation()) -> tuple[DataFrame, DataFrame]:
        """Tiles and header of a span against the one before it."""
        if not all(isinstance(x, (int, float)) and abs(x) < float("inf") for x in (from_ms, to_ms)) or not to_ms > from_ms:
            raise ValueError("a replay needs a finite span that ends after it starts")
        lens = {"window_ms": window_ms}
        observed, reference = retention.replay_with_reference(source.observe(self.tests()), lens, int(from_ms), int(to_ms))
        return curator.curate(observed, reference, window_ms, config), curator.package_header(observed, reference, config)

    def live(self, now_ms: int, count: int = 3, config: Curation = Curation()) -> tuple[DataFrame, DataFrame] | None:
        """Tiles and header of the last whole windows of the coarse lens; warns if they cannot mean much."""
        row = self.registry.get_observe(SCHEMA, "coarse")
        if row is None:
            return None
        lens = Lens.of(row)
        kept = int((self.registry.get_pipeline() or {}).get("retention_window_ms") or self.retention_ms)
        self.diagnostics.budget(lens.output_ms, kept, count)
        self.diagnostics.grid(lens)
        spans = retention.live_spans(now_ms, lens.output_ms, count, int(lens.origin or 0))
        observed, reference = retention.replay_spans(source.observe(retention.fresh(self.tests(), kept)), lens, *spans)
        header = curator.package_header(observed, reference, config, bool(lens.group_by))
        first = header.select("reference_usable").first()
        self.diagnostics.blindness(bool(first and first[0]))
        return curator.curate(observed, reference, lens.output_ms, config, bool(lens.group_by)), header

    def decide(self, tick_ms: int = 1000, window_ms: int = 5000) -> DataFrame:
        """Every tick judged by the delta in force at it: a later write changes no earlier decision."""
        tests = self.tests()
        agents = brain.with_delta(coverage.agent_stats(tests, tick_ms, window_ms), self.registry.history(self.spark), SCHEMA)
        return brain.decisions(agents, coverage.domain_stats(tests, tick_ms, window_ms), self.base_rules, self.resets)

    def tick(self, now_ms: int, tick_ms: int = 1000, window_ms: int = 5000, shadow: Callable[[], DataFrame] | None = None) -> dict[str, Any]:
        """One turn: frame, decisions taken at ``now_ms`` and what became of them. Frame and packages are tables to write to any sink."""
        self.now_ms, tests = now_ms, self.tests()
        frame = snapshot_frames(tests, tick_ms, window_ms, self.registry.history(self.spark)).where(F.col("tick_ts") == now_ms)
        taken = self.decide(tick_ms, window_ms).where(F.col("tick_ts") == now_ms).persist()
        self.log.run(taken, shadow or (lambda: taken.limit(0)))
        packages = apply_decisions(taken, self.registry, source.observe(tests))
        return {"frame": frame, "decisions": taken, "packages": packages, "writes": self.registry.rows()[-SHOWN_WRITES:]}

    def status(self) -> dict[str, Any]:
        return {"scenario": self.scenario, "rules": self.rules(), "writes": len(self.registry.rows()), "decisions": dict(self.log.tallies), "shadow_errors": self.log.errors}
