"""The rule layer: per-agent baselines and the regression, coverage and replay rules.

State is a few numbers per agent. An agent's ticks, in order of time, stream past it, so a
task holds one agent's state and no list of ticks; agents are dealt over tasks by hash. The
coverage rule needs no state beyond its run of ticks and is a window expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Rules
from ..plans.registry import in_force

#: Scope and lens that a replay asks for.
FINE_SCOPE, FINE_GROUPS = "observe:test_result:v1#fine", ("agentId",)
_JUDGED = "tick_ts long, agent_id string, pass_rate double, baseline double, observations int, threshold double, fired_ar boolean, fired_rc boolean, dip_start long"


@dataclass
class AgentState:
    """What the rules remember of an agent."""

    baseline: float | None = None
    observations: int = 0
    low: int = 0
    rerouted: bool = False
    dips: int = 0
    active: bool = False
    since: int | None = None
    replayed: bool = False

    def reset(self) -> None:
        """Forget detections, keep what was learned."""
        self.low = self.dips = 0
        self.rerouted = self.active = self.replayed = False
        self.since = None

    def tick(self, ts: int, rate: float, count: int, rules: Rules, delta: float | None = None) -> dict[str, Any]:
        """Learn first, then judge with what this tick taught; ``delta`` is the one in force at the tick, else that of the rules."""
        delta = rules.delta if delta is None else delta
        if count >= rules.least_events:
            if self.baseline is None:
                self.baseline = rate
            elif self.observations < rules.warmup or rate >= self.baseline - delta:
                self.baseline = rules.alpha * rate + (1 - rules.alpha) * self.baseline
            self.observations += 1
        out = {"baseline": self.baseline, "observations": self.observations, "threshold": None, "fired_ar": False, "fired_rc": False, "dip_start": None}
        if self.observations < rules.warmup:
            return out
        out["threshold"] = threshold = max(self.baseline - delta, rules.floor)
        below = rate < threshold
        self.low = self.low + 1 if below else 0
        out["fired_ar"] = below and self.low >= rules.regression_ticks and not self.rerouted
        self.rerouted = below and (self.rerouted or out["fired_ar"])
        if below and rate >= rules.dip_floor:
            self.since = ts if self.dips == 0 else self.since
            self.dips += 1
            self.active = rules.dip_ticks <= self.dips <= rules.dip_most or (self.active and self.dips <= rules.dip_most)
        else:
            if not below and self.active and not self.replayed:
                out["fired_rc"], self.replayed = True, True
                out["dip_start"] = ts if self.since is None else self.since
            self.dips, self.active, self.since = 0, False, None
        return out


def _judge(rules: Rules, resets: tuple[int, ...]):
    """Task body: ticks sorted by agent and time -> _JUDGED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agent, state, due = object(), AgentState(), 0
        names = [c.split()[0] for c in _JUDGED.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.bool_(), pa.bool_(), pa.int64()]
        for batch in batches:
            out: list[list] = [[] for _ in names[3:]]
            agents, ticks, rates, counts, deltas = (batch.column(i).to_pylist() for i in range(5))
            for who, ts, rate, count, delta in zip(agents, ticks, rates, counts, deltas, strict=True):
                if who != agent:
                    agent, state, due = who, AgentState(), 0
                while due < len(resets) and resets[due] < ts:
                    state.reset()
                    due += 1
                said = state.tick(ts, rate, count, rules, delta)
                for column, name in zip(out, names[3:], strict=True):
                    column.append(said[name])
            made = [pa.array(c, k) for c, k in zip(out, kinds[3:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(kinds[0]), batch.column(0), batch.column(2).cast(kinds[2]), *made], names)

    return run


def judged(stats: DataFrame, rules: Rules = Rules(), resets: Iterable[int] = ()) -> DataFrame:
    """What every tick of an agent taught and fired: tick_ts, agent_id, pass_rate, baseline, observations, threshold (null while warming up), fired_ar, fired_rc, dip_start.

    ``resets`` are times after which detections start anew on learned baselines. A column
    ``delta`` of ``stats`` overrides the rules' where it is not null.
    """
    delta = F.col("delta").cast("double") if "delta" in stats.columns else F.lit(None).cast("double").alias("delta")
    ordered = stats.select("agent_id", "tick_ts", "pass_rate", "event_count", delta).repartition("agent_id").sortWithinPartitions("agent_id", "tick_ts")
    return ordered.mapInArrow(_judge(rules, tuple(sorted(resets))), _JUDGED)


def baselines(stats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Learned baseline, observations and threshold (null while warming up) after every tick of an agent."""
    return judged(stats, rules).select("tick_ts", "agent_id", "baseline", "observations", "threshold")


def _reroutes(rows: DataFrame) -> DataFrame:
    return rows.where("fired_ar").select("tick_ts", F.lit("rerouteSchema").alias("type"), F.col("agent_id").alias("subject"))


def regressions(stats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """rerouteSchema decisions: below the threshold for two ticks present, once until recovery."""
    return _reroutes(judged(stats, rules))


def _replays(rows: DataFrame, rules: Rules) -> DataFrame:
    hits = rows.where("fired_rc")
    return hits.select(
        "tick_ts", F.lit("replayRequest").alias("type"), F.col("agent_id").alias("subject"),
        (F.col("dip_start") - rules.pad_ms).alias("from_ts"), (F.col("tick_ts") + rules.pad_ms).alias("to_ts"),
        F.lit(FINE_SCOPE).alias("scope"), F.lit(rules.fine_ms).cast("long").alias("window_ms"), F.lit(",".join(FINE_GROUPS)).alias("group_by"),
    )


def replays(stats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """replayRequest decisions with the span to look at again, the scope and its lens: a short dip, once per agent until a reset."""
    return _replays(judged(stats, rules), rules)


def coverage_alerts(stats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """schemaUpdate decisions: a gap above the bar for five ticks in a row, once per episode. ``stats`` has a row at every tick."""
    order = Window.partitionBy("domain").orderBy("tick_ts")
    rows = stats.withColumn("bad", F.col("gap") > rules.gap_above)
    rows = rows.withColumn("run", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(order)).where("bad")
    place = F.row_number().over(Window.partitionBy("domain", "run").orderBy("tick_ts"))
    return rows.withColumn("place", place).where(F.col("place") == rules.gap_ticks).select("tick_ts", F.lit("schemaUpdate").alias("type"), F.col("domain").alias("subject"), "gap")


def decisions(agents: DataFrame, domains: DataFrame, rules: Rules = Rules(), resets: Iterable[int] = ()) -> DataFrame:
    """All decisions in the order of the rules: tick_ts, type, subject and, of replays, span, scope and lens."""
    rows = judged(agents, rules, resets)
    found = _reroutes(rows).unionByName(coverage_alerts(domains, rules).drop("gap")).unionByName(_replays(rows, rules), allowMissingColumns=True)
    return found


def shadowed(primary: DataFrame, shadow: DataFrame) -> DataFrame:
    """Two rule layers side by side: all decisions tagged by source; only the primary's are to be applied."""
    return primary.withColumn("source", F.lit("primary")).unionByName(shadow.withColumn("source", F.lit("shadow")))


def rules_of(schema_row: dict[str, Any] | None, rules: Rules = Rules()) -> Rules:
    """The constants with the delta that a schema row sets; another value than a number of 0 or more is ignored."""
    delta = (schema_row or {}).get("baseline_delta")
    valid = isinstance(delta, (int, float)) and not isinstance(delta, bool) and 0 <= delta < float("inf")
    return replace(rules, delta=float(delta)) if valid else rules


def with_delta(stats: DataFrame, history: DataFrame, schema: str) -> DataFrame:
    """``stats`` with the delta that the schema's row set at each tick (null: the default): later writes change no earlier tick."""
    row = in_force(stats, history, (f"schema:{schema}", "schema:*"), "_row")
    said = F.get_json_object("_row", "$.baseline_delta")
    delta = said.try_cast("double")
    sound = (delta >= 0) & (delta < float("inf")) & ~F.isnan(delta)
    return row.withColumn("delta", F.when(sound, delta)).drop("_row")


def blindness(stats: DataFrame, silent_ms: int, until_ms: int | None = None) -> DataFrame:
    """tick_ts, type 'blind', subject: an agent was absent for ``silent_ms``; once per silence.

    A silence that lasts is reported if it has reached its width by ``until_ms`` (null: the last tick of all).
    """
    order = Window.partitionBy("agent_id").orderBy("tick_ts")
    end = F.lit(until_ms).cast("long").alias("_end")
    last = F.broadcast(stats.agg(F.max("tick_ts").alias("_end"))) if until_ms is None else F.broadcast(stats.sparkSession.range(1).select(end))  # one row
    rows = stats.select("agent_id", "tick_ts", F.lead("tick_ts").over(order).alias("_next")).crossJoin(last)
    late = F.col("tick_ts") + silent_ms
    return rows.where((late < F.coalesce("_next", F.col("_end") + 1)) & (late <= F.col("_end"))).select(late.alias("tick_ts"), F.lit("blind").alias("type"), F.col("agent_id").alias("subject"))


@dataclass
class ShadowLog:
    """Runs a second rule layer beside the first: numbered entries, the last ``bound`` kept, tallies of all.

    An error of the shadow is counted and goes no further.
    """

    bound: int = 500
    entries: list[dict[str, Any]] = field(default_factory=list)
    tallies: dict[tuple[str, str], int] = field(default_factory=dict)
    errors: int = 0
    last: int = 0

    def _note(self, source: str, found: Iterable[dict[str, Any]]) -> None:
        for row in found:
            self.last += 1
            self.entries.append({"seq": self.last, "source": source} | row)
            key = source, row["type"]
            self.tallies[key] = self.tallies.get(key, 0) + 1
        del self.entries[: -self.bound]

    def run(self, primary: DataFrame, shadow: Any) -> list[dict[str, Any]]:
        """The primary's decisions of a tick (a few rows), to be applied; those of ``shadow()`` are logged only."""
        applied = [r.asDict() for r in primary.collect()]
        self._note("primary", applied)
        try:
            self._note("shadow", [r.asDict() for r in shadow().collect()])
        except Exception:  # a proposal must not stop the engine
            self.errors += 1
        return applied
