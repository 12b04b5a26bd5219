"""The rule layer on a stream: native sliding windows, then keyed state with event-time timers.

The first state is Spark's own: sliding windows per agent, which close when the watermark has
passed a tick. The second is a few numbers per agent (what the rules remember), kept in the
state store; the ticks of an agent reach it in order. A timer per agent says when silence has
become blindness. Both survive a restart from the checkpoint. The delta in force comes from the
registry's history, read when the query starts: after a write, restart it; ticks before the
write keep what they were judged by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..model import DOMAINS, Curation, Rules
from ..operators import brain, retention
from ..operators.brain import AgentState
from ..plans.registry import BEGINNING, Registry
from .session import apply_decisions

DECISION = "tick_ts long, type string, subject string, from_ts long, to_ts long, scope string, window_ms long, group_by string"
_NAMES = [c.split()[0] for c in DECISION.split(", ")]
_STATE = "baseline double, observations int, low int, rerouted boolean, dips int, active boolean, since long, replayed boolean, last long, resets int"
#: The store that keeps state and timers by key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _at_ticks(tests: DataFrame, tick_ms: int, window_ms: int, watermark: str) -> tuple[DataFrame, Any]:
    """A stream with its event time, and the windows [tick - window_ms, tick], both ends included."""
    timed = tests.where("ts_ms is not null").withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", watermark)
    return timed, F.window("at", f"{window_ms + 1} milliseconds", f"{tick_ms} milliseconds", f"{-window_ms % tick_ms} milliseconds")


def tick_stream(tests: DataFrame, tick_ms: int, window_ms: int, watermark: str = "0 seconds") -> DataFrame:
    """A stream of (closes, tick_ts, agent_id, pass_rate, flaky_rate, event_count); a row comes when the watermark has passed its tick."""
    timed, window = _at_ticks(tests, tick_ms, window_ms, watermark)
    share = lambda v: F.avg((F.col("result") == v).cast("double"))
    rows = timed.groupBy(window.alias("window"), "agent_id").agg(share("pass").alias("pass_rate"), share("flaky").alias("flaky_rate"), F.count("*").alias("event_count"))
    return rows.select(F.window_time("window").alias("closes"), (F.unix_millis("window.end") - 1).alias("tick_ts"), "agent_id", "pass_rate", "flaky_rate", "event_count")


def domain_stream(tests: DataFrame, tick_ms: int, window_ms: int, watermark: str = "0 seconds") -> DataFrame:
    """A stream of (closes, tick_ts, domain, covered_bits, gap) for every domain at every tick that sees an event.

    The distinct bits of a window are four longs in the state store, however many events it has.
    """
    timed, window = _at_ticks(tests, tick_ms, window_ms, watermark)
    word = lambda i: F.aggregate(F.filter("areas", lambda b: F.floor(b / 64) == i), F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))))
    words = timed.select("at", *[word(i).alias(f"b{i}") for i in range(4)])
    rows = words.groupBy(window.alias("window")).agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(4)])
    every = F.array(*[F.struct(F.lit(n).alias("domain"), _count_bits(lo, hi).cast("long").alias("covered_bits"), F.lit(t).alias("required")) for n, lo, hi, t in DOMAINS])
    rows = rows.select(F.window_time("window").alias("closes"), (F.unix_millis("window.end") - 1).alias("tick_ts"), F.inline(every))
    return rows.select("closes", "tick_ts", "domain", "covered_bits", F.greatest(F.col("required") - F.col("covered_bits"), F.lit(0)).cast("long").alias("gap"))


def _count_bits(lo: int, hi: int) -> Any:
    out = F.lit(0)
    for i in range(4):
        a, b = max(lo, 64 * i), min(hi, 64 * i + 63)
        if a <= b:
            mask = ((1 << (b - a + 1)) - 1) << (a - 64 * i)
            mask -= 1 << 64 if mask >= 1 << 63 else 0
            out = out + F.bit_count(F.col(f"b{i}").bitwiseAND(F.lit(mask).cast("long")))
    return out


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values("tick_ts")


class AgentRules(StatefulProcessor):
    """Regression and replay rules of one agent, and its silence."""

    def __init__(self, rules: Rules, deltas: list[tuple[int, float | None]], resets: list[int], silent_ms: int | None):
        self.rules, self.deltas, self.resets, self.silent_ms = rules, deltas, resets, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("agent", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *known, last, done = self.kept.get() if self.kept.exists() else (None, 0, 0, False, 0, False, None, False, BEGINNING, 0)
        state, out = AgentState(*known), []
        for ts, rate, count in _ordered(rows)[["tick_ts", "pass_rate", "event_count"]].itertuples(index=False):
            while done < len(self.resets) and self.resets[done] < ts:
                state.reset()
                done += 1
            delta = next((d for since, d in reversed(self.deltas) if since <= ts), None)
            said = state.tick(int(ts), float(rate), int(count), self.rules, delta)
            if said["fired_ar"]:
                out.append((int(ts), "rerouteSchema", key[0], None, None, None, None, None))
            if said["fired_rc"]:
                asked = said["dip_start"] - self.rules.pad_ms, int(ts) + self.rules.pad_ms
                out.append((int(ts), "replayRequest", key[0], *asked, brain.FINE_SCOPE, self.rules.fine_ms, ",".join(brain.FINE_GROUPS)))
            last = int(ts)
        self.kept.update((*(getattr(state, f) for f in AgentState.__dataclass_fields__), last, done))
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.silent_ms)
        yield _decisions(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _decisions([(self.kept.get()[8] + self.silent_ms, "blind", key[0], None, None, None, None, None)])

    def close(self) -> None:
        pass


class DomainRules(StatefulProcessor):
    """The coverage rule of one domain: a gap above the bar for so many ticks in a row, once an episode. Ticks that saw nothing cover nothing."""

    def __init__(self, rules: Rules, tick_ms: int):
        self.rules, self.tick_ms = rules, tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("domain", "run int, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run, last = self.kept.get() if self.kept.exists() else (0, None)
        out = []
        for ts, gap in _ordered(rows)[["tick_ts", "gap"]].itertuples(index=False):
            missed = 0 if last is None else (int(ts) - last) // self.tick_ms - 1
            bad = gap > self.rules.gap_above
            due = self.rules.gap_ticks - run  # how many more bad ticks fire
            if 0 < due <= missed + bad:
                out.append((int(ts) - (missed + 1 - due) * self.tick_ms, "schemaUpdate", key[0], None, None, None, None, None))
            run, last = (run + missed + 1 if bad else 0), int(ts)
        self.kept.update((min(run, 2**30), last))
        yield _decisions(out)

    def close(self) -> None:
        pass


def _decisions(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_NAMES)
    return frame.astype({c: "Int64" for c in ("tick_ts", "from_ts", "to_ts", "window_ms")})


def deltas_of(history: DataFrame, schema: str) -> list[tuple[int, float | None]]:
    """When which delta came into force, from the registry's history: (since, delta), in order; one entry per write of the schema."""
    at = F.coalesce("at_ms", F.lit(BEGINNING))
    writes = history.where(F.col("scope").isin(f"schema:{schema}", "schema:*"))
    times = writes.select(at.alias("tick_ts")).distinct()
    return [(r["tick_ts"], r["delta"]) for r in brain.with_delta(times, history, schema).orderBy("tick_ts").collect()]  # parameter writes of one schema


def agent_decisions(ticks: DataFrame, rules: Rules = Rules(), deltas: list | None = None, resets: list[int] | None = None, silent_ms: int | None = None) -> DataFrame:
    """The decisions (DECISION) of a :func:`tick_stream`."""
    processor = AgentRules(rules, deltas or [], sorted(resets or []), silent_ms)
    return ticks.groupBy("agent_id").transformWithStateInPandas(processor, DECISION, "append", "eventTime")


def domain_decisions(ticks: DataFrame, tick_ms: int, rules: Rules = Rules()) -> DataFrame:
    """The schemaUpdate decisions of a :func:`domain_stream`."""
    return ticks.groupBy("domain").transformWithStateInPandas(DomainRules(rules, tick_ms), DECISION, "append", "eventTime")


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def start_decisions(decisions: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint_dir: str, **trigger: Any) -> StreamingQuery:
    """Start the query; ``sink(decisions, batch)`` is called for each micro-batch. It must replace what an earlier try of the batch wrote."""
    use_store(decisions.sparkSession)
    return decisions.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"processingTime": "1 second"})).start()


def decisions_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps decisions as JSON lines, a folder for each batch: tried again, a batch replaces its own."""
    return lambda decisions, number: decisions.write.mode("overwrite").json(f"{folder}/batch={number}")


def applying_sink(registry: Registry, events: Callable[[], DataFrame], folder: str, config: Curation = Curation()) -> Callable[[DataFrame, int], None]:
    """A sink that takes the decisions of a micro-batch, applies them and keeps both as JSON lines: decisions, and the tiles of what was replayed.

    A replay writes the lens it asks for to the registry and looks at ``events()``, the retained
    lens events, through it. A batch that is tried again replaces its own files; the registry
    then has its write twice, which changes nothing.
    """

    def sink(decisions: DataFrame, number: int) -> None:
        decisions.write.mode("overwrite").json(f"{folder}/decisions/batch={number}")
        taken = decisions.sparkSession.read.schema(DECISION).json(f"{folder}/decisions/batch={number}")
        turns = apply_decisions(taken, registry, events(), config)  # a micro-batch's decisions, a few rows
        for i, turn in enumerate(t for t in turns if t["applied"]):
            named = turn["tiles"].withColumns({"tick_ts": F.lit(turn["decision"]["tick_ts"]), "subject": F.lit(turn["decision"]["subject"])})
            named.write.mode("overwrite").json(f"{folder}/tiles/batch={number}/turn={i}")
            retention.release(turn["tiles"])

    return sink
