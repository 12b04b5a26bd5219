"""The parameter registry: whole-row writes, layered look-ups, an append-only history."""

from __future__ import annotations

import copy
import json
import warnings
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LAYERS, validate_observe
from ..operators.asof import as_of


class Scope(NamedTuple):
    layer: str
    target: str
    view: str | None = None

    def __str__(self) -> str:
        return f"{self.layer}:{self.target}" + (f"#{self.view}" if self.view is not None else "")


def parse_scope(text: str) -> Scope:
    """layer:target[#view]; the first colon and then the first # divide."""
    layer, colon, rest = text.partition(":")
    if not colon:
        raise ValueError(f"scope {text!r} has no layer")
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}")
    target, mark, view = rest.partition("#")
    if not target:
        raise ValueError(f"scope {text!r} has no target")
    return Scope(layer, target, view if mark else None)


class Registry:
    """Rows by scope. A rejected write leaves no trace; listeners run on every accepted one."""

    def __init__(self) -> None:
        self._rows: dict[str, dict[str, Any]] = {}
        self._history: list[tuple[int, str, dict[str, Any]]] = []
        self._times: list[int | None] = []
        self._listeners: list[Callable[[Scope, dict[str, Any]], None]] = []

    def set(self, scope: str, params: dict[str, Any], at_ms: int | None = None) -> None:
        """Replace the row of a scope; ``at_ms`` is the stream's time from which it is in force (null: from the beginning)."""
        parsed = parse_scope(scope)
        if parsed.layer == "observe":
            validate_observe(params)
        self._accept(parsed, copy.deepcopy(params), at_ms)

    def _accept(self, parsed: Scope, kept: dict[str, Any], at_ms: int | None) -> None:
        self._rows[str(parsed)] = kept
        self._history.append((len(self._history) + 1, str(parsed), kept))
        self._times.append(at_ms)
        for listener in list(self._listeners):
            listener(parsed, copy.deepcopy(kept))

    def get_observe(self, schema: str, view: str | None = None) -> dict[str, Any] | None:
        """First row of schema#view, schema, *; rows are never merged."""
        tried = ([f"observe:{schema}#{view}"] if view is not None else []) + [f"observe:{schema}", "observe:*"]
        return next((copy.deepcopy(self._rows[s]) for s in tried if s in self._rows), None)

    def get_pipeline(self, target: str = "*") -> dict[str, Any] | None:
        return copy.deepcopy(self._rows.get(f"pipeline:{target}"))

    def get_schema(self, schema: str) -> dict[str, Any] | None:
        return copy.deepcopy(self._rows.get(f"schema:{schema}", self._rows.get("schema:*")))

    def on_change(self, listener: Callable[[Scope, dict[str, Any]], None]) -> Callable[[], None]:
        self._listeners.append(listener)
        return lambda: self._listeners.remove(listener) if listener in self._listeners else None

    def rows(self) -> list[tuple[int, str, dict[str, Any]]]:
        return copy.deepcopy(self._history)

    def history(self, spark: SparkSession) -> DataFrame:
        """seq, scope, params (JSON), at_ms of every accepted write."""
        rows = [(n, s, json.dumps(p, sort_keys=True), t) for (n, s, p), t in zip(self._history, self._times, strict=True)]
        return spark.createDataFrame(rows, HISTORY)


HISTORY = "seq long, scope string, params string, at_ms long"


class RegistryLog(Registry):
    """A registry whose history is an append-only table in a folder that all sessions share.

    A write is a file named by its sequence number, which can be made once only; whoever comes
    second reads what came first and takes the next number. A new session starts from the
    table, so it resolves what the last one did. A file that was never finished counts for nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder, self._last = spark, folder, 0
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(hadoop.Path(folder))
        self.refresh()

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(HISTORY).json(self.folder).where("seq is not null and scope is not null")

    def refresh(self) -> int:
        """Take in the writes of others since the last look, in order; returns how many."""
        found = self.history(self.spark).where(F.col("seq") > self._last).orderBy("seq").collect()  # writes of parameters since the last look
        for row in found:
            self._last = row["seq"]
            super()._accept(parse_scope(row["scope"]), json.loads(row["params"]), row["at_ms"])
        return len(found)

    def _accept(self, parsed: Scope, kept: dict[str, Any], at_ms: int | None) -> None:
        while True:
            number = max(self._last, self._taken()) + 1
            row = {"seq": number, "scope": str(parsed), "params": json.dumps(kept, sort_keys=True), "at_ms": at_ms}
            try:
                out = self._files.create(self._path(self.folder, f"{number:012d}.json"), False)
            except Exception as refused:  # py4j wraps the file system's answer
                if "AlreadyExists" not in str(refused):
                    raise
                continue
            out.write(bytearray(json.dumps(row).encode()))
            out.close()
            break
        self.refresh()

    def _taken(self) -> int:
        """The largest number in use, unfinished files too."""
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(self.folder))]
        return max((int(n[:12]) for n in names if n[:12].isdigit()), default=0)


def resolve(history: DataFrame, looks: DataFrame, field: str) -> DataFrame:
    """``looks(schema, view)`` with ``field`` (JSON text) of the observe row that was in force for each at last.

    ``history`` is :meth:`Registry.history`. The last write of a scope counts; view, schema and * are tried in this order.
    """
    last = history.groupBy("scope").agg(F.max_by("params", "seq").alias("params"))
    schema, view = F.col("schema"), F.col("view")
    tried = [F.concat(F.lit("observe:"), schema, F.lit("#"), view), F.concat(F.lit("observe:"), schema), F.lit("observe:*")]
    wanted = looks.distinct().select("schema", "view", F.posexplode(F.array(*tried)).alias("place", "scope")).where("scope is not null")
    found = wanted.join(last, "scope").groupBy("schema", "view").agg(F.min_by("params", "place").alias("params"))
    same = F.col("l.schema").eqNullSafe(F.col("f.schema")) & F.col("l.view").eqNullSafe(F.col("f.view"))
    return looks.alias("l").join(found.alias("f"), same, "left").select("l.schema", "l.view", F.get_json_object("f.params", f"$.{field}").alias(field))


def in_force(ticks: DataFrame, history: DataFrame, scopes: tuple[str, ...], name: str = "params") -> DataFrame:
    """``ticks`` with the JSON row that was in force at ``tick_ts`` for the first of ``scopes`` that had one.

    An as-of join by time, writes of equal time by sequence: a later write changes no earlier tick.
    """
    out = ticks
    timed = history.withColumn("at_ms", F.coalesce("at_ms", F.lit(BEGINNING)))
    found = [f"_{name}{i}" for i in range(len(scopes))]
    for column, scope in zip(found, scopes, strict=True):
        writes = timed.where(F.col("scope") == scope).select("seq", "at_ms", F.col("params").alias(column))
        out = as_of(out, writes, "tick_ts", "at_ms", (column,), order="seq")
    return out.withColumn(name, F.coalesce(*[F.col(c) for c in found])).drop(*found)


#: Before any event: writes without a time are in force from here on.
BEGINNING = -(2**53)


def bind_window(registry: Registry, apply: Callable[[int], None], schema: str, view: str | None = None) -> Callable[[], None]:
    """Call ``apply(window_ms)`` now and whenever the lens in force changes it."""
    last: list[int | None] = [None]

    def refresh() -> None:
        window = (registry.get_observe(schema, view) or {}).get("window_ms")
        if window is not None and window != last[0]:
            last[0] = window
            apply(window)

    def changed(scope: Scope, _: dict[str, Any]) -> None:
        if scope.layer == "observe" and (scope.target == "*" or scope.target == schema and scope.view in (None, view)):
            refresh()

    refresh()
    return registry.on_change(changed)


def bind_retention(registry: Registry, apply: Callable[[int], None], target: str = "*") -> Callable[[], None]:
    """As bind_window for ``retention_window_ms``; an invalid value warns and the last good one stays."""
    last: list[int | None] = [None]

    def refresh() -> None:
        value = (registry.get_pipeline(target) or {}).get("retention_window_ms")
        if value is None or value == last[0]:
            return
        if not (isinstance(value, (int, float)) and value == value and 0 < value < float("inf")):
            warnings.warn(f"retention_window_ms {value!r} is ignored", stacklevel=2)
            return
        last[0] = value
        apply(value)

    refresh()
    return registry.on_change(lambda scope, _: refresh() if scope.layer == "pipeline" and scope.target == target else None)
