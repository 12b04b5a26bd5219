"""Several lenses on one stream: views over the same table of arrivals, looked up in the registry when they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import VALID_COUNT, Lens
from ..operators.lens import _pool, apply_lens, floor_to_window, group_label
from ..plans.registry import Registry
from ..sources.storage import read_table, shared_folder


def through_lenses(events: DataFrame, lenses: dict[str, Lens], tagged: bool = False) -> DataFrame:
    """view and windows for every lens; all of them see all events, or, ``tagged``, those whose column ``view`` names them.

    Lenses on an epoch grid without decay share one scan and one aggregation: an event is
    counted once per view. Others see the events one by one, as their anchors need.
    """
    together = {v: x for v, x in lenses.items() if x.grid == "epoch" and x.decay is None}
    out = None
    if together:
        sound = events.where("ts_ms is not null and value is not null").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        seen = {
            v: F.struct(
                F.lit(v).alias("view"),
                (group_label(F.col("keys"), x.group_by) if x.group_by else F.lit(None).cast("string")).alias("group_label"),
                floor_to_window(F.col("ts_ms"), x.output_ms, F.lit(int(x.origin or 0))).alias("window_start"),
                F.lit(x.output_ms).cast("long").alias("width"),
            )
            for v, x in together.items()
        }
        each = [F.when(F.col("view") == v, s) for v, s in seen.items()] if tagged else list(seen.values())
        keys = ["view", "width", "group_label", "window_start"]
        windows = _pool(sound.select("value", "weight", F.inline(F.array_compact(F.array(*each)))), keys, False)
        grouped = [v for v, x in together.items() if x.group_by]
        mixed = _pool(windows.where(F.col("view").isin(grouped)), ["view", "width", "window_start"], True)
        windows = windows.unionByName(mixed.withColumn("group_label", F.lit(None).cast("string")))
        out = windows.select(
            "view", "group_label", "window_start", (F.col("window_start") + F.col("width")).alias("window_end"), "count",
            (F.col("sum_wv") / F.col("sum_w")).alias("mean"), "sum_sq", "sum_w", "sum_w2", "min_v", "max_v", (F.col("count") >= VALID_COUNT).alias("valid"),
        )
    for v, x in lenses.items():
        if v not in together:
            mine = events.where(F.col("view") == v).drop("view") if tagged else events
            one = apply_lens(mine, x).withColumn("view", F.lit(v))
            out = one if out is None else out.unionByName(one)
    return out


class Arrivals:
    """A table of what was pushed to the views of one schema: a row names the view it is for (null: all that were there) and the push.

    Pushing appends files; the plan of a look is one scan, however much was pushed.
    """

    def __init__(self, events: DataFrame, folder: str | None = None):
        self.spark, self.columns = events.sparkSession, events.schema
        self.folder, self.pushes = folder or shared_folder(self.spark, "arrivals"), 0

    def push(self, events: DataFrame, view: str | None = None) -> None:
        self.pushes += 1
        marked = events.select(*self.columns.names).withColumns({"_for": F.lit(view).cast("string"), "_push": F.lit(self.pushes).cast("long")})
        marked.write.mode("append").parquet(self.folder)

    def rows(self) -> DataFrame:
        if not self.pushes:
            return self.spark.createDataFrame([], self.columns).withColumns({"_for": F.lit(None).cast("string"), "_push": F.lit(0).cast("long")})
        named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.columns)
        return read_table(self.spark, [self.folder], f"{named}, _for string, _push long")


class LensView:
    """The last ``max_events`` arrivals through the lens in force for (schema, view)."""

    def __init__(self, events: DataFrame, registry: Registry, schema: str, view: str, max_events: int = 10_000, arrivals: Arrivals | None = None):
        self.registry, self.schema, self.view, self.max_events = registry, schema, view, max_events
        self.arrivals = arrivals or Arrivals(events)
        self._name = f"{view}@{self.arrivals.pushes}"  # a view that is added again has another
        self._since, self._until = self.arrivals.pushes, None
        self._frozen: Lens | None = None
        self._detached = False
        self.push(events)

    def lens(self) -> Lens | None:
        """Read when asked, so a write takes effect at the next look; after :meth:`detach` the one then in force."""
        if self._detached:
            return self._frozen
        row = self.registry.get_observe(self.schema, self.view)
        return None if row is None else Lens.of(row)

    def push(self, events: DataFrame) -> None:
        if not self._detached:
            self.arrivals.push(events, self._name)

    #: A view that is added late is given its history like any other arrival.
    backfill = push

    def takes(self) -> Column:
        """Whether a row of the arrivals came to this view."""
        common = F.col("_for").isNull() & (F.col("_push") > self._since) & (F.lit(True) if self._until is None else F.col("_push") <= self._until)
        return common | F.coalesce(F.col("_for") == self._name, F.lit(False))

    def held(self) -> DataFrame:
        """A cap on arrivals is what the view is; the rest stays in the retained table."""
        mine = self.arrivals.rows().where(self.takes()).drop("_for", "_push")
        return mine.orderBy(F.col("seq").desc_nulls_last()).limit(self.max_events)

    def windows(self) -> DataFrame | None:
        lens = self.lens()
        return None if lens is None else apply_lens(self.held(), lens)

    def detach(self) -> None:
        self._frozen, self._detached, self._until = self.lens(), True, self.arrivals.pushes


class ObservationOverlay:
    """Views by (schema, view); pushed events go to all views of their schema."""

    def __init__(self, registry: Registry):
        self.registry = registry
        self._views: dict[tuple[str, str], LensView] = {}
        self._arrivals: dict[str, Arrivals] = {}

    def add(self, events: DataFrame, schema: str, view: str, max_events: int = 10_000) -> LensView:
        self.remove(schema, view)
        arrivals = self._arrivals.setdefault(schema, Arrivals(events))
        self._views[schema, view] = LensView(events, self.registry, schema, view, max_events, arrivals)
        return self._views[schema, view]

    def get(self, schema: str, view: str) -> LensView | None:
        return self._views.get((schema, view))

    def keys(self) -> list[tuple[str, str]]:
        return sorted(self._views)

    def push(self, schema: str, events: DataFrame) -> None:
        """Written once, for all views of the schema."""
        if any(s == schema for s, _ in self._views):
            self._arrivals[schema].push(events)

    def remove(self, schema: str, view: str) -> bool:
        found = self._views.pop((schema, view), None)
        if found:
            found.detach()
        return found is not None

    def detach_all(self) -> None:
        for key in self.keys():
            self.remove(*key)

    def windows(self) -> DataFrame | None:
        """All views side by side, each over its own arrivals: the table of a schema is read once for all its views."""
        out = None
        for schema, arrivals in sorted(self._arrivals.items()):
            views = {f"{s}#{n}": v for (s, n), v in sorted(self._views.items()) if s == schema and v.lens() is not None}
            if not views:
                continue
            names = F.array_compact(F.array(*[F.when(v.takes(), F.struct(F.lit(n).alias("view"), F.lit(v.max_events).alias("_most"))) for n, v in views.items()]))
            rows = arrivals.rows().select(*arrivals.columns.names, F.inline(names))
            place = F.row_number().over(Window.partitionBy("view").orderBy(F.col("seq").desc_nulls_last()))
            rows = rows.withColumn("_place", place).where(F.col("_place") <= F.col("_most")).drop("_place", "_most")
            part = through_lenses(rows, {n: v.lens() for n, v in views.items()}, tagged=True)
            out = part if out is None else out.unionByName(part)
        return out
