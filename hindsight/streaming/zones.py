"""The thinned reference zone of a live table, kept up batch by batch.

An event ages when the newest event is more than the retention after it. Aged events are
numbered in the order they age, batch after batch and by ``seq`` within one; every ratio-th is
kept and stands for ratio events. The number goes on from batch to batch in a small file, and
runs over partitions by offsets: counts per bucket of ``seq``, then ranks inside it. A batch
that is tried again starts from the count of the batch before and replaces its own part; if its
count is there already, it was done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.retention import numbered
from ..sources.storage import Folder, read_table

WIDTH_MS = 3_600_000


class ReferenceZone:
    """Folder of kept events, ``batch=N/bucket=B``, and of counters, ``counters/N.json``."""

    def __init__(self, spark: SparkSession, folder: str, retention_ms: int, reference_ms: int, ratio: int, schema):
        self.spark, self.folder, self.files, self.schema = spark, folder, Folder(spark, folder), schema
        self.retention_ms, self.reference_ms, self.ratio = retention_ms, reference_ms, ratio

    def _counter(self, before: int | None = None) -> dict[str, int | None]:
        """What the last batch (the last below ``before``) left: events aged so far, newest event, newest kept event."""
        done = [int(n.split(".")[0]) for n in self.files.names("counters") if n.endswith(".json")]
        done = [n for n in done if before is None or n < before]
        return self.files.read(f"counters/{max(done)}.json") if done else {"aged": 0, "last": None, "kept": None}

    def age(self, table: DataFrame, arrived: DataFrame, batch: int, last_ms: int | None) -> int:
        """Thin what has aged since the batch before: from ``table`` what was fresh then, from ``arrived`` what came too late to be fresh. Returns how many aged.

        ``table`` holds the fresh events of all batches before this one, with ``bucket``, the WIDTH_MS of their time.
        """
        if self.files.read(f"counters/{batch}.json") is not None:
            return 0  # done by an earlier try, after which what aged may be deleted
        state = self._counter(batch)
        last = max((x for x in (state["last"], last_ms) if x is not None), default=None)
        if last is None:
            return 0
        edge = last - self.retention_ms
        new = arrived.where(F.col("ts_ms") < edge)
        if state["last"] is not None:
            before = state["last"] - self.retention_ms
            span = F.col("bucket").between(before // WIDTH_MS, edge // WIDTH_MS) & (F.col("ts_ms") >= before) & (F.col("ts_ms") < edge)
            new = table.where(span).select(*arrived.columns).unionByName(new)
        rows = numbered(new, state["aged"])
        kept = rows.where(F.col("_i") % self.ratio == 0).drop("_i").withColumn("weight", F.lit(float(self.ratio)))
        at = f"{self.folder}/batch={batch}"
        kept.withColumn("bucket", F.floor(F.col("ts_ms") / WIDTH_MS)).write.mode("overwrite").partitionBy("bucket").parquet(at)
        aged = new.count()
        newest = read_table(self.spark, [at], self.schema).agg(F.max("ts_ms")).first()[0] if self.files.names(f"batch={batch}") != ["_SUCCESS"] else None
        newest = max((x for x in (state["kept"], newest) if x is not None), default=None)
        self.files.write(f"counters/{batch}.json", {"aged": state["aged"] + aged, "last": last, "kept": newest})
        self._forget(newest)
        return aged

    def _forget(self, newest: int | None) -> None:
        """Delete kept buckets that the reference width has let go, batches left empty and counters no retry needs."""
        for name in [n for n in self.files.names() if n.startswith("batch=")]:
            buckets = [b for b in self.files.names(name) if b.startswith("bucket=")]
            old = [b for b in buckets if newest is not None and (int(b.split("=")[1]) + 1) * WIDTH_MS <= newest - self.reference_ms]
            for bucket in old:
                self.files.delete(f"{name}/{bucket}")
            if buckets and len(old) == len(buckets):
                self.files.delete(name)
        for name in sorted((n for n in self.files.names("counters")), key=lambda n: int(n.split(".")[0]))[:-10]:
            self.files.delete(f"counters/{name}")

    def held(self) -> DataFrame:
        """The zone: kept events within the reference width of the newest kept one."""
        newest = self._counter()["kept"]
        paths = [f"{self.folder}/{n}" for n in self.files.names() if n.startswith("batch=") and any(b.startswith("bucket=") for b in self.files.names(n))]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        named = StructType([*self.schema.fields, StructField("bucket", LongType()), StructField("batch", LongType())])
        rows = self.spark.read.option("basePath", self.folder).schema(named).parquet(*paths).drop("bucket", "batch")
        return rows if newest is None else rows.where(F.col("ts_ms") >= newest - self.reference_ms)
