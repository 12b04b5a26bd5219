"""Pieces the operators share: intermediate tables, components of a link table, let-bindings."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space, tab, \n, \v, \f, \r.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = "[ \\t-\\r]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is named and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="hindsight-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(written: DataFrame) -> None:
    """Delete the files of a table from :func:`materialise` that no later read needs."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(body: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task body that gives its worker's memory back when it ends; workers live on and are shared by all stages."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from body(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)

    return run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of anything but the six spaces; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """Smallest id reachable from every id in ``links(a, b)``.

    Alternating large-star and small-star passes; each halves the distance to the
    smallest id at least and holds one row per link. A hub's links are joined with one
    number, its smallest neighbour, as a stream; no task holds them.
    Self-links, repeated and null links are ignored; no links give no rows.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )
    while True:
        # done when an id with a smaller neighbour has no other neighbour: the next pass would change nothing
        end = lambda c, n: F.struct(F.col(c).alias("id"), F.lit(n).alias("smaller"))
        ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("end")).groupBy("end.id").agg(F.sum("end.smaller").alias("smaller"), F.count("*").alias("all"))
        if ends.where("smaller > 0 and all > 1").agg(F.count("*")).first()[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        last = edges
        edges = materialise(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct(), label
        )
        discard(last)
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
