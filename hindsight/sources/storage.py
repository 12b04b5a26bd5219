"""Tables that outlive a job: a folder that driver and executors share, and its files."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where none is named and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="hindsight-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named}/{label}-{uuid.uuid4().hex}"


class Folder:
    """Files of a folder on any file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._new(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        """Names in the folder, sorted; a missing folder has none."""
        at = self._new(f"{self.path}/{below}" if below else self.path)
        return sorted(f.getPath().getName() for f in self._files.listStatus(at)) if self._files.exists(at) else []

    def delete(self, name: str) -> None:
        self._files.delete(self._new(f"{self.path}/{name}"), True)

    def write(self, name: str, value: dict[str, Any]) -> None:
        """A small JSON file; an earlier one of that name goes."""
        out = self._files.create(self._new(f"{self.path}/{name}"), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def read(self, name: str) -> dict[str, Any] | None:
        at = self._new(f"{self.path}/{name}")
        if not self._files.exists(at):
            return None
        return json.loads(self.spark.read.option("wholetext", True).text(str(at)).first()[0])


def read_table(spark: SparkSession, paths: list[str], schema: Any) -> DataFrame:
    """The Parquet files of ``paths``; an empty table if there are none."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
