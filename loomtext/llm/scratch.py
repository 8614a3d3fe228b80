"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the master is local
(tests, a laptop) a temporary one is made.  A written table cuts the lineage like a reliable checkpoint
does, is compressed and columnar, and survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from typing import Any

from pyspark import Broadcast
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_roots: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for this application's intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="loomtext-"))
    root = f"{base.rstrip('/')}/loomtext-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort: a stopped session leaves the folder to the cluster's own clean-up."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit
        pass


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(spark: SparkSession) -> None:
    """Texts go to Python a thousand at a time, unless the cluster's configuration says otherwise: batches of the
    default size, held by the JVM, by Python and as results, are several times larger than what is worked on."""
    if not spark.sparkContext.getConf().contains(ROWS):
        spark.conf.set(ROWS, 1000)


def unused(df: DataFrame, name: str) -> str:
    """A column's name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def send(spark: SparkSession, value: Any) -> Broadcast:
    """A value for all tasks, pickled as functions are, so that workers need not find this package by themselves."""
    return spark.sparkContext.broadcast(CloudPickleSerializer().dumps(value))


def received(sent: Broadcast) -> Any:
    return CloudPickleSerializer().loads(sent.value)


class Scratch:
    """Tables of one run of an operator; ``drop`` frees those that no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        self.at: dict[int, str] = {}
        lean(spark)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = path
        return out

    def finish(self, df: DataFrame) -> DataFrame:
        """Write a result and read it back; all other tables go."""
        out = self.keep(df)
        own = self.at.pop(id(out))
        for path in self.at.values():
            _remove(self.spark, path)
        self.at = {id(out): own}
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := self.at.pop(id(df), None):
                _remove(self.spark, path)
