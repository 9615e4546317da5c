"""Where jobs keep what later steps read again: the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session, where one machine is all there is, may lack the setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders written since ``temporary`` began.
WRITTEN: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows once to the shared folder and reads them back: lineage ends there, and a lost
    executor costs no more than the tasks that it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for paths in WRITTEN[-1:]:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame | None) -> None:
    """Removes a table of ``written`` that no later step reads."""
    if df is not None:
        remove(df.sparkSession, df.written_to)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what ``written`` has kept inside: for a step whose own result is written before."""
    WRITTEN.append([])
    try:
        yield
    finally:
        for path in WRITTEN.pop():
            remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast(spark: SparkSession, obj: object) -> Callable[[], object]:
    """Gives a function that loads the object on an executor, where this package may be missing.

    A worker process loads it once: what the object remembers serves that worker's later tasks too.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(obj))

    def load() -> object:
        if not hasattr(held, "loaded"):
            held.loaded = pickle.loads(held.value)
        return held.loaded

    return load
