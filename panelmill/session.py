"""Session settings, the shared folder, and the written tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: A side is broadcast up to this many rows, which are counted first; beyond it the join is left to shuffle.
MAX_BROADCAST_ROWS = 200_000


def get_spark(app: str = "panelmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for: UTC, ANSI, adaptive execution."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # some operators run many short steps: their generated code is kept, not compiled anew on every call
        .config("spark.sql.codegen.cache.maxEntries", "2000")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where that setting is absent a folder of our own is made and set, but only if all executors are on this machine
    (tests); elsewhere it is an error, as tables in a machine's own folder would be lost or incomplete.
    """
    at = spark.conf.get(CHECKPOINT_DIR, None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="panelmill-")
        spark.conf.set(CHECKPOINT_DIR, at)
        atexit.register(_remove, spark, at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_OWNERS: list["Tables"] = []


class Tables:
    """Written tables of one owner: those written inside `with tables:` are deleted by tables.clear()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Tables":
        _OWNERS.append(self)
        return self

    def __exit__(self, *_) -> None:
        _OWNERS.remove(self)

    def clear(self) -> None:
        while self.paths:
            _remove(self.spark, self.paths.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside the block are deleted at its end, by when its results must be stored or fetched.

    Without it they stay until the driver ends, as the frames that read them may be run at any time.
    """
    tables = Tables(spark)
    try:
        with tables:
            yield
    finally:
        tables.clear()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed by its owner (Tables, scratch), at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].paths.append(path)
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: shared by several consumers, and
    safe when executors are lost, as the files outlive them."""
    path = table_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df as a broadcast side if it has at most `most` rows, else as it is. Counting runs df: for written or tiny frames."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fetched(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The rows of a frame that is bounded by its nature (dates, groups), run once and held as literal rows to be broadcast;
    one with more than `most` rows is returned as it is."""
    got = df.limit(most + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(got, df.schema)) if got.num_rows <= most else df


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where it lies, whatever folder the driver was started in."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
