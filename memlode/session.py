"""Session helpers: table loading and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session as tests and the bench use it; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that sorts its own.
TASK_ROWS = 1 << 19


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to tasks of about ``TASK_ROWS`` rows, whatever the number of shuffle partitions and
    however well the rows compress.  It is counted first: for a bare table that reads the footers of its files alone."""
    n = max(-(-df.count() // TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or our own where it is unset and the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/memlode-scratch"
    return root.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Paths that the scopes around the running code own, innermost last.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("memlode_scopes", default=())


class Scratch:
    """Parquet tables in the shared folder that cut lineage.

    Unlike a local checkpoint they survive the loss of any executor, and unlike
    ``checkpoint()`` they stay columnar, so later reads prune columns.  They go at the end of the
    process, or of the innermost ``scope`` around their making.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        atexit.register(self.clear)

    def place(self) -> str:
        """A new path in the shared folder, dropped like a kept table."""
        path = f"{scratch_root(self.spark)}/memlode-{uuid.uuid4().hex}"
        self.paths.append(path)
        for paths in _scopes.get()[-1:]:
            paths.append(path)
        return path

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once; the returned frame reads the written rows."""
        path = self.place()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._memlode_path = path
        return out

    @contextlib.contextmanager
    def scope(self):
        """Drops, at its end, what was kept within by any Scratch, but for the tables given to ``yield``ed function.

        That function keeps a table beyond the scope: the last step of a stage.
        """
        own: list[str] = []
        token = _scopes.set((*_scopes.get(), own))

        def last(df: DataFrame) -> DataFrame:
            out = self.keep(df)
            own.remove(out._memlode_path)
            for paths in _scopes.get()[-2:-1]:
                paths.append(out._memlode_path)
            return out

        try:
            yield last
        finally:
            _scopes.reset(token)
            for path in own:
                drop_path(self.spark, path)

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_memlode_path", None)
        if path in self.paths:
            self.paths.remove(path)
            drop_path(self.spark, path)

    def size(self, df: DataFrame) -> int:
        """Bytes on disk of a kept table."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._memlode_path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    def broadcast_if_small(self, df: DataFrame, limit: int = 8 << 20) -> DataFrame:
        """A kept table with a broadcast hint if it is at most ``limit`` bytes; beyond, the join shuffles."""
        return F.broadcast(df) if self.size(df) <= limit else df

    def clear(self) -> None:
        while self.paths:
            drop_path(self.spark, self.paths.pop())
