"""The folder that driver and executors share, for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to Python, whatever the number of its rows. A column's buffer doubles as it grows: up to 4 MB
#: it comes from the pool that the executor keeps, beyond that from malloc, whose arenas hold on to it in each task's thread.
ARROW_BYTES = 2 << 20

#: Spark then drops an execution's shuffle files at its end; a written table needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one becomes it on a single machine, as in tests; on a
    cluster, whose executors could not read it, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="deltaloom-"))
    return sc.getCheckpointDir()


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_BYTES at most in this session, unless it sets a smaller bound itself: rows alone do not bound the
    memory of long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def least_keys(df: DataFrame, key_col: str, n: int, rows: int) -> DataFrame:
    """A sample of ``df``, which has about ``rows`` rows: those with the ``n`` least keys, evenly spread bytes. Only keys below a
    bound under which twice as many rows are expected are ordered, or each partition would send ``n`` rows to the one task that
    orders them. Where many rows share a key the sample may be smaller."""
    if rows > 4 * n:
        bound = (2 * n << 64) // rows
        df = df.filter(F.col(key_col) < F.lit(bytearray(bound.to_bytes(8, "big"))))
    return df.orderBy(key_col).limit(n)


def cut(df: DataFrame) -> DataFrame:
    """``df`` read from a reliable checkpoint, made now."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` read from a Parquet table in the shared folder, made now: smaller than a checkpoint, columns prunable. ``codec``
    is the session's unless given."""
    return _write(df, new_path(df.sparkSession, name), codec)


def _write(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_files(spark: SparkSession, paths: list[str]) -> None:
    """Delete files or folders, wherever Spark reads them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables that an operator drops once nothing that it returns reads them."""

    def __init__(self) -> None:
        self._paths: list[tuple[SparkSession, str]] = []

    def written(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        path = new_path(df.sparkSession, name)
        self._paths.append((df.sparkSession, path))
        return _write(df, path, codec)

    def take(self, other: Scratch) -> None:
        """What ``other`` holds is dropped with this one."""
        self._paths += other._paths
        other._paths = []

    def drop(self) -> None:
        for spark, path in self._paths:
            drop_files(spark, [path])
        self._paths.clear()
