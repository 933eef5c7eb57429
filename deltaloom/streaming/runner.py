"""Changes applied as a stream: each micro-batch is merged into a table by key, so that stream and batch agree.

The table keeps the last change of each key with its position, deletes too, so an older change that comes late changes nothing.
Rows lie in ``buckets`` by a hash of the key; a batch rewrites the buckets that it touches as version ``batch_id`` and then writes
which version of each bucket counts (``pointers``). A batch that runs again writes the same again; versions that no pointer of
the last two batches names are deleted.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.operators.apply import last_change

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Version of each bucket as of the last batch (before ``before``)."""
    at, fs = _fs(spark, f"{path}/pointers")
    if not fs.exists(at):
        return {}
    done = [int(f.getPath().getName()[1:]) for f in fs.listStatus(at) if f.getPath().getName().startswith("v") and fs.exists(_fs(spark, f"{f.getPath()}/_SUCCESS")[0])]
    done = [v for v in done if before is None or v < before]
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/pointers/v{max(done)}").collect()} if done else {}


def _rows(spark: SparkSession, path: str, buckets: dict[int, int]) -> DataFrame | None:
    if not buckets:
        return None
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/version={v}/bucket={b}" for b, v in sorted(buckets.items())]).drop("version")


def merge_batch(path: str, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changes = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = sorted(r[0] for r in changes.select("bucket").distinct().collect())  # at most ``buckets``
        before = _pointers(spark, path, batch_id)
        old = _rows(spark, path, {b: v for b, v in before.items() if b in touched})
        both = changes if old is None else changes.unionByName(old)
        last = last_change(both, [*keys, "bucket"]).select(*changes.columns)
        last.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={batch_id}")
        now = before | dict.fromkeys(touched, batch_id)
        rows = spark.createDataFrame(sorted(now.items()), "bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/pointers/v{batch_id}")
        changes.unpersist()
        for b, v in before.items():
            if now[b] != v and v != batch_id:
                at, fs = _fs(spark, f"{path}/data/version={v}/bucket={b}")
                if v < batch_id - 1:
                    fs.delete(at, True)

    return merge


def run_available(changes: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """Apply all that a streaming frame of changes (action, pos, keys, values) holds now."""
    query = changes.writeStream.foreachBatch(merge_batch(path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def without_repeats(events: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """A stream without events that a snapshot and the log both gave, with state bounded by a watermark."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last batch."""
    rows = _rows(spark, path, _pointers(spark, path))
    return rows.filter("action <> 'D'").drop("action", "pos", "seq", "bucket")
