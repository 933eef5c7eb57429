"""Sources of changes: a synthetic stream over ``orders``, and NDJSON files of events as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "action string, ts timestamp, lsn string, schema string, `table` string, columns array<struct<id:string,name:string,type:string,value:string>>, identity array<struct<id:string,name:string,type:string,value:string>>, xid bigint, prefix string, content string"


def orders_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order an insert; of every third an update of its status; of every seventh a delete."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    step = lambda action, n: F.struct(F.lit(action).alias("action"), (F.col("o_orderkey") * 4 + n).alias("pos"))
    steps = F.array_compact(F.array(
        step("I", 1), F.when(F.col("o_orderkey") % 3 == 0, step("U", 2)), F.when(F.col("o_orderkey") % 7 == 0, step("D", 3)),
    ))
    status = F.when(F.col("s.action") == "U", "X").otherwise(F.col("o_orderstatus"))
    return orders.withColumn("s", F.explode(steps)).select("s.action", "s.pos", "o_orderkey", "o_custkey", status.alias("o_orderstatus"))


def event_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of events from NDJSON files as they appear in ``path``."""
    return spark.readStream.schema(ENVELOPE).json(path)


def ndjson(events: DataFrame) -> DataFrame:
    """One line of JSON, ``value``, for each event, nulls left out: what a text sink or the console shows."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def write_ndjson(events: DataFrame, path: str) -> None:
    ndjson(events).write.mode("append").text(path)
