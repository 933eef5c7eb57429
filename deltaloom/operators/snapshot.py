"""Snapshots: rows as insert events, page ranges, tables still to do."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_inserts(table: DataFrame, schema: str, name: str) -> DataFrame:
    """Each row as an insert at the zero position."""
    return table.select(F.lit("I").alias("action"), F.lit("0/0").alias("lsn"), F.lit(schema).alias("schema"), F.lit(name).alias("table"), "*")


def then_stream(snapshot: DataFrame, changes: DataFrame, start: int) -> DataFrame:
    """A snapshot's rows as inserts at position 0, then the changes after ``start``, the position that the snapshot was taken at:
    applied in order of position they give the table as it is now, and no change is taken twice."""
    rows = snapshot.select(F.lit("I").alias("action"), F.lit(0).cast("long").alias("pos"), "*")
    return rows.unionByName(changes.filter(F.col("pos") > start), allowMissingColumns=True)


def retried(requested: DataFrame, log: DataFrame) -> DataFrame:
    """Tables whose last entry of the log (schema, table, status, at) is a failure: those alone are taken again."""
    last = log.groupBy("schema", "table").agg(F.max_by("status", "at").alias("status")).filter("status = 'failed'")
    return requested.join(last.select("schema", "table"), ["schema", "table"], "left_semi")


def page_ranges(tables: DataFrame, batch_bytes: int) -> DataFrame:
    """Ranges of pages of about ``batch_bytes`` for ``tables`` (table, pages, bytes)."""
    per_page = F.greatest(F.ceil(F.col("bytes") / F.greatest("pages", F.lit(1))), F.lit(1))
    per_range = F.greatest(F.floor(F.lit(batch_bytes) / per_page), F.lit(1)).cast("long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("pages") - 1, F.lit(0)).cast("long"), F.col("per_range")))
    return tables.withColumn("per_range", per_range).select("table", starts.alias("first_page"), "per_range", "pages").select(
        "table", "first_page", F.least(F.col("first_page") + F.col("per_range"), F.col("pages")).cast("long").alias("end_page")
    )


def pending(requested: DataFrame, log: DataFrame) -> DataFrame:
    """Requested tables that no completed entry of the log covers; ``*`` covers a schema's tables."""
    done = log.filter("status = 'completed'")
    exact = requested.join(done.select("schema", "table"), ["schema", "table"], "left_anti")
    return exact.join(done.filter("table = '*'").select("schema"), "schema", "left_anti").select("schema", "table")
