"""Identity of tables and columns for events, and cleaning of values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.operators.sizes import if_small


def column_id(table_id: Column, number: Column) -> Column:
    return F.concat_ws("-", table_id, number.cast("string"))


def identity(columns: Column) -> Column:
    """Key columns in order of number; without a key the first unique column that cannot be null."""
    ordered = F.array_sort(columns, lambda a, b: F.when(a["attnum"] < b["attnum"], -1).when(a["attnum"] > b["attnum"], 1).otherwise(0))
    keys = F.filter(ordered, lambda c: c["primary"])
    unique = F.slice(F.filter(ordered, lambda c: c["unique"] & ~c["nullable"]), 1, 1)
    return F.when(F.size(keys) > 0, keys).otherwise(unique)


def inject(events: DataFrame, tables: DataFrame) -> DataFrame:
    """Events with table_id, identity column ids, all column ids and ``outcome``: ok, no_identity (of the table) or
    unknown_table. Tables are told apart by schema and name, and no event is lost."""
    at = lambda columns: F.transform(columns, lambda c: column_id(F.col("table_id"), c["attnum"]))
    known = tables.select("schema", "table", "table_id", at(identity(F.col("columns"))).alias("identity_ids"), at(F.col("columns")).alias("column_ids"))
    outcome = F.when(F.col("table_id").isNull(), "unknown_table").when(F.size("identity_ids") > 0, "ok").otherwise("no_identity")
    return events.join(if_small(known), ["schema", "table"], "left").withColumn("outcome", outcome)


def without_views(events: DataFrame, views: DataFrame) -> DataFrame:
    """Events without those of materialised views (schema, table)."""
    return events.join(if_small(views.select("schema", "table").distinct()), ["schema", "table"], "left_anti")


def without_internal(events: DataFrame, schema: str) -> DataFrame:
    """Events without row changes of the engine's own schema; its messages stay."""
    return events.filter((F.col("schema") != schema) | (F.col("action") == "M") | F.col("schema").isNull())


def pinned(table: DataFrame, columns: list[str]) -> DataFrame:
    """The captured columns that the table still has, in the captured order; none is an error."""
    still = [c for c in columns if c in table.columns]
    if not still:
        raise ValueError(f"none of the captured columns is left: {columns}")
    return table.select(*still)


def sanitize(c: Column) -> Column:
    """Without the character U+0000, which text columns cannot hold."""
    return F.replace(c, F.chr(F.lit(0)), F.lit(""))


def row_id(*key: Column) -> Column:
    """An id of 20 characters (0-9a-v) for a row from its key: 96 bits of a hash, so that reruns agree."""
    bits = F.concat(F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x1e")) for k in key]), 256), 1, 24), F.lit("0"))
    return F.concat(*[F.lpad(F.lower(F.conv(F.substring(bits, 1 + 5 * i, 5), 16, 32)), 4, "0") for i in range(5)])
