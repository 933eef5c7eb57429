"""Row changes applied to tables as set operations: last writer wins, first writer wins, truncation, key changes, runs.

Changes are rows of (action I/U/D/T, pos, key columns, value columns). Keys compare null-safely where an identity may hold a
null. One shuffle by key does each merge; hot keys are reduced before it, as max_by aggregates partially.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.operators.sizes import if_small

ORDER = ("pos", "seq")


def _order(changes: DataFrame, rest: list[str]) -> Column:
    return F.struct(*[c for c in ORDER if c in changes.columns], F.xxhash64(*rest).alias("__tie"))


def after_truncate(changes: DataFrame, table: list[str] | None = None) -> DataFrame:
    """Changes after the last truncation of their table."""
    if table:
        last = changes.filter("action = 'T'").groupBy(*table).agg(F.max("pos").alias("__cut"))
        return changes.join(if_small(last), table, "left").filter("action <> 'T' AND (__cut IS NULL OR pos > __cut)").drop("__cut")
    last = changes.agg(F.max(F.when(F.col("action") == "T", F.col("pos"))).alias("__cut"))
    return changes.crossJoin(F.broadcast(last)).filter("action <> 'T' AND (__cut IS NULL OR pos > __cut)").drop("__cut")


def split_key_changes(changes: DataFrame, key: str, old_key: str) -> DataFrame:
    """An update that changes its key as a delete of the old one and an insert of the new."""
    moved = (F.col("action") == "U") & F.col(old_key).isNotNull() & ~F.col(key).eqNullSafe(F.col(old_key))
    new = F.struct(F.when(moved, "I").otherwise(F.col("action")).alias("action"), F.col(key).alias("key"))
    old = F.struct(F.lit("D").alias("action"), F.col(old_key).alias("key"))
    steps = F.when(moved, F.array(old, new)).otherwise(F.array(new))
    rest = [c for c in changes.columns if c not in ("action", key, old_key)]
    return changes.select(*rest, F.explode(steps).alias("s")).select(*rest, F.col("s.action").alias("action"), F.col("s.key").alias(key))


def last_change(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), _order(changes, rest)).alias("r")).select(*keys, "r.*")


def upsert(target: DataFrame | None, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with ``changes``: of each key its last change, gone if that is a delete; other rows stay."""
    last = last_change(changes, keys)
    values = [c for c in changes.columns if c not in ("action", *ORDER)]
    alive = last.filter("action <> 'D'").select(*values)
    if target is None:
        return alive
    return target.join(last.select(*keys), keys, "left_anti").select(*values).unionByName(alive)


def insert_new(target: DataFrame | None, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Inserts that conflict with an earlier row do nothing."""
    values = [c for c in changes.columns if c not in ("action", *ORDER, *keys)]
    first = changes.filter("action = 'I'").groupBy(*keys).agg(F.min_by(F.struct(*values), _order(changes, values or keys)).alias("r")).select(*keys, "r.*")
    return first if target is None else target.unionByName(first.join(target.select(*keys), keys, "left_anti"))


def delete_keys(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` without the rows of deleted keys; a null key matches null."""
    gone = changes.filter("action = 'D'").select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return target.join(gone, on, "left_anti")


def runs(changes: DataFrame, by: list[str], lane: str) -> DataFrame:
    """Runs of consecutive changes of the same table and action within a lane: first and last position and length."""
    order = Window.partitionBy(lane).orderBy("pos")
    key = F.struct(*by)
    marked = changes.withColumn("__new", F.when(key.eqNullSafe(F.lag(key).over(order)), 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(lane, "run", *by).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"))


def chunks(rows: DataFrame, lane: str, order_by: str, size: int) -> DataFrame:
    """Number of the multi-row insert that each row goes to."""
    number = F.row_number().over(Window.partitionBy(lane).orderBy(order_by))
    return rows.withColumn("chunk", F.ceil(number / F.lit(size)).cast("long"))


def sequence_values(changes: DataFrame, table: str, column: str) -> DataFrame:
    """What each table's sequence is set to after its inserts."""
    return changes.filter("action = 'I'").groupBy(table).agg(F.max(column).alias("value"))


def latest_version(documents: DataFrame, id_col: str = "id", version: str = "version") -> DataFrame:
    """External versioning: the highest version of an id wins, and is gone if it is a delete."""
    rest = [c for c in documents.columns if c != id_col]
    best = documents.groupBy(id_col).agg(F.max_by(F.struct(*rest), version).alias("d")).select(id_col, "d.*")
    return best.filter(~F.col("deleted")).drop("deleted")


def needs_text_copy(types: Column) -> Column:
    """Column types that only a text copy can carry."""
    return F.exists(types, lambda t: t.isin("cube", "ltree", "enum"))


def writes(events: DataFrame, valid: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Events to write and dead letters, with what stopped them; strict mode fails on the first dead letter instead."""
    judged = events.withColumn("error", F.when(~F.coalesce(valid, F.lit(False)), F.lit("rejected by the target")))
    if strict:
        fail = F.raise_error(F.lit("strict mode: an event was rejected by the target"))
        return judged.filter(F.when(F.col("error").isNotNull(), fail.cast("boolean")).otherwise(F.lit(True))).drop("error"), judged.limit(0)
    return judged.filter("error IS NULL").drop("error"), judged.filter("error IS NOT NULL")


def statements(changes: DataFrame, lane: str, size: int = 1000) -> DataFrame:
    """The statement that each change of a lane goes to: runs of inserts and of deletes are cut at ``size``, updates,
    truncations and schema changes stand alone."""
    order = Window.partitionBy(lane).orderBy("pos")
    alone = F.col("action").isin("U", "T", "DDL")
    run = F.sum(F.when(alone | ~F.col("action").eqNullSafe(F.lag("action").over(order)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = changes.withColumn("__run", run)
    place = F.row_number().over(Window.partitionBy(lane, "__run").orderBy("pos"))
    return numbered.withColumn("part", F.floor((place - 1) / F.lit(size)).cast("long")).withColumnRenamed("__run", "run")


def writable(columns: Column, action: Column) -> Column:
    """Columns of a write: generated ones never, those that are always an identity not in updates."""
    return F.filter(columns, lambda c: (c["generated"] != "stored") & ~((action == "U") & (c["identity"] == "always")))


def typed_value(kind: Column, value: Column) -> Column:
    """Values as a target takes them: infinite times by name, empty ranges, JSON without spaces around it, whole numbers without
    a fraction."""
    infinite = F.when(F.lower(value).isin("infinity", "inf", "+infinity"), "infinity").when(F.lower(value).isin("-infinity", "-inf"), "-infinity")
    return (
        F.when(kind.isin("timestamp", "timestamptz", "date"), F.coalesce(infinite, value))
        .when(kind.endswith("range"), F.when(F.regexp_replace(value, r"\s", "").rlike(r"^[(\[]([^,]+),\1\)$"), F.lit("empty")).otherwise(F.regexp_replace(value, r"\s", "")))
        .when(kind.isin("json", "jsonb"), F.trim(value))
        .when(kind.isin("int2", "int4", "int8"), F.regexp_replace(value, r"\.0+$", ""))
        .otherwise(value)
    )
