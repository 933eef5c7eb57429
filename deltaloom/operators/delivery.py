"""What sinks do with events: bulk ingest, flushes in order, resends, subscriptions, classes of errors, phases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that positions are dealt to.
_RANGES = 64


def bulk_ingest(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that a bulk load takes, the inserts, and the events that it must report as lost (all others)."""
    insert = F.coalesce(F.col("action") == "I", F.lit(False))
    return events.filter(insert), events.filter(~insert)


def row_counts(asked: DataFrame, written: DataFrame, by: str) -> DataFrame:
    """Tables (``by``, asked, written) of which not all rows arrived."""
    a = asked.groupBy(by).agg(F.count(F.lit(1)).alias("asked"))
    w = written.groupBy(by).agg(F.count(F.lit(1)).alias("written"))
    joined = a.join(w, by, "left").select(by, "asked", F.coalesce("written", F.lit(0)).cast("long").alias("written"))
    return joined.filter("asked <> written")


def _bounds(df: DataFrame, order: str) -> list:
    """At most ``_RANGES`` - 1 values of ``order`` that part it in ranges of about as many rows: quantiles of the values with the
    smallest hashes, a pure function of the rows."""
    some = df.filter(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order)).limit(64 * _RANGES)
    found = [r[0] for r in some.orderBy(order).collect()]
    out: list = []
    for x in (found[i * len(found) // _RANGES] for i in range(1, _RANGES) if found):
        if not out or x > out[-1]:  # as literals too: an hour that clocks repeat, or no number, must not turn their order
            out.append(x)
    return out


def _range(value: Column, bounds: list, first: int = 0) -> Column:
    """The number of ``bounds`` (ascending) at or below ``value``, by halves."""
    if not bounds:
        return F.lit(first)
    at = len(bounds) // 2
    return F.when(value < F.lit(bounds[at]), _range(value, bounds[:at], first)).otherwise(_range(value, bounds[at + 1 :], first + at + 1))


def flushes(events: DataFrame, lane: str, barrier: Column, order: str = "pos") -> DataFrame:
    """Events with ``flush``, the number of barriers of their lane (schema changes and truncates, themselves included) up to
    them: writes of one number go out together, a barrier before the writes that follow it. Events of one position pass each
    other's barriers; those without a position come last.

    Positions are dealt to ranges, so that a lane with most of the events is no hot key. A range of a lane is summed in order from
    a row with the barriers of the ranges before it, however many barriers there are. Bounds of ranges are found at once."""
    bounds = _bounds(events, order)
    place = F.when(F.col(order).isNull(), len(bounds) + 1).otherwise(_range(F.col(order), bounds))
    placed = events.withColumns({"__range": place, "__n": F.coalesce(barrier, F.lit(False)).cast("long")})
    earlier = Window.partitionBy(lane).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(lane, "__range").agg(F.sum("__n").alias("__n"))
    before = sums.withColumn("__n", F.sum("__n").over(earlier)).filter("__n > 0").withColumn("__before", F.lit(True))
    rows = placed.withColumn("__before", F.lit(False)).unionByName(before, allowMissingColumns=True)
    passed = F.sum("__n").over(Window.partitionBy(lane, "__range").orderBy(F.asc_nulls_first(order)).rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("flush", passed).filter("NOT __before").drop("__range", "__n", "__before")


def resends(failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of failed documents (severity: retriable, data_loss, none) those to send again and those that are dropped."""
    return failures.filter("severity = 'retriable'"), failures.filter("severity = 'data_loss'")


def send(documents: DataFrame, store: Callable[[DataFrame], DataFrame], attempts: int, key: str = "id") -> DataFrame:
    """Documents (``key``, severity) that ``store`` did not take in at most ``attempts`` rounds; it writes documents and returns
    its failures. Only retriable ones go again. Failures are checkpointed, so that no round is written twice."""
    dropped = None
    todo = documents
    for _ in range(attempts):
        failed = store(todo).select(key, "severity").checkpoint()
        again, lost = resends(failed)
        dropped = lost if dropped is None else dropped.unionByName(lost)
        if again.isEmpty():
            return dropped
        todo = documents.join(again.select(key), key, "left_semi")
    return dropped.unionByName(again) if dropped is not None else documents.limit(0).select(key, F.lit("").alias("severity"))


def subscriptions(requests: DataFrame) -> DataFrame:
    """The store after ``requests`` (url, schema, table, types, action: subscribe or unsubscribe, pos): the last of each url, schema
    and table counts, a null name being the empty one, which stands for all."""
    named = requests.withColumns({c: F.coalesce(c, F.lit("")) for c in ("schema", "table")})
    last = named.groupBy("url", "schema", "table").agg(F.max_by(F.struct("action", "types"), "pos").alias("last"))
    return last.filter("last.action = 'subscribe'").select("url", "schema", "table", "last.types")


#: Classes of SQLSTATE codes, and of their first two characters, fixed values.
CODES = {
    "relation_missing": ("42703", "42704", "42883", "42P01", "42P02"),
    "syntax": ("42000", "42601"),
    "rule_violation": ("42809", "42939", "428C9"),
    "permission_denied": ("42501",),
    "precondition_failed": ("55000",),
    "feature_not_supported": ("0A000",),
    "relation_exists": ("42701", "42710", "42712", "42723", "42P03", "42P04", "42P05", "42P06", "42P07"),
}
CLASSES = {"data_exception": "22", "constraint_violation": "23", "limit_exceeded": "54"}


def error_class(code: Column, message: Column) -> Column:
    """Class of a database error; ``other`` where none fits, null without a code."""
    out = F.when(code.isNull(), F.lit(None).cast("string"))
    out = out.when((code == "XX000") & F.coalesce(F.contains(message, F.lit("cache lookup failed")), F.lit(False)), "cache_lookup_failed")
    for name, codes in CODES.items():
        out = out.when(code.isin(*codes), name)
    for name, start in CLASSES.items():
        out = out.when(code.startswith(start), name)
    return out.otherwise("other")


def phase(position: Column) -> Column:
    """``snapshot`` for rows at the zero position, else ``replication``."""
    return F.when(position == 0, "snapshot").otherwise("replication")
