"""Log positions: text and number forms, checkpoints (largest position wins), zero positions, offsets of a topic."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lsn_number(lsn: Column) -> Column:
    """``hi/lo`` in hex to one number; null for other text."""
    high, low = (F.conv(F.split_part(lsn, F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)") for i in (1, 2))
    return F.when(lsn.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), (high * F.lit(4294967296).cast("decimal(20,0)") + low).cast("decimal(20,0)"))


def lsn_text(number: Column) -> Column:
    n = number.cast("long")
    return F.concat(F.hex(F.shiftrightunsigned(n, 32)), F.lit("/"), F.hex(n.bitwiseAND(F.lit(0xFFFFFFFF))))


def checkpoint(events: DataFrame, position: str = "lsn_num") -> DataFrame:
    """The largest position that is not zero."""
    return events.filter(F.col(position) > 0).agg(F.max(position).alias("checkpoint"))


def topic_checkpoints(events: DataFrame) -> DataFrame:
    """Largest offset of each topic and partition."""
    return events.groupBy("topic", "partition").agg(F.max("offset").alias("offset"))


def parse_offset(position: Column) -> Column:
    """``topic/partition/offset`` to a struct; null unless it has exactly three parts."""
    part = lambda i: F.split_part(position, F.lit("/"), F.lit(i))
    ok = position.rlike("^[^/]+/[0-9]+/[0-9]+$")
    return F.when(ok, F.struct(part(1).alias("topic"), part(2).cast("int").alias("partition"), part(3).cast("long").alias("offset")))
