"""Message keys for partitioned targets, their size guard and placement."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(value: Column, characters: str) -> Column:
    """A backslash before each of ``characters`` and before backslashes, so that joined parts can be told apart."""
    return reduce(lambda v, c: F.replace(v, F.lit(c), F.lit("\\" + c)), "\\" + characters, value)


def schema_key(schema: Column) -> Column:
    return escape(schema, ".:")


def table_key(schema: Column, table: Column) -> Column:
    return F.concat(escape(schema, ".:"), F.lit("."), escape(table, ".:"))


def primary_key(schema: Column, table: Column, *values: Column) -> Column:
    """Key by table and the key values; by table alone where a value is missing."""
    joined = F.concat_ws(",", *[escape(v.cast("string"), ",") for v in values])
    whole = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
    return F.when(whole, F.concat(table_key(schema, table), F.lit(":"), joined)).otherwise(table_key(schema, table))


def within_size(df: DataFrame, key: str, value: str, max_bytes: int, percent: int = 95) -> DataFrame:
    """Messages of at most ``percent`` of the largest size; others are dropped, as a broker would refuse them."""
    return df.filter(F.octet_length(key) + F.octet_length(value) <= max_bytes * percent // 100)


def placement(key: Column, partitions: int) -> Column:
    """Partition of a key, by the first 32 bits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(partitions)).cast("int")
