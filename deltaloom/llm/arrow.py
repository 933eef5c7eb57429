"""Arrow plumbing that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deltaloom.llm.shared import bound_batches


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Return the memory that this process has freed to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives back what it freed: workers outlive tasks, and idle ones count as well."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


_SIMPLE = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
}


def schema(columns: str) -> T.StructType:
    """A schema of simple types from "name type, ..."; unlike a DDL parse it needs no session, so workers can use it."""
    return T.StructType([T.StructField(name, _SIMPLE[kind]) for name, kind in (x.split() for x in columns.split(","))])


def map_rows(
    df: DataFrame, inputs: list[str], outputs: str, rows: Callable[[dict[str, list]], dict[str, list]], rows_at_once: int = 256
) -> DataFrame:
    """Replace ``df`` by ``outputs`` (a DDL schema), made by ``rows`` from small batches of ``inputs``.

    ``rows`` gets a list for each input column, strings as UTF-8 bytes or None, and gives a list for each
    output column. Only ``inputs`` are read, so other columns of ``df`` never reach Python. Every batch holds
    ``rows_at_once`` rows at most and is emitted before the next is touched.
    """
    made_of = T.StructType.fromDDL(outputs)
    arrow = to_arrow_schema(made_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                got = {}
                for name, column in zip(inputs, batch.columns, strict=True):
                    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
                    got[name] = (column.cast(pa.large_binary()) if text else column).to_pylist()
                made = rows(got)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)

    bound_batches(df.sparkSession)
    return df.select(*[df[name] for name in inputs]).mapInArrow(tidy(run), made_of)


def add_columns(
    df: DataFrame, inputs: list[str], outputs: str, rows: Callable[[dict[str, list]], dict[str, list]], rows_at_once: int = 256
) -> DataFrame:
    """``df`` with ``outputs`` after its own columns, which pass through as they are; columns named like an output, in any
    case, are replaced. ``inputs`` are read before that."""
    names = {f.name.lower() for f in T.StructType.fromDDL(outputs)}
    if clashing := [c for c in df.columns if c.lower() in names]:
        spare = {c: f"__in{i}" for i, c in enumerate(inputs) if c in clashing}
        df = df.withColumns({new: df[c] for c, new in spare.items()}).drop(*clashing)
        out = add_columns(df, [spare.get(c, c) for c in inputs], outputs, lambda got: rows({c: got[spare.get(c, c)] for c in inputs}), rows_at_once)
        return out.drop(*spare.values())
    bound_batches(df.sparkSession)
    made_of = T.StructType([*df.schema.fields, *T.StructType.fromDDL(outputs).fields])
    arrow = to_arrow_schema(made_of)
    places = [df.columns.index(name) for name in inputs]
    new = [f for f in to_arrow_schema(T.StructType.fromDDL(outputs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                got = {}
                for name, place in zip(inputs, places, strict=True):
                    column = batch.column(place)
                    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
                    got[name] = (column.cast(pa.large_binary()) if text else column).to_pylist()
                made = rows(got)
                arrays = [*batch.columns, *[pa.array(made[f.name], type=f.type) for f in new]]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(tidy(run), made_of)
