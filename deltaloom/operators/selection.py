"""Which tables' events pass: include, exclude and schema-only lists with wildcards, for row and schema changes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pattern = tuple[str, str]


def parse(name: str) -> Pattern:
    """``t`` is in schema public; ``s.t``, ``s.*``, ``*.t`` and ``*.*`` are themselves."""
    parts = name.split(".")
    if len(parts) > 2 or not all(parts):
        raise ValueError(f"not a table name or pattern: {name!r}")
    return ("public", parts[0]) if len(parts) == 1 else (parts[0], parts[1])


def matches(patterns: list[Pattern], schema: Column, table: Column) -> Column:
    def one(s: str, t: str) -> Column:
        return (F.lit(True) if s == "*" else schema == s) & (F.lit(True) if t == "*" else table == t)

    return reduce(lambda a, b: a | b, [one(*p) for p in patterns], F.lit(False))


@dataclass(frozen=True)
class Selection:
    include: list[Pattern] = field(default_factory=list)
    exclude: list[Pattern] = field(default_factory=list)
    schema_only: list[Pattern] = field(default_factory=list)

    @classmethod
    def of(cls, include: list[str] = (), exclude: list[str] = (), schema_only: list[str] = ()) -> Selection:
        if include and exclude:
            raise ValueError("include and exclude lists exclude each other")
        if not (include or exclude or schema_only):
            raise ValueError("a selection needs a list")
        return cls([parse(x) for x in include], [parse(x) for x in exclude], [parse(x) for x in schema_only])

    def keeps_rows(self, schema: Column, table: Column) -> Column:
        """Excluded: no. Named in full: yes. Schema only: no. Else what the include list says, if any."""
        exact = [p for p in self.include if "*" not in p]
        rest = matches(self.include, schema, table) if self.include else F.lit(True)
        return (
            F.when(matches(self.exclude, schema, table), False)
            .when(matches(exact, schema, table), True)
            .when(matches(self.schema_only, schema, table), False)
            .otherwise(rest)
        )

    def keeps_table_ddl(self, schema: Column, table: Column) -> Column:
        rest = matches(self.include, schema, table) if self.include else F.lit(True)
        return F.when(matches(self.exclude, schema, table), False).when(matches(self.schema_only, schema, table), True).otherwise(rest)

    def keeps_ddl(self, objects: Column) -> Column:
        """A statement is dropped if any table that it touches is; one without objects is kept."""
        return F.coalesce(F.forall(objects, lambda o: self.keeps_table_ddl(o["schema"], o["table"])), F.lit(True))

    def rows(self, events: DataFrame) -> DataFrame:
        return events.filter(self.keeps_rows(F.col("schema"), F.col("table")))


def skips_object_types(types: Column, excluded: list[str]) -> Column:
    """A statement is skipped only if it has objects and all are of excluded types."""
    return (F.size(types) > 0) & F.forall(types, lambda t: F.lower(t).isin([e.lower() for e in excluded]))


def expand(patterns: list[str], catalog: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Tables (schema, table) of ``catalog`` that the patterns name, without the excluded ones."""
    schema, table = F.col("schema"), F.col("table")
    return catalog.filter(matches([parse(p) for p in patterns], schema, table) & ~matches([parse(p) for p in exclude], schema, table))
