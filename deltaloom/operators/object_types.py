"""Filters of schema statements and dump sections by categories of objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEXT_SEARCH = ("text search configuration", "text search dictionary", "text search parser", "text search template")
#: Types of objects by category, fixed values.
STATEMENTS = {
    "tables": ("table", "table column"),
    "sequences": ("sequence",),
    "types": ("type", "domain"),
    "indexes": ("index",),
    "constraints": ("table constraint",),
    "functions": ("function", "aggregate", "procedure"),
    "views": ("view",),
    "materialized_views": ("materialized view",),
    "triggers": ("trigger",),
    "event_triggers": ("event trigger",),
    "policies": ("policy",),
    "rules": ("rule",),
    "extensions": ("extension",),
    "collations": ("collation",),
    "text_search": _TEXT_SEARCH,
}
#: The same for the sections of a dump, where they differ, fixed values.
SECTIONS = STATEMENTS | {
    "tables": ("table", "default"),
    "sequences": ("sequence", "sequence owned by"),
    "constraints": ("constraint", "fk constraint"),
    "policies": ("policy", "row security"),
    "comments": ("comment",),
}


def excluded(categories: dict[str, tuple[str, ...]], include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> set[str]:
    """Categories left out; ``include`` and ``exclude`` bar each other, unknown names are errors."""
    if include and exclude:
        raise ValueError("include and exclude bar each other")
    if unknown := {*include, *exclude} - categories.keys():
        raise ValueError(f"unknown categories: {sorted(unknown)}")
    return set(categories) - set(include) if include else set(exclude)


def category_of_tag(tag: Column) -> Column:
    """Category of a command tag, matched whole: the object after CREATE, ALTER or DROP; null for other tags."""
    kind = F.lower(F.regexp_extract(tag, r"^(?:CREATE|ALTER|DROP) ([A-Z ]+)$", 1))
    out = F.when(tag.isin("CREATE TABLE AS", "SELECT INTO"), "tables").when(tag == "REFRESH MATERIALIZED VIEW", "materialized_views")
    out = out.when(tag == "ALTER AGGREGATE", F.lit(None).cast("string"))
    for name, types in STATEMENTS.items():
        out = out.when(kind.isin([t for t in types if t != "table column"]), name)
    return out


def skips_statement(types: Column, tag: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a statement is skipped: all of its objects are of excluded types; without objects (null or empty) its tag decides."""
    out = excluded(STATEMENTS, include, exclude)
    gone = [t for c in sorted(out) for t in STATEMENTS[c]]
    by_tag = F.coalesce(category_of_tag(tag).isin(sorted(out)), F.lit(False))
    return F.when(F.coalesce(F.size(types), F.lit(0)) > 0, F.forall(types, lambda t: F.lower(t).isin(gone))).otherwise(by_tag)


def keeps_section(header: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether the section under a dump's header line stays; schemas always do. Null for lines that are no header."""
    kind = F.trim(F.regexp_extract(header, r"^--\s*Name:.*;\s*Type:\s*([^;]+)\s*;", 1))
    gone = [t.upper() for c in sorted(excluded(SECTIONS, include, exclude)) for t in SECTIONS[c]]
    return F.when(kind != "", (kind == "SCHEMA") | ~kind.isin(gone))


def keeps_cleanup(line: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a line of a dump's clean-up (DROP ..., COMMENT ON ...) stays; lines of no category and DROP SCHEMA do."""
    out = excluded(SECTIONS, include, exclude)
    drops = [t.upper() for c in sorted(out) for t in STATEMENTS.get(c, ()) if c not in ("constraints", "text_search") and t != "table column"]
    drops += ["TEXT SEARCH"] if "text_search" in out else []
    gone = F.lit(False)
    for t in drops:
        gone = gone | line.startswith(f"DROP {t} ")
    return ~(gone | line.startswith("COMMENT ON ")) if "comments" in out else ~gone
