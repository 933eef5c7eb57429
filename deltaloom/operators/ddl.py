"""Schema changes: classification of statements, extraction of what they change, and the strict-mode gate."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.operators.sizes import if_small

_NAME = r'("(?:[^"]|"")+"|[\w$]+)'


def _extract(ddl: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(ddl, pattern, group)
    return F.when(found != "", F.replace(F.regexp_replace(found, r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))


def kind(tag: Column, ddl: Column) -> Column:
    """What a statement does; of an ALTER TABLE the first that matches in the order below."""
    low = F.lower(ddl)
    alter = F.when(low.contains("add constraint") & low.contains("primary key"), "add_primary_key")
    for text in ("rename to", "add column", "alter column", "drop column", "rename column"):
        alter = alter.when(low.contains(text), text.replace(" to", "_table").replace(" ", "_"))
    return (
        F.when(tag == "DROP SCHEMA", "drop_schema")
        .when(tag == "DROP TABLE", "drop_table")
        .when(tag.isin("CREATE TABLE", "CREATE TABLE AS", "SELECT INTO"), "create_table")
        .when(tag == "ALTER TABLE", alter)
    )


def diff(statements: DataFrame) -> DataFrame:
    """``statements`` (tag, ddl) with kind, column, new_name."""
    ddl = F.col("ddl")
    what = kind(F.col("tag"), ddl)
    column = (
        F.when(F.col("kind") == "add_column", _extract(ddl, rf"(?i)add\s+column\s+(?:if\s+not\s+exists\s+)?{_NAME}"))
        .when(F.col("kind") == "drop_column", _extract(ddl, rf"(?i)drop\s+column\s+(?:if\s+exists\s+)?{_NAME}"))
        .when(F.col("kind") == "alter_column", _extract(ddl, rf"(?i)alter\s+column\s+{_NAME}"))
        .when(F.col("kind") == "rename_column", _extract(ddl, rf"(?i)rename\s+column\s+{_NAME}"))
    )
    old_table = _extract(ddl, rf"(?i)alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?(?:{_NAME}\.)?{_NAME}\s+rename\s+to", 2)
    new_name = F.when(F.col("kind") == "rename_table", _extract(ddl, rf"(?i)rename\s+to\s+{_NAME}")).when(
        F.col("kind") == "rename_column", _extract(ddl, rf"(?i)rename\s+column\s+{_NAME}\s+to\s+{_NAME}", 2)
    )
    return statements.withColumn("kind", what).withColumns(
        {"column": column, "new_name": new_name, "old_table": F.when(F.col("kind") == "rename_table", old_table)}
    )


def gate_violations(diffs: DataFrame, rules: DataFrame) -> DataFrame:
    """What strict mode stops at: added or renamed columns that no rule names, and new or renamed tables without any rule
    (``column`` null)."""
    fresh = diffs.filter("kind IN ('add_column', 'rename_column')").select("schema", "table", F.coalesce("new_name", "column").alias("column"))
    tables = diffs.filter("kind IN ('create_table', 'rename_table')").select("schema", F.coalesce("new_name", "table").alias("table"))
    bare = tables.join(if_small(rules.select("schema", "table").distinct()), ["schema", "table"], "left_anti")
    return fresh.join(if_small(rules), ["schema", "table", "column"], "left_anti").unionByName(bare.withColumn("column", F.lit(None).cast("string")))


def as_of(events: DataFrame, history: DataFrame) -> DataFrame:
    """Each event with the version of its table's metadata that was last defined at or before it, null before the first.

    The history is one sorted array a table, broadcast if there are few tables; events are not shuffled then, and a table with
    most of the events is no hot key. An event picks the last entry that is not later."""
    versions = history.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("pos", "version"))).alias("__versions"))
    joined = events.join(if_small(versions), "table", "left")
    before = F.filter("__versions", lambda v: v["pos"] <= F.col("pos"))
    return joined.withColumn("version", F.try_element_at(before, F.lit(-1))["version"]).drop("__versions")


MESSAGE = (
    "ddl string, schema_name string, command_tag string, objects array<struct<type:string,identity:string,schema:string,oid:string,"
    "columns:array<struct<attnum:int,name:string,type:string,nullable:boolean,generated:boolean,identity:string,unique:boolean,default:string>>>>"
)


def parse_message(content: Column) -> Column:
    """The struct of a schema-change message; null for other text."""
    return F.from_json(content, MESSAGE, {"mode": "PERMISSIVE"})


def object_schema(identity: Column) -> Column:
    """Schema of an object's identity; public if it has none."""
    return F.when(identity.contains("."), F.split_part(identity, F.lit("."), F.lit(1))).otherwise(F.lit("public"))


def object_table(identity: Column) -> Column:
    parts = F.split(identity, r"\.")
    return F.when(F.size(parts) == 1, parts[0]).otherwise(parts[1])


def sequence_name(default: Column) -> Column:
    """Name of the sequence that a column's default takes its values from, or null."""
    found = F.regexp_extract(default, r"nextval\('([^']+)'", 1)
    return F.when(found != "", found)


_HEADER = r"^-- Name: .*; Type: ([A-Z ]+);"


def dump_parts(lines: DataFrame, views: tuple[str, ...] = ()) -> DataFrame:
    """``lines`` (n, line) of a schema dump, statement by statement (each on one line), with the ``part`` that restores it:
    main, constraints, views, event_triggers, every (all parts) or dropped. ``views`` names materialised views."""
    line = F.trim("line")
    of_view = F.lit(False)
    for v in views:
        of_view = of_view | F.regexp_extract(line, r"(?i) ON (?:ONLY )?(\S+)", 1).isin(v)
    part = (
        F.when(line.startswith("\\connect"), "every")
        .when(line.rlike(r"(?i)^SECURITY LABEL"), "dropped")
        .when(line.rlike(r"(?i)^CREATE (OR REPLACE )?FUNCTION .*plpgsql_call_handler"), "dropped")
        .when(line.rlike(r"(?i)^CREATE (OR REPLACE )?FUNCTION .*(BEGIN ATOMIC|\)\s+RETURN )"), "views")
        .when(line.rlike(r"(?i)^ALTER TABLE .*(ADD CONSTRAINT|CLUSTER ON|REPLICA IDENTITY|ATTACH PARTITION)"), "constraints")
        .when(line.rlike(r"(?i)EVENT TRIGGER"), "event_triggers")
        .when(line.rlike(r"(?i)^CREATE (OR REPLACE )?(MATERIALIZED )?VIEW .*NULL::"), "main")
        .when(line.rlike(r'(?i)^(CREATE (OR REPLACE )?(MATERIALIZED )?VIEW|CREATE RULE "_RETURN"|(COMMENT ON|ALTER) (MATERIALIZED )?VIEW)'), "views")
        .when(line.rlike(r"(?i)^CREATE (UNIQUE )?INDEX") & of_view, "views")
        .when(line.rlike(r"(?i)^(CREATE (UNIQUE )?INDEX|CREATE (CONSTRAINT )?TRIGGER|COMMENT ON (INDEX|TRIGGER|CONSTRAINT)|ALTER INDEX .* ATTACH)"), "constraints")
        .otherwise("main")
    )
    return lines.filter((line != "") & ~line.startswith("--")).select("n", "line", part.alias("part"))


#: Commands that a dump's statements are kept for, fixed values.
TAGS = (
    "ALTER EXTENSION", "ALTER FUNCTION", "ALTER MATERIALIZED VIEW", "ALTER PROCEDURE", "ALTER SCHEMA", "ALTER SEQUENCE", "ALTER TABLE", "ALTER TYPE",
    "ALTER VIEW", "COMMENT ON", "COMMENT ON COLUMN", "COMMENT ON CONSTRAINT", "COMMENT ON INDEX", "COMMENT ON TABLE", "CREATE CONSTRAINT",
    "CREATE EXTENSION", "CREATE FUNCTION", "CREATE INDEX", "CREATE MATERIALIZED VIEW", "CREATE PROCEDURE", "CREATE SCHEMA", "CREATE SEQUENCE",
    "CREATE TABLE", "CREATE TRIGGER", "CREATE TYPE", "CREATE UNIQUE INDEX", "CREATE VIEW", "DROP EXTENSION", "DROP FUNCTION", "DROP INDEX",
    "DROP MATERIALIZED VIEW", "DROP PROCEDURE", "DROP SCHEMA", "DROP SEQUENCE", "DROP TABLE", "DROP TRIGGER", "DROP TYPE", "DROP VIEW", "GRANT", "REVOKE",
)

#: What a statement is made of: a comment, quoted text or name, a dollar-quoted body, the end, or other characters.
_PIECE = re.compile(
    r"""(?s)(?P<skip>--[^\n]*|/\*.*?\*/|(?m:^\\[^\n]*))|(?P<end>;)|'(?:[^']|'')*'|"(?:[^"]|"")*"|\$(?P<tag>\w*)\$.*?\$(?P=tag)\$|[^'"$;/\\-]+|."""
)


def split_statements(text: str) -> list[str]:
    """Statements of a dump without their semicolons, one that is unfinished at the end left out. Comments and lines of backslash
    commands go; quoted and dollar-quoted text is kept as it is."""
    out: list[str] = []
    parts: list[str] = []
    for piece in _PIECE.finditer(text):
        if piece["end"]:
            out.append("".join(parts).strip())
            parts = []
        elif not piece["skip"]:
            parts.append(piece[0])
    return [s for s in out if s]


def dump_statements(dumps: DataFrame) -> DataFrame:
    """Statements (source, n, tag, statement) of whole dumps (source, text) with a known tag; none of a null text."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_statements(t or ""))

    found = dumps.select("source", F.posexplode(split("text")).alias("n", "statement"))
    plain = F.upper(F.regexp_replace(F.regexp_replace("statement", r"\s+", " "), r"(?i)^CREATE OR REPLACE ", "CREATE "))
    tag = F.coalesce(*[F.when(plain.startswith(f"{t} "), t) for t in sorted(TAGS, key=len, reverse=True)])
    return found.select("source", F.col("n").cast("long").alias("n"), tag.alias("tag"), "statement").filter("tag IS NOT NULL")
