"""Checks before a run: replica identity, uniqueness under transformers, type coverage; subscriptions and deliveries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.operators.sizes import if_small

#: Transformers that can map unlike values to one.
LOSSY = ["masking", "literal_string", "greenmask_boolean", "greenmask_choice", "greenmask_firstname", "neosync_firstname", "neosync_lastname", "neosync_fullname"]
PRESERVING = ["encrypted_aes_siv", "noop"]


def replica_identity(kind: Column, has_key: Column, index_ok: Column) -> Column:
    """Null if updates and deletes carry an identity, else what is wrong."""
    return (
        F.when((kind == "f") | ((kind == "d") & has_key) | ((kind == "i") & index_ok), F.lit(None).cast("string"))
        .when(kind == "d", "no primary key")
        .when(kind == "i", "index not usable")
        .when(kind == "n", "no replica identity")
        .otherwise("unknown replica identity")
    )


def uniqueness(rules: DataFrame, unique_columns: DataFrame) -> DataFrame:
    """Findings (table, column, severity) for transformers on columns of unique indexes, unless the rule allows it."""
    level = F.when(F.col("transformer").isin(LOSSY), "error").when(~F.col("transformer").isin(PRESERVING), "warning")
    joined = rules.filter("NOT allow_uniqueness_loss").join(unique_columns, ["table", "column"])
    return joined.select("table", "column", level.alias("severity")).filter("severity IS NOT NULL").distinct()


def subscriptions_for(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Deliveries (event_id, url): an empty schema or table of a subscription, or no event type, matches all."""
    s = if_small(subscriptions.select("url", F.col("types"), F.col("schema").alias("s_schema"), F.col("table").alias("s_table")))
    on = (
        ((F.col("s_schema") == "") | (F.col("s_schema") == F.col("schema")))
        & ((F.col("s_table") == "") | (F.col("s_table") == F.col("table")))
        & ((F.size("types") == 0) | F.array_contains("types", F.col("action")))
    )
    return events.join(s, on).select("event_id", "url")


#: Types that a database driver reads without further help, fixed values.
READABLE = sorted(
    "aclitem bit bool box bpchar bytea char cid cidr circle date daterange float4 float8 inet int2 int4 int4range int8 int8range interval json jsonb "
    "jsonpath line lseg macaddr name numeric numrange oid path point polygon record text tid time timestamp timestamptz tsrange tstzrange tsvector "
    "unknown uuid varbit varchar xid xml".split()
)


def unsupported_types(columns: DataFrame, also: tuple[str, ...] = ("cube", "hstore", "ltree", "vector")) -> DataFrame:
    """Columns (schema, table, column, type, kind, element_kind) of types that cannot be read; enumerations and arrays of
    readable elements can."""
    bare = F.regexp_replace(F.regexp_replace(F.col("type"), r"^_", ""), r"\[\]$", "")
    enum = (F.col("kind") == "e") | (F.coalesce("element_kind", F.lit("")) == "e")
    return columns.filter(~enum & ~bare.isin(*READABLE, *also)).select("schema", "table", "column", "type")


def deliveries(matched: DataFrame) -> DataFrame:
    """What is posted for each match (event_id, url, lsn, data as JSON): payload, and the position as a key against repeats
    unless there is none."""
    position = F.when((F.col("lsn") != "") & (F.col("lsn") != "0/0"), F.col("lsn"))
    return matched.select("event_id", "url", F.concat(F.lit('{"Data":'), "data", F.lit("}")).alias("payload"), position.alias("idempotency_key"))


def delivery_outcome(status: Column) -> Column:
    """Of an HTTP status, 0 where the network failed: delivered, retry or dropped."""
    return F.when(status.between(200, 299), "delivered").when((status == 0) | (status == 429) | (status >= 500), "retry").otherwise("dropped")


def without_identity(events: DataFrame, selection) -> DataFrame:
    """Updates and deletes without an identity, of tables that the selection keeps."""
    kept = selection.keeps_rows(F.col("schema"), F.col("table"))
    return events.filter(F.col("action").isin("U", "D") & (F.coalesce(F.size("identity"), F.lit(0)) <= 0) & kept)


def label_rules(labels: DataFrame) -> DataFrame:
    """Rules from security labels (schema, table, column, label): MASKED WITH FUNCTION f(parameters) or MASKED WITH VALUE v.
    Parameters are split at every comma, quotes or not."""
    function = F.regexp_extract("label", r"(?is)^\s*MASKED\s+WITH\s+FUNCTION\s+(?:anon\.)?(\w+)\s*\(", 1)
    inside = F.regexp_extract("label", r"(?s)\((.*)\)\s*$", 1)
    value = F.regexp_extract("label", r"(?is)^\s*MASKED\s+WITH\s+VALUE\s+(.*?)\s*$", 1)
    parameters = F.when(F.trim(inside) != "", F.transform(F.split(inside, ","), lambda p: F.regexp_replace(F.trim(p), r"^'(.*)'$", "$1")))
    named = labels.withColumn("transformer", F.when(function != "", F.concat(F.lit("anon_"), F.lower(function))).when(value != "", "literal_string"))
    given = F.when(function != "", parameters).when(value != "", F.array(F.regexp_replace(value, r"^'(.*)'$", "$1")))
    return named.filter("transformer IS NOT NULL").select("schema", "table", "column", "transformer", given.alias("parameters"))


def connection_headroom(servers: DataFrame, demand: Column) -> DataFrame:
    """Servers (server, max_connections, reserved, used) with fewer free connections than ``demand``: (server, needed, available)."""
    free = F.greatest(F.col("max_connections") - F.col("reserved") - F.col("used"), F.lit(0))
    found = servers.select("server", demand.cast("long").alias("needed"), free.cast("long").alias("available"))
    return found.filter("needed > available")


def preflight(**checks: DataFrame) -> DataFrame:
    """Findings of all checks in one table: check, severity (error) and the finding as JSON. No row: all passed."""
    out = None
    for name, findings in checks.items():
        rows = findings.select(F.lit(name).alias("check"), F.lit("error").alias("severity"), F.to_json(F.struct("*")).alias("finding"))
        out = rows if out is None else out.unionByName(rows)
    return out
