"""Changes as search documents: identity, version, body, value and type mapping."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_id(table: str | Column, *values: Column, hashed: bool = False) -> Column:
    """``<table>_<v1>-<v2>``, the value part hashed on request; null if a value is null."""
    joined = F.concat_ws("-", *[v.cast("string") for v in values])
    for v in values[:1]:
        whole = v.isNotNull()
    for v in values[1:]:
        whole = whole & v.isNotNull()
    table = F.lit(table) if isinstance(table, str) else table
    return F.when(whole, F.concat(table, F.lit("_"), F.sha2(joined.cast("binary"), 256) if hashed else joined))


def version(action: Column, position: Column) -> Column:
    """The position, and one more for updates and deletes."""
    return position + F.when(action.isin("U", "D"), F.lit(1)).otherwise(F.lit(0))


def project(changes: DataFrame, table: str, keys: list[str], body: list[str], position: str = "pos") -> DataFrame:
    """Documents (id, version, deleted, body as JSON); changes with a null key have none."""
    fields = body if len(keys) == 1 else [*keys, *body]
    content = F.to_json(F.struct(*fields, F.lit(table).alias("_table")))
    made = changes.select(
        document_id(table, *map(F.col, keys)).alias("id"),
        version(F.col("action"), F.col(position)).alias("version"),
        (F.col("action") == "D").alias("deleted"),
        F.when(F.col("action") != "D", content).alias("body"),
    )
    return made.filter("id IS NOT NULL")


def timestamp_text(ts: Column) -> Column:
    return F.date_format(F.date_trunc("MILLISECOND", ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


#: Search type of each database type, fixed values of the mapping.
SEARCH_TYPES = {
    "integer": ["int2", "int4", "int8", "integer", "smallint", "bigint"],
    "float": ["float4", "float8", "real", "double precision", "float", "numeric"],
    "boolean": ["boolean", "bool"],
    "string": ["bytea", "char", "name", "text", "varchar", "bpchar", "xml", "uuid", "character", "character varying", "cidr", "inet", "macaddr", "macaddr8", "interval"],
    "json": ["json", "jsonb"],
    "date": ["date"],
    "time": ["time", "time without time zone", "time with time zone"],
    "datetime": ["timestamp", "timestamp without time zone"],
    "datetimetz": ["timestamptz", "timetz", "timestamp with time zone"],
}


def search_type(type_name: Column) -> Column:
    """Search type of a database type name; arrays as their element's, parameters ignored, null for unmapped types."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(type_name, r"\[\]$", ""), r"\([^)]*\)", ""))
    out = F.when(bare.rlike(r"^(\w+\.)?vector$"), "vector")
    for kind, names in SEARCH_TYPES.items():
        out = out.when(bare.isin(names), kind)
    return out


def mapping(type_name: Column) -> Column:
    """Field mapping of a database type as JSON, or null."""
    kind = search_type(type_name)
    size = F.regexp_extract(type_name, r"vector\((\d+)\)", 1)
    return (
        F.when(kind == "string", F.lit('{"type":"keyword","fields":{"text":{"type":"text"}}}'))
        .when(kind == "vector", F.concat(F.lit('{"type":"knn_vector","dimension":'), size, F.lit("}")))
        .when(kind == "json", F.lit('{"type":"flat_object"}'))
        .when(kind == "integer", F.lit('{"type":"long"}'))
        .when(kind == "float", F.lit('{"type":"double"}'))
        .when(kind == "boolean", F.lit('{"type":"boolean"}'))
        .when(kind.isNotNull(), F.lit('{"type":"date"}'))
    )


def mapping_changes(columns: DataFrame) -> DataFrame:
    """Fields that an index gains for added or renamed columns (schema, table, table_id, attnum, name, type, change): one for the
    column by its ids, and an alias by its names; a renamed column only gains an alias."""
    field = F.concat_ws("-", "table_id", F.col("attnum").cast("string"))
    alias = F.struct(F.concat_ws(".", "table", "name").alias("field"), F.concat(F.lit('{"type":"alias","path":"'), field, F.lit('"}')).alias("mapping"))
    own = F.struct(field.alias("field"), mapping(F.col("type")).alias("mapping"))
    made = columns.filter(mapping(F.col("type")).isNotNull()).select(
        F.concat(F.col("schema"), F.lit("-1")).alias("index"), F.explode(F.when(F.col("change") == "add", F.array(own, alias)).otherwise(F.array(alias))).alias("f")
    )
    return made.select("index", "f.field", "f.mapping")


def index_actions(diffs: DataFrame) -> DataFrame:
    """What schema changes (schema, table, kind) do to indexes: a dropped schema deletes its index, a dropped table its documents."""
    index = F.concat(F.col("schema"), F.lit("-1"))
    action = F.when(F.col("kind") == "drop_schema", "delete_index").when(F.col("kind") == "drop_table", "delete_documents").when(F.col("kind") == "create_table", "ensure_index")
    made = diffs.select(index.alias("index"), F.col("schema").alias("alias"), F.when(F.col("kind") == "drop_table", F.col("table")).alias("of_table"), action.alias("action"))
    return made.filter("action IS NOT NULL").distinct()


def storable(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that an index takes, and those whose id is longer than its limit of 512 bytes."""
    long_ = F.octet_length("id") > 512
    return documents.filter(~long_), documents.filter(long_)
