"""The engine's queries by name, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.functions import keys as K
from deltaloom.functions import masking as M
from deltaloom.functions import positions as P
from deltaloom.functions import scramble
from deltaloom.operators import apply as A
from deltaloom.operators import checks, ddl, delivery, documents, enrichment, object_types, selection, snapshot
from deltaloom.operators.batching import backoff, drops, lag, lane_batches
from deltaloom.plans.transform import Rule, transform
from deltaloom.sources.change_stream import ndjson, orders_changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_changes(spark, sf_dir)


CHANGES = """WITH c AS (
SELECT 'I' AS action, o_orderkey * 4 + 1 AS pos, o_orderkey, o_custkey, o_orderstatus FROM orders
UNION ALL SELECT 'U', o_orderkey * 4 + 2, o_orderkey, o_custkey, 'X' FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'D', o_orderkey * 4 + 3, o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 7 = 0)
"""
_LAST = CHANGES + ", l AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos DESC) AS rn FROM c)\n"


# --- changes applied to tables


@query(_LAST + "SELECT o_orderkey, o_custkey, repeat('*', length(o_orderstatus)) AS o_orderstatus FROM l WHERE rn = 1 AND action <> 'D'")
def apply_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _changes(spark, sf_dir).withColumns({"schema": F.lit("public"), "table": F.lit("orders")})
    kept = selection.Selection.of(include=["public.orders"]).rows(events).drop("schema", "table")
    masked = transform(kept, [Rule("o_orderstatus", "masking")])
    return A.upsert(None, masked, ["o_orderkey"])


@query(CHANGES + "SELECT o_orderkey, o_custkey, o_orderstatus FROM c WHERE action = 'I'")
def apply_conflict_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.insert_new(None, _changes(spark, sf_dir), ["o_orderkey"])


@query(
    CHANGES + ", t AS (SELECT max(pos) - 4000 AS cut FROM c), l AS (SELECT c.*, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos DESC) AS rn"
    " FROM c, t WHERE pos > cut) SELECT o_orderkey, o_custkey, o_orderstatus FROM l WHERE rn = 1 AND action <> 'D'"
)
def apply_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir)
    cut = changes.agg((F.max("pos") - 4000).alias("pos")).withColumn("action", F.lit("T"))
    return A.upsert(None, A.after_truncate(changes.unionByName(cut, allowMissingColumns=True)), ["o_orderkey"])


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END AS key, o_custkey FROM orders")
def apply_pk_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    none = F.lit(None).cast("long")
    inserts = orders.select(F.lit("I").alias("action"), (F.col("o_orderkey") * 2).alias("pos"), F.col("o_orderkey").alias("key"), none.alias("old"), "o_custkey")
    moves = orders.filter("o_orderkey % 5 = 0").select(
        F.lit("U").alias("action"), (F.col("o_orderkey") * 2 + 1).alias("pos"), (-F.col("o_orderkey")).alias("key"), F.col("o_orderkey").alias("old"), "o_custkey"
    )
    return A.upsert(None, A.split_key_changes(inserts.unionByName(moves), "key", "old"), ["key"]).select("key", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 0")
def bulk_delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.delete_keys(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _changes(spark, sf_dir), ["o_orderkey"])


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 + 1)::BIGINT AS chunk FROM orders")
def bulk_insert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.chunks(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 3).select("o_orderkey", "chunk")


@query(
    CHANGES + ", m AS (SELECT *, CASE WHEN action = lag(action) OVER w THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY pos)),"
    " r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM m)"
    " SELECT o_custkey, run::BIGINT AS run, action, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM r GROUP BY ALL"
)
def run_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.runs(_changes(spark, sf_dir), ["action"], "o_custkey")


@query("SELECT 'orders' AS \"table\", max(o_orderkey) AS value FROM orders")
def sequence_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sequence_values(_changes(spark, sf_dir).withColumn("table", F.lit("orders")), "table", "o_orderkey")


@query("SELECT o_orderkey, 'second' AS value FROM orders")
def apply_equal_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(v).alias("value")) for i, v in ((2, "second"), (1, "first"))])
    rows = _read(spark, sf_dir, "orders").select(F.lit("I").alias("action"), F.lit(0).alias("pos"), "o_orderkey", F.explode(two).alias("c"))
    return A.upsert(None, rows.select("action", "pos", "c.seq", "o_orderkey", "c.value"), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'X' END, o_orderstatus) AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0")
def snapshot_then_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot at the middle position, then the changes after it."""
    changes = _changes(spark, sf_dir)
    middle = changes.agg(F.expr("max(pos) div 2")).first()[0]
    taken = A.upsert(None, changes.filter(F.col("pos") <= middle), ["o_orderkey"])
    return A.upsert(None, snapshot.then_stream(taken, changes, middle), ["o_orderkey"])


@query(CHANGES + "SELECT o_orderkey, action, 'rejected by the target' AS error FROM c WHERE o_custkey % 10 = 0")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.writes(_changes(spark, sf_dir), F.col("o_custkey") % 10 != 0)[1].select("o_orderkey", "action", "error")


@query(
    CHANGES + ", m AS (SELECT *, CASE WHEN action = 'U' OR action IS DISTINCT FROM lag(action) OVER (PARTITION BY o_custkey ORDER BY pos) THEN 1 ELSE 0 END AS new FROM c),"
    " r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM m)"
    " SELECT pos, run::BIGINT AS run, ((row_number() OVER (PARTITION BY o_custkey, run ORDER BY pos) - 1) // 2)::BIGINT AS part FROM r"
)
def write_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.statements(_changes(spark, sf_dir), "o_custkey", 2).select("pos", "run", "part")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'id,name' ELSE 'name' END AS columns FROM orders")
def generated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda n, g, i: F.struct(F.lit(n).alias("name"), F.lit(g).alias("generated"), F.lit(i).alias("identity"))
    columns = F.array(one("id", "", "always"), one("name", "", ""), one("total", "stored", ""))
    action = F.when(F.col("o_orderkey") % 2 == 0, "I").otherwise("U")
    kept = F.transform(A.writable(columns, action), lambda c: c["name"])
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(kept, ",").alias("columns"))


@query("SELECT * FROM (VALUES ('int4range', 'empty'), ('timestamptz', 'infinity'), ('date', '-infinity'), ('jsonb', '{\"a\": 1}'), ('int8', '7'), ('text', ' t '), ('numrange', '[1,2)')) v(type, value)")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("int4range", "[3, 3)"), ("timestamptz", "Inf"), ("date", "-Infinity"), ("jsonb", ' {"a": 1} '), ("int8", "7.00"), ("text", " t "), ("numrange", "[1, 2)")]
    return spark.createDataFrame(rows, "type string, value string").select("type", A.typed_value(F.col("type"), F.col("value")).alias("value"))


# --- selection


def _as_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.lit("web").alias("schema"), F.col("event_type").alias("table"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def filter_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.Selection.of(include=["web.click", "*.view"]).rows(_as_tables(spark, sf_dir)).select("event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'error'")
def filter_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.Selection.of(exclude=["web.error", "other.*"]).rows(_as_tables(spark, sf_dir)).select("event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'signup', 'error')")
def filter_schema_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.Selection.of(include=["web.*"], schema_only=["web.purchase"]).rows(_as_tables(spark, sf_dir)).select("event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND NOT (event_id % 2 = 0)")
def filter_ddl_multi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: F.struct(F.lit("web").alias("schema"), t.alias("table"))
    other = F.when(F.col("event_id") % 2 == 0, F.lit("error")).otherwise(F.lit("view"))
    rows = _as_tables(spark, sf_dir).select("event_id", F.array(one(F.col("table")), one(other)).alias("objects"))
    return rows.filter(selection.Selection.of(exclude=["web.error"]).keeps_ddl(F.col("objects"))).select("event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'view' AND event_type <> 'error'")
def without_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = spark.createDataFrame([("web", "view"), ("web", "view"), ("old", "click")], "schema string, `table` string")
    kept = enrichment.without_views(_as_tables(spark, sf_dir), views).withColumn("action", F.lit("I"))
    return enrichment.without_internal(kept.withColumn("schema", F.when(F.col("table") == "error", "own").otherwise("web")), "own").select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_type <> 'error'")
def without_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("event_id") % 3
    identity = F.when(third == 1, F.array(F.lit("id"))).otherwise(F.array().cast("array<string>"))
    events = _as_tables(spark, sf_dir).withColumns({"identity": identity, "action": F.when(third == 2, "I").otherwise("U")})
    return checks.without_identity(events, selection.Selection.of(exclude=["web.error"])).select("event_id")


@query("SELECT n_nationkey, (n_nationkey % 3 = 0) AS skipped FROM nation")
def ddl_object_type_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("n_nationkey") % 3
    types = F.when(third == 0, F.array(F.lit("INDEX"), F.lit("view"))).when(third == 1, F.array(F.lit("index"), F.lit("table"))).otherwise(F.array().cast("array<string>"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", selection.skips_object_types(types, ["index", "view"]).alias("skipped"))


@query("SELECT n_name AS \"table\" FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 2")
def snapshot_table_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation")
    catalog = nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("schema"), F.col("n_name").alias("table"))
    dropped = nation.filter("n_nationkey = 2").select(F.col("n_name").alias("table"))
    return selection.expand(["r1.*"], catalog).join(F.broadcast(dropped), "table", "left_anti").select("table")


@query("SELECT 'r' || n_regionkey AS schema, n_name AS \"table\" FROM nation WHERE n_regionkey <> 2 AND n_nationkey % 4 <> 0")
def snapshot_pending_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation")
    schema = F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("schema")
    status = F.when(F.col("n_nationkey") % 4 == 0, "completed").otherwise("requested").alias("status")
    log = nation.select(schema, F.col("n_name").alias("table"), status)
    whole = nation.filter("n_regionkey = 2").select(schema, F.lit("*").alias("table"), F.lit("completed").alias("status"))
    return snapshot.pending(nation.select(schema, F.col("n_name").alias("table")), log.unionByName(whole))


@query("SELECT 'I' AS action, '0/0' AS lsn, 'public' AS schema, 'nation' AS \"table\", n_nationkey, n_name, n_regionkey FROM nation")
def snapshot_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.as_inserts(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "public", "nation")


@query("SELECT n_name AS \"table\" FROM nation WHERE n_nationkey % 4 = 1")
def snapshot_retried_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry counts: every second failure was made good later."""
    nation = _read(spark, sf_dir, "nation").select(F.lit("s").alias("schema"), F.col("n_name").alias("table"), "n_nationkey")
    first = nation.select("schema", "table", F.when(F.col("n_nationkey") % 2 == 1, "failed").otherwise("completed").alias("status"), F.lit(1).alias("at"))
    later = nation.filter("n_nationkey % 4 = 3").select("schema", "table", F.lit("completed").alias("status"), F.lit(2).alias("at"))
    return snapshot.retried(nation.select("schema", "table"), first.unionByName(later)).select("table")


@query("SELECT c_custkey AS \"table\", r AS first_page, least(r + 4, c_custkey % 11) AS end_page FROM customer, range(0, 11, 4) t(r) WHERE r < greatest(c_custkey % 11, 1)")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.col("c_custkey") % 11
    return snapshot.page_ranges(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("table"), pages.alias("pages"), (pages * 8192).alias("bytes")), 32768)


# --- enrichment and sanitising


@query(
    "SELECT o_orderkey, v.* FROM orders, (VALUES ('app', 'orders', 'ok', 't1-1'), ('app', 'log', 'no_identity', ''), ('old', 'orders', 'ok', 't3-2'),"
    " ('app', 'other', 'unknown_table', NULL)) v(schema, \"table\", outcome, identity)"
)
def inject_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = "array<struct<attnum:int,primary:boolean,unique:boolean,nullable:boolean>>"
    rows = [
        ("app", "orders", "t1", [(2, False, True, False), (1, True, True, False)]), ("app", "log", "t2", [(1, False, False, True)]),
        ("old", "orders", "t3", [(3, False, True, True), (2, False, True, False)]),
    ]
    tables = spark.createDataFrame(rows, f"schema string, `table` string, table_id string, columns {column}")
    names = F.array(*[F.struct(F.lit(x).alias("schema"), F.lit(t).alias("table")) for x, t in (("app", "orders"), ("app", "log"), ("old", "orders"), ("app", "other"))])
    events = _read(spark, sf_dir, "orders").select("o_orderkey", F.explode(names).alias("n")).select("o_orderkey", "n.*")
    ids = F.when(F.col("identity_ids").isNotNull(), F.concat_ws(",", "identity_ids"))
    return enrichment.inject(events, tables).select("o_orderkey", "schema", "table", "outcome", ids.alias("identity"))


@query("SELECT doc_id, text AS text FROM documents")
def sanitize_nul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", enrichment.sanitize(F.concat("text", F.chr(F.lit(0)))).alias("text"))


@query(
    "SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-06-01' THEN 2 WHEN ts >= TIMESTAMP '2024-01-10' THEN 1 END::BIGINT AS version FROM events"
)
def metadata_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("table"), F.col("ts").cast("timestamp").alias("pos"))
    tables = events.select("table").distinct()
    when = spark.createDataFrame([("2024-01-10", 1), ("2024-06-01", 2)], "at string, version long").select(F.to_timestamp("at").alias("pos"), "version")
    return ddl.as_of(events, tables.crossJoin(F.broadcast(when))).select("event_id", "version")


# --- transformers

_NAME = "c_name AS name"


def _customers(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", *[v.alias(k) for k, v in columns.items()])


def _mask(name: str, sql: str, expr: Callable) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _customers(spark, sf_dir, masked=expr(F.col("c_name")))

    QUERIES[name], SQL[name] = run, f"SELECT c_custkey, {sql} AS masked FROM customer"


_mask("mask_default", "repeat('*', length(c_name))", M.default)
_mask("mask_password", "'************'", M.password)
_mask("mask_address", "substr(c_name, 1, 6) || '******'", M.address)
_mask("mask_id", "substr(c_name, 1, 6) || '****'", M.identifier)
_mask("mask_credit_card", "substr(c_name, 1, 6) || '******' || substr(c_name, 13)", M.credit_card)
_mask("mask_mobile", "substr(c_name, 1, 4) || '***' || substr(c_name, 8)", M.mobile)
_mask("mask_email", "substr(c_name, 1, 3) || '****' || right(c_name, 1) || '@x.org'", lambda c: M.email(F.concat(c, F.lit("@x.org"))))
_mask("mask_custom_range", "substr(c_name, 1, 4) || repeat('*', greatest(length(c_name) - 4, 0))", lambda c: M.custom(c, "4", "400%"))
_mask("mask_custom_unmask", "repeat('*', least(3, length(c_name))) || substr(c_name, 4, 5) || repeat('*', greatest(length(c_name) - 8, 0))", lambda c: M.custom(c, "3", "8", True))
_mask("literal_string", "'gone'", lambda c: F.when(c.isNotNull(), F.lit("gone")))
_mask("anon_digest", "sha256(c_name || 'salt')", lambda c: M.digest(c, "salt"))
_mask("anon_hash_md5", "md5(c_name)", lambda c: M.digest(c, "", "md5"))
_mask("anon_partial", "substr(c_name, 1, 2) || 'xx' || right(c_name, 3)", lambda c: M.partial(c, 2, "xx", 3))
_mask("anon_partial_email", "substr(c_name, 1, 2) || '******@ex******.com'", lambda c: M.partial_email(F.concat(c, F.lit("@example.com"))))
_HASH = "('0x' || substr(md5(c_name), 1, 15))::BIGINT"
_mask("range_integer", f"(10 + {_HASH} % 91)::BIGINT", lambda c: M.in_range(c, 10, 100))
_mask("range_date", f"strftime(DATE '2020-01-01' + ({_HASH} % 366)::INT, '%Y-%m-%d')", lambda c: M.date_in_range(c, "2020-01-01", "2020-12-31").cast("string"))
_mask("range_choice", f"list_extract(['a', 'b', 'c'], ({_HASH} % 3 + 1)::INT)", lambda c: M.choice(c, ["a", "b", "c"]))
_mask("range_float", f"(150 + {_HASH} % 851) / 100.0::DOUBLE", lambda c: M.float_in_range(c, 1.5, 10.0))
_mask("hash_boolean", f"({_HASH} % 2 = 0)", M.boolean)
_mask(
    "hash_uuid",
    "substr(md5(c_name),1,8) || '-' || substr(md5(c_name),9,4) || '-' || substr(md5(c_name),13,4) || '-' || substr(md5(c_name),17,4) || '-' || substr(md5(c_name),21,12)",
    M.uuid,
)


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE repeat('*', length(event_type)) END AS event_type FROM events")
def null_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))
    return transform(typed, [Rule("event_type", "masking")])


def _half_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.lit("2020-05-05")).otherwise(F.col("event_type")).alias("day"))


_DAY = "strftime(DATE '2021-01-01' + (('0x' || substr(md5('2020-05-05'), 1, 15))::BIGINT % 31)::INT, '%Y-%m-%d')"
_DATES = [Rule("day", "greenmask_date", {"min_value": "2021-01-01", "max_value": "2021-01-31"})]


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_DAY} END AS day FROM events")
def on_error_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(_half_dates(spark, sf_dir), _DATES).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_DAY} ELSE event_type END AS day FROM events")
def on_error_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(_half_dates(spark, sf_dir), _DATES, on_error="pass_through")


def _edited(spark: SparkSession, sf_dir: str, operations: list[dict]) -> DataFrame:
    return transform(_read(spark, sf_dir, "events").select("event_id", "props"), [Rule("props", "json", {"operations": operations})])


@query("SELECT event_id, '{\"k\":\"x\",\"new\":{\"old\":1}}' AS props FROM events")
def json_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"operation": "set", "path": "new.old", "value": 1, "skip_not_exist": False}
    return _edited(spark, sf_dir, [{"operation": "set", "path": "k", "value": "x"}, made, {"operation": "set", "path": "none", "value": 2}])


@query("SELECT event_id, '{\"kept\":\"' || json_extract_string(props, '$.k') || '\"}' AS props FROM events")
def json_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = F.concat(F.lit('{"kept":"'), F.get_json_object("props", "$.k"), F.lit('","gone":'), "props", F.lit("}"))
    return transform(
        _read(spark, sf_dir, "events").select("event_id", doubled.alias("props")), [Rule("props", "json", {"operations": [{"operation": "delete", "path": "gone"}]})]
    )


def _pairs(spark: SparkSession, sf_dir: str, operations: list[dict]) -> DataFrame:
    text = F.concat(F.lit('"a"=>"'), F.col("c_custkey").cast("string"), F.lit('", "b c"=>NULL'))
    return transform(_customers(spark, sf_dir, pairs=text), [Rule("pairs", "hstore", {"operations": operations})])


@query("SELECT c_custkey, '\"a\"=>\"' || c_custkey || '\", \"b c\"=>\"y\", \"d\"=>\"z\"' AS pairs FROM customer")
def hstore_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, [{"operation": "set", "key": "b c", "value": "y"}, {"operation": "set", "key": "d", "value": "z", "skip_not_exist": False}])


@query("SELECT c_custkey, '\"b c\"=>NULL' AS pairs FROM customer")
def hstore_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, [{"operation": "delete", "key": "a"}, {"operation": "delete", "key": "none"}])


_SCRAMBLED = """array_to_string(list_transform(range(length(t)), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ',
((('0x' || substr(sha256('defaultsalt' || t), (2 * (i % 32) + 1)::INT, 2))::INT + ascii(substr(t, (i + 1)::INT, 1))) % 256 % 62 + 1)::INT, 1)), '')"""


@query(f"SELECT c_custkey, {_SCRAMBLED} || '@example.com' AS masked FROM (SELECT c_custkey, c_name || 'x.org' AS t FROM customer)")
def email_scramble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(_customers(spark, sf_dir, masked=F.concat("c_name", F.lit("@x.org"))), [Rule("masked", "email")])


@query(
    f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '@keep.org' ELSE {_SCRAMBLED} || '@new.org' END AS masked"
    " FROM (SELECT c_custkey, c_name, c_name || 'x.org' AS t FROM customer)"
)
def email_exclude_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, F.lit("@keep.org")).otherwise(F.lit("@x.org")))
    return transform(_customers(spark, sf_dir, masked=text), [Rule("masked", "email", {"exclude_domain": "keep.org", "replacement_domain": "@new.org"})])


_BYTE = "('0x' || substr(h, (2 * {i} + 1)::INT, 2))::INT"


@query(
    f"SELECT c_custkey, '+1' || substr(array_to_string(list_transform(range(1, 11), lambda i: {_BYTE.format(i='i')} % 10), ''), 1, 6 + {_BYTE.format(i=0)} % 5 - 2) AS masked"
    " FROM (SELECT c_custkey, sha256(c_name) AS h FROM customer)"
)
def phone_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(_customers(spark, sf_dir, masked=F.col("c_name")), [Rule("masked", "phone_number", {"prefix": "+1"})])


@query(
    "SELECT c_custkey, array_to_string(list_transform(range(length(c_name)), lambda i: substr('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    " (('0x' || substr(sha256('string' || c_name || '/' || (i // 32)), (2 * (i % 32) + 1)::INT, 2))::INT % 52 + 1)::INT, 1)), '') AS masked FROM customer"
)
def string_same_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(_customers(spark, sf_dir, masked=F.col("c_name")), [Rule("masked", "string")])


@query("SELECT c_custkey, 'id ' || upper(substr(c_name, 1, 4)) || '-' || c_nationkey || '!' AS masked, c_nationkey FROM customer")
def template_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'id {{ .GetValue | trunc 4 | upper }}-{{.GetDynamicValue "c_nationkey"}}!'
    rows = _customers(spark, sf_dir, masked=F.col("c_name"), c_nationkey=F.col("c_nationkey"))
    return transform(rows, [Rule("masked", "template", {"template": text}, {"c_nationkey": "c_nationkey"})])


@query()
def encrypted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(_customers(spark, sf_dir, masked=F.col("c_name")), [Rule("masked", "encrypted_aes_siv", {"key_hex": "0f" * 64, "associated_data": "customer"})])


@query(f"SELECT c_custkey, strftime(date_trunc('hour', make_timestamp(1704067200000000 + ({{}}) % 86400000001)), '%Y-%m-%dT%H:%M:%SZ') AS masked FROM customer".format("('0x' || substr(md5('utc' || c_name), 1, 15))::BIGINT"))
def utc_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir, masked=scramble.utc_timestamp(F.col("c_name"), "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", "hour"))


_NAMES = ", ".join(f"'{x}'" for x in scramble.FEMALE + scramble.MALE)


@query(f"SELECT c_custkey, list_extract([{_NAMES}], (('0x' || substr(md5('first' || c_name), 1, 15))::BIGINT % 40 + 1)::INT) AS masked FROM customer")
def first_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(_customers(spark, sf_dir, masked=F.col("c_name")), [Rule("masked", "greenmask_firstname")])


_LASTS = ", ".join(f"'{x}'" for x in scramble.LAST)


@query(
    f"SELECT c_custkey, list_extract([{_NAMES}], (('0x' || substr(md5('f' || c_name), 1, 15))::BIGINT % 40 + 1)::INT) || ' ' ||"
    f" list_extract([{_LASTS}], (('0x' || substr(md5('l' || c_name), 1, 15))::BIGINT % 20 + 1)::INT) AS masked FROM customer"
)
def full_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(_customers(spark, sf_dir, masked=F.col("c_name")), [Rule("masked", "neosync_fullname")])


@query(f"SELECT c_custkey, list_extract([{_LASTS}], (('0x' || substr(md5(c_name), 1, 15))::BIGINT % 20 + 1)::INT) AS masked FROM customer")
def last_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(_customers(spark, sf_dir, masked=F.col("c_name")), [Rule("masked", "neosync_lastname")])


@query("SELECT c_custkey, md5(c_name || '@x.org') AS masked FROM customer")
def new_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(_customers(spark, sf_dir, masked=F.concat("c_name", F.lit("@x.org"))), [Rule("masked", "neosync_email", {"preserve_domain": True})])
    return made.withColumn("masked", F.regexp_replace("masked", "@x.org$", ""))


@query("SELECT c_custkey, round(c_acctbal * (1 + (('0x' || substr(md5('noise' || c_acctbal), 1, 15))::BIGINT % 2000001 / 1000000.0 - 1) * 0.5), 4) AS masked FROM (SELECT c_custkey, c_custkey * 7 AS c_acctbal FROM customer)")
def anon_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir, masked=F.round(scramble.noise(F.col("c_custkey") * 7, 0.5), 4))


# --- schema changes

_STATEMENTS = [
    ("CREATE TABLE", "CREATE TABLE t (id int)"),
    ("DROP TABLE", "DROP TABLE t"),
    ("DROP SCHEMA", "DROP SCHEMA s"),
    ("ALTER TABLE", "ALTER TABLE t ADD COLUMN IF NOT EXISTS age int"),
    ("ALTER TABLE", 'ALTER TABLE t ADD COLUMN "full name" text'),
    ("ALTER TABLE", "ALTER TABLE t DROP COLUMN age;"),
    ("ALTER TABLE", "ALTER TABLE t RENAME COLUMN a TO b;"),
    ("ALTER TABLE", "ALTER TABLE t RENAME TO u"),
    ("ALTER TABLE", "ALTER TABLE t ALTER COLUMN a TYPE bigint"),
    ("ALTER TABLE", "ALTER TABLE t ADD CONSTRAINT pk PRIMARY KEY (id)"),
    ("ALTER TABLE", "ALTER TABLE t OWNER TO me"),
]
_VALUES = ", ".join(f"({i}, '{tag}', '{text}')" for i, (tag, text) in enumerate(_STATEMENTS))
_KIND = """CASE WHEN tag = 'DROP SCHEMA' THEN 'drop_schema' WHEN tag = 'DROP TABLE' THEN 'drop_table' WHEN tag = 'CREATE TABLE' THEN 'create_table'
WHEN ddl ILIKE '%add constraint%primary key%' THEN 'add_primary_key' WHEN ddl ILIKE '%rename to%' THEN 'rename_table' WHEN ddl ILIKE '%add column%' THEN 'add_column'
WHEN ddl ILIKE '%alter column%' THEN 'alter_column' WHEN ddl ILIKE '%drop column%' THEN 'drop_column' WHEN ddl ILIKE '%rename column%' THEN 'rename_column' END"""


def _diffs(spark: SparkSession) -> DataFrame:
    rows = [(i, tag, text) for i, (tag, text) in enumerate(_STATEMENTS)]
    return ddl.diff(spark.createDataFrame(rows, "n long, tag string, ddl string"))


@query(f"SELECT n::BIGINT AS n, {_KIND} AS kind FROM (VALUES {_VALUES}) v(n, tag, ddl)")
def ddl_diff_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark).select("n", "kind")


@query("SELECT * FROM (VALUES (3::BIGINT, 'age', NULL), (4, 'full name', NULL), (5, 'age', NULL), (6, 'a', 'b'), (7, NULL, 'u'), (8, 'a', NULL)) v(n, \"column\", new_name)")
def ddl_diff_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark).filter("column IS NOT NULL OR new_name IS NOT NULL").select("n", "column", "new_name")


@query("SELECT * FROM (VALUES ('public', 't', 'full name'), ('public', 't', 'b'), ('public', 'u', NULL)) v(schema, \"table\", \"column\")")
def ddl_gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("public", "t", "age")], "schema string, `table` string, `column` string")
    return ddl.gate_violations(_diffs(spark).withColumns({"schema": F.lit("public"), "table": F.lit("t")}), rules)


# --- positions and keys


@query("SELECT o_orderkey, (7773397064 + o_orderkey)::BIGINT AS lsn_num FROM orders")
def lsn_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = P.lsn_text(F.lit(7773397064) + F.col("o_orderkey"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", P.lsn_number(text).cast("long").alias("lsn_num"))


@query(CHANGES + "SELECT max(pos) AS checkpoint FROM c")
def checkpoint_max_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.checkpoint(_changes(spark, sf_dir), "pos")


@query("SELECT event_type AS topic, (user_id % 4)::INT AS partition, max(event_id) AS \"offset\" FROM events GROUP BY ALL")
def checkpoint_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("/", "event_type", (F.col("user_id") % 4).cast("string"), F.col("event_id").cast("string"))
    return P.topic_checkpoints(_read(spark, sf_dir, "events").select(P.parse_offset(text).alias("p")).select("p.*"))


@query("SELECT o_orderkey, 'my\\.app' AS key FROM orders")
def message_key_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", K.schema_key(F.lit("my.app")).alias("key"))


@query("SELECT o_orderkey, 'app.or\\:ders' AS key FROM orders")
def message_key_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", K.table_key(F.lit("app"), F.lit("or:ders")).alias("key"))


@query("SELECT o_orderkey, 'app.orders:' || o_orderkey || ',' || replace(o_orderpriority || ',x', ',', '\\,') AS key FROM orders")
def message_key_primary_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = K.primary_key(F.lit("app"), F.lit("orders"), F.col("o_orderkey"), F.concat("o_orderpriority", F.lit(",x")))
    return _read(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))


@query("SELECT doc_id FROM documents WHERE strlen(text) + length(doc_id::VARCHAR) <= 1900")
def message_size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), "text")
    return K.within_size(rows, "key", "text", 2000).select("doc_id")


@query("SELECT o_orderkey, (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 12)::INT AS partition FROM orders")
def message_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", K.placement(F.col("o_orderkey").cast("string"), 12).alias("partition"))


# --- documents, subscriptions, checks


@query(
    CHANGES + "SELECT 'orders_' || o_orderkey AS id, (pos + CASE WHEN action = 'I' THEN 0 ELSE 1 END)::BIGINT AS version, action = 'D' AS deleted,"
    " CASE WHEN action <> 'D' THEN '{\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"_table\":\"orders\"}' END AS body FROM c"
)
def document_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.project(_changes(spark, sf_dir), "orders", ["o_orderkey"], ["o_custkey", "o_orderstatus"])


@query("SELECT o_orderkey, 'orders_' || sha256(o_orderkey || '-' || o_custkey) AS id FROM orders")
def document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", documents.document_id("orders", F.col("o_orderkey"), F.col("o_custkey"), hashed=True).alias("id"))


@query(
    CHANGES + ", d AS (SELECT 'orders_' || o_orderkey AS id, pos + CASE WHEN action = 'I' THEN 0 ELSE 1 END AS version, action FROM c),"
    " l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM d) SELECT id, version::BIGINT AS version FROM l WHERE rn = 1 AND action <> 'D'"
)
def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest_version(documents.project(_changes(spark, sf_dir), "orders", ["o_orderkey"], ["o_custkey"])).select("id", "version")


@query("SELECT * FROM (VALUES ('int8', 'integer'), ('numeric(10,2)', 'float'), ('bool', 'boolean'), ('text[]', 'string'), ('vector(3)', 'vector'), ('timestamptz', 'datetimetz'), ('point', NULL)) v(type, search_type)")
def search_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = [(t,) for t in ("int8", "numeric(10,2)", "bool", "text[]", "vector(3)", "timestamptz", "point")]
    return spark.createDataFrame(types, "type string").select("type", documents.search_type(F.col("type")).alias("search_type"))


@query("SELECT event_id, 'a' AS url FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'b' FROM events WHERE event_id % 2 = 0")
def subscription_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_id") % 2 == 0, "I").otherwise("U").alias("action")
    events = _read(spark, sf_dir, "events").select("event_id", F.lit("web").alias("schema"), F.col("event_type").alias("table"), action)
    rows = [("a", [], "web", "click"), ("b", ["I"], "", ""), ("c", ["D"], "web", ""), ("d", [], "none", "")]
    return checks.subscriptions_for(events, spark.createDataFrame(rows, "url string, types array<string>, schema string, `table` string"))


@query("SELECT * FROM (VALUES ('t', 'email', 'error'), ('t', 'phone', 'warning')) v(\"table\", \"column\", severity)")
def uniqueness_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("t", "email", "masking", False), ("t", "phone", "phone_number", False), ("t", "id", "encrypted_aes_siv", False), ("t", "code", "masking", True), ("t", "note", "masking", False)]
    unique = [("t", c) for c in ("email", "phone", "id", "code")]
    return checks.uniqueness(
        spark.createDataFrame(rules, "`table` string, `column` string, transformer string, allow_uniqueness_loss boolean"),
        spark.createDataFrame(unique, "`table` string, `column` string"),
    )


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 1 AND n_nationkey % 2 = 1 AND n_nationkey % 3 = 0 THEN 'no primary key' WHEN n_nationkey % 4 = 2 THEN 'no replica identity' WHEN n_nationkey % 4 = 3 AND n_nationkey % 3 = 0 THEN 'index not usable' END AS finding FROM nation")
def replica_identity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, "fdni")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    ok = F.col("n_nationkey") % 3 != 0
    return _read(spark, sf_dir, "nation").select("n_nationkey", checks.replica_identity(kind, ok, ok).alias("finding"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'delivered' WHEN n_nationkey % 5 IN (1, 2, 3) THEN 'retry' ELSE 'dropped' END AS outcome FROM nation")
def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in (204, 429, 503, 0, 404)]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", checks.delivery_outcome(status).alias("outcome"))


@query("SELECT event_id, 'u' AS url, '{\"Data\":' || props || '}' AS payload, CASE WHEN event_id % 2 = 0 THEN '0/1' END AS idempotency_key FROM events")
def webhook_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lsn = F.when(F.col("event_id") % 2 == 0, "0/1").otherwise("0/0")
    return checks.deliveries(_read(spark, sf_dir, "events").select("event_id", F.lit("u").alias("url"), lsn.alias("lsn"), F.col("props").alias("data")))


@query("SELECT * FROM (VALUES ('s', 't', 'c', 'money')) v(schema, \"table\", \"column\", type)")
def type_compat_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", "int4", "b", ""), ("b", "_text", "b", "b"), ("c", "money", "b", ""), ("d", "mood", "e", ""), ("e", "_mood", "b", "e"), ("f", "ltree", "b", "")]
    columns = spark.createDataFrame([("s", "t", *r) for r in rows], "schema string, `table` string, `column` string, type string, kind string, element_kind string")
    return checks.unsupported_types(columns)


@query(
    "SELECT * FROM (VALUES ('a', 'anon_partial', '2|***|3'), ('b', 'anon_fake_city', NULL), ('c', 'literal_string', 'CONFIDENTIAL')) v(\"column\", transformer, parameters)"
)
def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", "MASKED WITH FUNCTION anon.partial(2,'***',3)"), ("b", "masked with function anon.fake_city()"), ("c", "MASKED WITH VALUE 'CONFIDENTIAL'"), ("d", "NOT MASKED")]
    labels = spark.createDataFrame([("s", "t", *r) for r in rows], "schema string, `table` string, `column` string, label string")
    joined = F.when(F.col("parameters").isNotNull(), F.array_join("parameters", "|"))
    return checks.label_rules(labels).select("column", "transformer", joined.alias("parameters"))


_DUMP = [
    ("-- Name: t; Type: TABLE;", None), ("CREATE TABLE public.t (id int);", "main"), ("CREATE SEQUENCE public.s;", "main"), ("\\connect db", "every"),
    ("ALTER TABLE ONLY public.t ADD CONSTRAINT pk PRIMARY KEY (id);", "constraints"), ("CREATE INDEX i ON public.t USING btree (id);", "constraints"),
    ("CREATE MATERIALIZED VIEW public.mv AS SELECT 1;", "views"), ("CREATE INDEX j ON public.mv USING btree (id);", "views"),
    ("CREATE VIEW public.d AS SELECT NULL::integer AS id;", "main"), ("CREATE EVENT TRIGGER e ON ddl_command_end EXECUTE FUNCTION f();", "event_triggers"),
    ("SECURITY LABEL FOR anon ON COLUMN public.t.id IS 'x';", "dropped"), ("CREATE FUNCTION f() RETURNS int LANGUAGE sql BEGIN ATOMIC SELECT 1; END;", "views"),
    ("CREATE TRIGGER g AFTER INSERT ON public.t EXECUTE FUNCTION h();", "constraints"), ("COMMENT ON VIEW public.d IS 'y';", "views"), ("", None),
    ("GRANT SELECT ON TABLE public.t TO someone;", "main"),
]
_PARTS = ", ".join(f"({i}, '{part}')" for i, (_, part) in enumerate(_DUMP) if part)


@query(f"SELECT n::BIGINT AS n, part FROM (VALUES {_PARTS}) v(n, part)")
def dump_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(_DUMP)], "n long, line string")
    return ddl.dump_parts(lines, ("public.mv",)).select("n", "part")


@query("SELECT n_nationkey, 'ALTER TABLE t' AS ddl, 'n' || n_nationkey AS schema, 't' AS \"table\", 'n.seq' AS sequence FROM nation")
def ddl_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    objects = F.concat(F.lit('[{"type":"table","identity":"'), name, F.lit(""".t","columns":[{"attnum":1,"name":"id","default":"nextval('n.seq'::regclass)"}]}]}"""))
    content = F.concat(F.lit('{"ddl":"ALTER TABLE t","command_tag":"ALTER TABLE","objects":'), objects)
    parsed = _read(spark, sf_dir, "nation").select("n_nationkey", ddl.parse_message(content).alias("m")).withColumn("o", F.col("m.objects")[0])
    return parsed.select(
        "n_nationkey", "m.ddl", ddl.object_schema(F.col("o.identity")).alias("schema"), ddl.object_table(F.col("o.identity")).alias("table"),
        ddl.sequence_name(F.col("o.columns")[0]["default"]).alias("sequence"),
    )


@query(
    "SELECT * FROM (VALUES ('s-1', 't9-1', '{\"type\":\"long\"}'), ('s-1', 't.id', '{\"type\":\"alias\",\"path\":\"t9-1\"}'),"
    " ('s-1', 't.new', '{\"type\":\"alias\",\"path\":\"t9-2\"}'), ('s-1', 't9-3', '{\"type\":\"knn_vector\",\"dimension\":3}'),"
    " ('s-1', 't.v', '{\"type\":\"alias\",\"path\":\"t9-3\"}')) v(index, field, mapping)"
)
def mapping_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "id", "int8", "add"), (2, "new", "text", "rename"), (3, "v", "vector(3)", "add"), (4, "p", "point", "add")]
    return documents.mapping_changes(
        spark.createDataFrame([("s", "t", "t9", *r) for r in rows], "schema string, `table` string, table_id string, attnum int, name string, type string, change string")
    )


@query("SELECT * FROM (VALUES ('s-1', 's', NULL, 'ensure_index'), ('s-1', 's', 't', 'delete_documents'), ('r-1', 'r', NULL, 'delete_index')) v(index, alias, of_table, action)")
def index_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("s", "t", "create_table"), ("s", "u", "create_table"), ("s", "t", "drop_table"), ("s", "t", "add_column"), ("r", None, "drop_schema")]
    return documents.index_actions(spark.createDataFrame(rows, "schema string, `table` string, kind string"))


@query("SELECT '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM events")
def ndjson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndjson(_read(spark, sf_dir, "events").select("event_id", "event_type", F.lit(None).cast("string").alias("missing")))


@query("SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 3 AS batch, event_id FROM events")
def batch_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_type", "event_id", F.lit(10).alias("size"))
    return lane_batches(rows, "event_type", "event_id", "size", 31, 100).select("event_type", "batch", "event_id")


@query("SELECT n_nationkey, least(100 * 2 ** n_nationkey, 5000)::BIGINT AS wait_ms FROM nation")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select("n_nationkey", backoff(F.col("n_nationkey"), 100, 5000).alias("wait_ms"))


@query("SELECT 'too large' AS reason, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE strlen(text) > 1900")
def dropped_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select(F.octet_length("text").cast("long").alias("size"))
    return drops(rows, F.when(F.col("size") > 1900, "too large"))


@query(CHANGES + "SELECT 'orders_' || o_orderkey AS id, (pos + CASE WHEN action = 'I' THEN 0 ELSE 1 END)::BIGINT AS version FROM c")
def document_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.storable(documents.project(_changes(spark, sf_dir), "orders", ["o_orderkey"], ["o_custkey"]))[0].select("id", "version")


@query("SELECT event_id, (epoch_us(TIMESTAMP '2030-01-01') - epoch_us(ts))::BIGINT AS lag_us FROM events")
def processing_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.to_timestamp(F.lit("2030-01-01"))
    return _read(spark, sf_dir, "events").select("event_id", lag(now, F.col("ts").cast("timestamp")).alias("lag_us"))


# --- filters by kind of object, writers, checks


def _cases(spark: SparkSession, sf_dir: str, **lists: list) -> DataFrame:
    """Nations with one entry of each list, by their key."""
    return _read(spark, sf_dir, "nation").select(
        "n_nationkey", *[F.element_at(F.array(*map(F.lit, v)), (F.col("n_nationkey") % len(v) + 1).cast("int")).alias(k) for k, v in lists.items()]
    )


_TAGS = ["CREATE TABLE", "CREATE INDEX", "REFRESH MATERIALIZED VIEW", "CREATE TABLESPACE", "ALTER AGGREGATE", "DROP TEXT SEARCH PARSER"]


@query(
    "SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'tables' WHEN 1 THEN 'indexes' WHEN 2 THEN 'materialized_views' WHEN 5 THEN 'text_search' END AS category,"
    " n_nationkey % 6 IN (1, 2) AS skipped FROM nation"
)
def ddl_tag_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = object_types.skips_statement(F.array().cast("array<string>"), F.col("tag"), exclude=("indexes", "materialized_views"))
    return _cases(spark, sf_dir, tag=_TAGS).select("n_nationkey", object_types.category_of_tag(F.col("tag")).alias("category"), skipped.alias("skipped"))


@query("SELECT n_nationkey, n_nationkey % 4 IN (0, 3) AS header_kept, n_nationkey % 4 <> 1 AS cleanup_kept FROM nation")
def dump_sections_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = ["-- Name: s; Type: SCHEMA; Schema: -;", "-- Name: p; Type: ROW SECURITY; Schema: s;", "-- Name: q; Type: POLICY; Schema: s;", "-- Name: t; Type: TABLE; Schema: s;"]
    lines = ["DROP SCHEMA IF EXISTS s;", "DROP POLICY p ON s.t;", "DROP TABLESPACE x;", "DROP TABLE s.t;"]
    made = _cases(spark, sf_dir, header=headers, line=lines)
    header = object_types.keeps_section(F.col("header"), exclude=("policies",))
    return made.select("n_nationkey", header.alias("header_kept"), object_types.keeps_cleanup(F.col("line"), exclude=("policies",)).alias("cleanup_kept"))


@query(
    "SELECT * FROM (VALUES (0::BIGINT, 'CREATE TABLE', 'CREATE TABLE t (a text DEFAULT '';'')'), (1, 'CREATE FUNCTION', 'CREATE OR REPLACE FUNCTION f() AS $x$ a; -- b; $x$'),"
    " (3, 'COMMENT ON COLUMN', 'COMMENT ON COLUMN t.a IS ''--''')) v(n, tag, statement)"
)
def dump_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        "-- head; er\n\\connect a-b\nCREATE TABLE t (a text DEFAULT ';');\nCREATE OR REPLACE FUNCTION f() AS $x$ a; -- b; $x$;"
        "SET x = 1;\n\nCOMMENT ON COLUMN t.a IS '--';\nCREATE TABLE half"
    )
    return ddl.dump_statements(spark.createDataFrame([("d", text), ("none", None)], "source string, text string")).select("n", "tag", "statement")


@query(
    "SELECT o_orderkey, lower(" + " || ".join(f"lpad(to_base(('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT, 32), 4, '0')" for i in range(5)) + ") AS row_id"
    " FROM (SELECT o_orderkey, substr(sha256(o_orderkey || chr(31) || o_custkey), 1, 24) || '0' AS h FROM orders)"
)
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", enrichment.row_id(F.col("o_orderkey"), F.col("o_custkey")).alias("row_id"))


@query(CHANGES + "SELECT action = 'I' AS loaded, count(*) AS n FROM c GROUP BY 1")
def bulk_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded, lost = delivery.bulk_ingest(_changes(spark, sf_dir))
    both = loaded.select(F.lit(True).alias("loaded")).unionByName(lost.select(F.lit(False).alias("loaded")))
    return both.groupBy("loaded").agg(F.count(F.lit(1)).alias("n"))


_WRITTEN = "count(*) FILTER (WHERE o_orderkey % 5 <> 0 OR o_orderstatus = 'F')"


@query(f"SELECT o_orderstatus AS \"table\", count(*) AS asked, {_WRITTEN} AS written FROM orders GROUP BY 1 HAVING count(*) <> {_WRITTEN}")
def bulk_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("table"))
    return delivery.row_counts(asked, asked.filter("o_orderkey % 5 <> 0 OR `table` = 'F'"), "table")


@query(
    "SELECT event_id, count(*) FILTER (WHERE event_type = 'error' AND event_id % 50 = 0) OVER (PARTITION BY event_type = 'error' ORDER BY event_id) AS flush FROM events"
)
def search_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("lane"))
    return delivery.flushes(events, "lane", F.col("lane") & (F.col("event_id") % 50 == 0), "event_id").select("event_id", "flush")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'again' ELSE 'dropped' END AS outcome FROM nation WHERE n_nationkey % 3 < 2")
def search_resends(spark: SparkSession, sf_dir: str) -> DataFrame:
    again, lost = delivery.resends(_cases(spark, sf_dir, severity=["retriable", "data_loss", "none"]))
    return again.select("n_nationkey", F.lit("again").alias("outcome")).unionByName(lost.select("n_nationkey", F.lit("dropped").alias("outcome")))


@query("SELECT user_id::VARCHAR AS url, arg_max(event_type, event_id) AS type FROM events GROUP BY user_id HAVING arg_max(event_id % 4, event_id) <> 0")
def subscription_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("url"), F.lit(None).cast("string").alias("schema"), F.lit("t").alias("table"), F.array("event_type").alias("types"),
        F.when(F.col("event_id") % 4 == 0, "unsubscribe").otherwise("subscribe").alias("action"), F.col("event_id").alias("pos"),
    )
    return delivery.subscriptions(requests).select("url", F.col("types")[0].alias("type"))


_ERRORS = [("42P01", "relation_missing"), ("22003", "data_exception"), ("23505", "constraint_violation"), ("42P07", "relation_exists"), ("54000", "limit_exceeded"), ("08006", "other")]


@query("SELECT n_nationkey, CASE n_nationkey % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_ERRORS)) + " END AS class FROM nation")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _cases(spark, sf_dir, code=[code for code, _ in _ERRORS])
    return made.select("n_nationkey", delivery.error_class(F.col("code"), F.lit("cache lookup failed")).alias("class"))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'snapshot' ELSE 'replication' END AS phase, count(*) AS n FROM orders GROUP BY 1")
def event_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = delivery.phase(F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(F.col("o_orderkey")))
    return _read(spark, sf_dir, "orders").select(phase.alias("phase")).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT 'connections' AS \"check\", 'error' AS severity, '{\"server\":' || n_nationkey || ',\"needed\":16,\"available\":' || greatest(20 - n_nationkey, 0) || '}' AS finding"
    " FROM nation WHERE greatest(20 - n_nationkey, 0) < 16"
)
def preflight_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = F.lit(23).alias("max_connections"), F.lit(3).alias("reserved")
    servers = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("server"), *limits, F.col("n_nationkey").alias("used"))
    return checks.preflight(connections=checks.connection_headroom(servers, F.lit(16)))


@query(
    "SELECT c_custkey, 5 + ('0x' || substr(md5('span' || c_custkey), 1, 15))::BIGINT % 10 AS a, 6 + ('0x' || substr(md5('span' || c_custkey), 1, 15))::BIGINT % 10 AS b FROM customer"
)
def anon_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _customers(spark, sf_dir, a=F.col("c_custkey"), b=F.col("c_custkey"))
    return transform(made, [Rule("a", "anon_random_in_int4range", {"range": "[5,15)"}), Rule("b", "anon_random_in_int8range", {"range": "(5,15]"})])
