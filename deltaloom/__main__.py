"""``python -m deltaloom validate|snapshot|status CONFIG``: checks a configuration, copies the tables that a run has not copied yet,
or says which are copied."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from deltaloom.operators import snapshot
from deltaloom.plans import config as C
from deltaloom.plans.transform import transform
from deltaloom.sources.change_stream import write_ndjson

_LOG = "schema string, `table` string, status string"


def _log(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(_LOG).parquet(path) if there else spark.createDataFrame([], _LOG)


def take(spark: SparkSession, config: dict[str, Any]) -> list[str]:
    """Copies each selected table that the log does not name as completed, rules applied; returns their names. Names of tables
    come from the configuration and are as few as its entries."""
    target, kind = next(((v, k) for k, v in config["target"].items()))
    paths = {(t.get("schema", "public"), t["table"]): t["path"] for t in config["source"]["tables"]}
    wanted = spark.createDataFrame(sorted(paths), "schema string, `table` string")
    if chosen := C.selection(config):
        wanted = chosen.rows(wanted)
    done = []
    for schema, table in sorted(map(tuple, snapshot.pending(wanted, _log(spark, f"{target}/_log")).collect())):
        rows = transform(spark.read.parquet(paths[schema, table]), C.rules_of(config, schema, table))
        if kind == "table":
            rows.write.mode("overwrite").parquet(f"{target}/{schema}.{table}")
        else:
            write_ndjson(snapshot.as_inserts(rows, schema, table), f"{target}/{schema}.{table}")
        spark.createDataFrame([(schema, table, "completed")], _LOG).coalesce(1).write.mode("append").parquet(f"{target}/_log")
        done.append(f"{schema}.{table}")
    return done


def main(argv: list[str] | None = None) -> int:
    arguments = argparse.ArgumentParser(prog="deltaloom", description=__doc__)
    arguments.add_argument("command", choices=["validate", "snapshot", "status"])
    arguments.add_argument("config")
    given = arguments.parse_args(argv)
    config = C.load(given.config)
    if (wrong := C.findings(config)) or given.command == "validate":
        print(json.dumps({"findings": wrong}))
        return 1 if wrong else 0
    spark = SparkSession.builder.getOrCreate()
    if given.command == "snapshot":
        print(json.dumps({"copied": take(spark, config)}))
    else:
        log = _log(spark, f"{next(iter(config['target'].values()))}/_log").filter(F.col("status") == "completed")
        print(json.dumps({"copied": sorted(f"{r['schema']}.{r['table']}" for r in log.collect())}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
