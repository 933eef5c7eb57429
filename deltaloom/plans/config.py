"""Configuration files: sizes, environment, rules, and what makes one valid."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Any

from deltaloom.operators.selection import Selection, parse
from deltaloom.plans.transform import REGISTRY, Rule

UNITS = {u: 1024**i for i, u in enumerate("bkmgtp")}
TARGETS = ("table", "ndjson")


def byte_size(text: str | int) -> int:
    """Bytes of ``64MiB``, ``1g`` or ``100``: binary multiples in any case; empty is 0."""
    if isinstance(text, int):
        return text
    found = re.fullmatch(r"(?i)\s*(\d+(?:\.\d+)?)\s*(?:([bkmgtp])(?:i?b)?)?\s*|\s*", text)
    if not found:
        raise ValueError(f"no size in bytes: {text!r}")
    return int(float(found[1]) * UNITS[(found[2] or "b").lower()]) if found[1] else 0


def expand(value: Any, env: dict[str, str]) -> Any:
    """``$NAME`` and ``${NAME}`` in every text of a configuration; names that are not set become empty."""
    if isinstance(value, str):
        return re.sub(r"\$(?:\{(\w+)\}|(\w+))", lambda m: env.get(m[1] or m[2], ""), value)
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    return [expand(v, env) for v in value] if isinstance(value, list) else value


def load(path: str, env: dict[str, str] | None = None) -> dict[str, Any]:
    """A YAML or JSON file with the environment put in."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml  # an optional package

        found = yaml.safe_load(text)
    return expand(found or {}, dict(os.environ) if env is None else env)


def selection(config: dict[str, Any]) -> Selection | None:
    lists = config.get("tables", {})
    return Selection.of(lists.get("include", ()), lists.get("exclude", ()), lists.get("schema_only", ())) if lists else None


def rules_of(config: dict[str, Any], schema: str, table: str) -> list[Rule]:
    """Rules of a table, by column, as the configuration lists them."""
    found = [t for t in config.get("transformations", []) if (t.get("schema", "public"), t["table"]) == (schema, table)]
    return [Rule(c, r["name"], r.get("parameters", {}), r.get("dynamic", {})) for t in found for c, r in t.get("columns", {}).items()]


def findings(config: dict[str, Any]) -> list[str]:
    """What is wrong with a configuration, all at once: not one source and one target, selections, transformers."""
    out = []
    for part, kinds in (("source", ("tables",)), ("target", TARGETS)):
        given = sorted(config.get(part) or {})
        if len(given) != 1 or given[0] not in kinds:
            out.append(f"{part}: exactly one of {', '.join(kinds)} is needed, not {given}")
    try:
        selection(config)
    except ValueError as e:
        out.append(f"tables: {e}")
    for t in config.get("transformations", []):
        if "table" not in t:
            out.append("transformations: a table has no name")
        elif "*" in str(parse(f"{t.get('schema', 'public')}.{t['table']}")):
            out.append(f"transformations: {t['table']} must be named in full")
        for column, rule in t.get("columns", {}).items():
            if rule.get("name") not in REGISTRY:
                out.append(f"transformations: {t.get('table')}.{column}: unknown transformer {rule.get('name')!r}")
    return out
