"""Column rules compiled to one projection.

A rule is (column, transformer, parameters). Rules are compiled in column order; a parameter that names another column sees
its transformed value if that column is to the left, as events are transformed column by column. Null values stay null.

A value that a transformer cannot take (see CHECKS) follows ``on_error``: null, the value itself (pass_through), or the job fails.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.functions import masking as M
from deltaloom.functions import scramble as S
from deltaloom.functions import structured


def _masking(c: Column, type: str = "default", **p: Any) -> Column:
    if type != "custom":
        return M.STYLES[type](c)
    unmask = "unmask_begin" in p or "unmask_end" in p
    if unmask and ("mask_begin" in p or "mask_end" in p):
        raise ValueError("masked and unmasked ranges exclude each other")
    kind = "unmask" if unmask else "mask"
    return M.custom(c, str(p.get(f"{kind}_begin", "0")), str(p.get(f"{kind}_end", "100%")), unmask)


REGISTRY: dict[str, Callable[..., Column]] = {
    "noop": lambda c: c,
    "masking": _masking,
    "literal_string": lambda c, literal: F.when(c.isNotNull(), F.lit(literal)),
    "string": lambda c: S.string(c),
    "email": lambda c, replacement_domain="@example.com", exclude_domain="", salt="defaultsalt": S.email(c, replacement_domain, exclude_domain, salt),
    "phone_number": lambda c, prefix="", min_length=6, max_length=10: S.phone(c, prefix, min_length, max_length),
    "template": lambda c, template, **dynamic: structured.template(c, template, dynamic),
    "json": lambda c, operations: structured.json_edits(c, operations),
    "hstore": lambda c, operations: structured.pair_edits(c, operations),
    "encrypted_aes_siv": lambda c, key_hex, associated_data="": structured.encrypted(c, key_hex, associated_data),
    "greenmask_boolean": M.boolean,
    "greenmask_choice": lambda c, choices: M.choice(c, choices),
    "greenmask_date": lambda c, min_value, max_value: M.date_in_range(c, min_value, max_value),
    "greenmask_float": lambda c, min_value, max_value, precision=2: M.float_in_range(c, min_value, max_value, precision),
    "greenmask_integer": lambda c, min_value, max_value: M.in_range(c, min_value, max_value),
    "greenmask_unix_timestamp": lambda c, min_value, max_value: M.in_range(c, int(min_value), int(max_value)),
    "greenmask_utc_timestamp": lambda c, min_timestamp, max_timestamp, truncate_part=None: S.utc_timestamp(c, min_timestamp, max_timestamp, truncate_part),
    "greenmask_firstname": lambda c, gender="any": S.first_name(c, gender),
    "greenmask_string": lambda c, min_length=1, max_length=100, symbols=M._LETTERS: S.string_between(c, min_length, max_length, symbols),
    "neosync_email": S.new_email,
    "neosync_firstname": lambda c, preserve_length=False, max_length=100, seed="": S.list_name(c, S.FEMALE + S.MALE, preserve_length, max_length, seed),
    "neosync_lastname": lambda c, preserve_length=False, max_length=100, seed="": S.list_name(c, S.LAST, preserve_length, max_length, seed),
    "neosync_fullname": lambda c, preserve_length=False, max_length=100, seed="": S.full_name(c, preserve_length, max_length, seed),
    "neosync_string": lambda c, preserve_length=False, min_length=1, max_length=100: S.string_between(c, min_length, max_length, M._LETTERS, preserve_length),
    "anon_noise": lambda c, ratio: S.noise(c, ratio),
    "anon_dnoise": lambda c, days: S.date_noise(c, days),
    "anon_random_in": lambda c, values: M.choice(c, values, "in"),
    "anon_random_int_between": lambda c, low, high: M.in_range(c, low, high, "int"),
    "anon_random_date_between": lambda c, low, high: M.date_in_range(c, low, high, "date"),
    "anon_random_string": lambda c, length: S.symbols(c, F.lit(length), M._LETTERS, "random"),
    "anon_random_phone": lambda c, prefix="0": S.phone(c, prefix, 10, 10),
    "anon_pseudo_first_name": lambda c, salt="": M.choice(c, S.FEMALE + S.MALE, f"pseudo{salt}"),
    "anon_pseudo_last_name": lambda c, salt="": M.choice(c, S.LAST, f"pseudo{salt}"),
    "anon_pseudo_email": lambda c, salt="": S.email(c, "@example.com", "", f"pseudo{salt}"),
    "anon_random_in_int4range": lambda c, range: M.in_span(c, range, "bigint"),
    "anon_random_in_int8range": lambda c, range: M.in_span(c, range, "bigint"),
    "anon_random_in_numrange": lambda c, range: M.in_span(c, range, "double"),
    "anon_random_in_daterange": lambda c, range: M.in_span(c, range, "date"),
    "anon_random_in_tsrange": lambda c, range: M.in_span(c, range, "timestamp"),
    "anon_random_in_tstzrange": lambda c, range: M.in_span(c, range, "timestamp"),
    "anon_random_in_enum": lambda c, values: M.choice(c, values, "enum"),
    "anon_random_zip": lambda c: M.text_of(c, 5, "0123456789", "zip"),
    "anon_lorem_ipsum": lambda c, count=0, unit="paragraphs": S.lorem_ipsum(c, count, unit),
    "greenmask_uuid": M.uuid,
    "anon_digest": lambda c, salt="", hash_algorithm="sha256": M.digest(c, salt, hash_algorithm),
    "anon_hash": lambda c: M.digest(c),
    "anon_partial": lambda c, prefix, mask, suffix: M.partial(c, prefix, mask, suffix),
    "anon_partial_email": M.partial_email,
}


#: Which values a transformer can take, from its result and the value; the others can take any. A null result of a value
#: that is not null is one that it could not take.
CHECKS: dict[str, Callable[[Column, Column], Column]] = {
    "json": lambda c, new: new.isNotNull(),
    "hstore": lambda c, new: new.isNotNull(),
    "neosync_email": lambda c, new: new.isNotNull(),
    "greenmask_date": lambda c, new: c.cast("string").try_cast("date").isNotNull(),
    "greenmask_integer": lambda c, new: c.cast("string").try_cast("decimal(38,0)").isNotNull(),
    "greenmask_float": lambda c, new: c.cast("string").try_cast("double").isNotNull(),
    "greenmask_unix_timestamp": lambda c, new: c.cast("string").try_cast("bigint").isNotNull(),
    "greenmask_utc_timestamp": lambda c, new: c.cast("string").try_cast("timestamp").isNotNull(),
    "anon_noise": lambda c, new: c.cast("string").try_cast("double").isNotNull(),
    "anon_dnoise": lambda c, new: c.cast("string").try_cast("date").isNotNull(),
}


def with_policy(name: str, c: Column, new: Column, on_error: str) -> Column:
    if on_error not in ("null", "pass_through", "fail"):
        raise ValueError(f"unknown error policy {on_error!r}")
    check = CHECKS.get(name)
    if check is None:
        return new
    failed = c.isNotNull() & ~F.coalesce(check(c, new), F.lit(False))
    if on_error == "pass_through":
        return F.when(failed, c.cast("string")).otherwise(new.cast("string"))
    if on_error == "fail":
        return F.when(failed, F.raise_error(F.concat(F.lit(f"{name} cannot take "), c.cast("string")))).otherwise(new)
    return F.when(~failed, new)


@dataclass(frozen=True)
class Rule:
    column: str
    transformer: str
    parameters: dict[str, Any] = field(default_factory=dict)
    dynamic: dict[str, str] = field(default_factory=dict)


def compile_rules(rules: list[Rule], columns: list[str], strict: bool = False, on_error: str = "null") -> dict[str, Column]:
    """New expressions by column. Unknown columns, transformers and parameters are errors; so, if strict, is a column without a rule."""
    of = {r.column: r for r in rules}
    if unknown := set(of) - set(columns):
        raise ValueError(f"rules for unknown columns: {sorted(unknown)}")
    if strict and (bare := [c for c in columns if c not in of]):
        raise ValueError(f"columns without a rule: {bare}")
    out: dict[str, Column] = {}
    for name in columns:
        if rule := of.get(name):
            if rule.transformer not in REGISTRY:
                raise ValueError(f"unknown transformer {rule.transformer!r}")
            dynamic = {k: out.get(c, F.col(c)) for k, c in rule.dynamic.items()}
            try:
                new = REGISTRY[rule.transformer](F.col(name), **rule.parameters, **dynamic)
                out[name] = with_policy(rule.transformer, F.col(name), new, on_error)
            except TypeError as e:
                raise ValueError(f"parameters of {rule.transformer}: {e}") from e
    return out


def transform(df: DataFrame, rules: list[Rule], strict: bool = False, on_error: str = "null") -> DataFrame:
    return df.withColumns(compile_rules(rules, df.columns, strict, on_error)) if rules else df
