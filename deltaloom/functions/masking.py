"""Masking, hashing and scrambling of columns, as Catalyst expressions. Null stays null; lengths are those of characters."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _stars(n: Column) -> Column:
    return F.when(n.isNotNull(), F.repeat(F.lit("*"), F.greatest(n, F.lit(0)).cast("int")))


def default(c: Column) -> Column:
    return _stars(F.length(c))


def password(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("*" * 12))


def name(c: Column) -> Column:
    """First letter, two stars and last letter of each word."""
    return F.regexp_replace(c, r"(\S)\S*(\S)(?=\s|$)", "$1**$2")


def keep_first(c: Column, n: int, stars: int) -> Column:
    return F.concat(F.substring(c, 1, n), F.lit("*" * stars))


def address(c: Column) -> Column:
    return keep_first(c, 6, 6)


def identifier(c: Column) -> Column:
    return keep_first(c, 6, 4)


def email(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 3), F.lit("****"), F.substring(F.split_part(c, F.lit("@"), F.lit(1)), -1, 1), F.lit("@"), F.split_part(c, F.lit("@"), F.lit(2)))


def mobile(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 4), F.lit("***"), F.substr(c, F.lit(8)))


def credit_card(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 6), F.lit("******"), F.substr(c, F.lit(13)))


def telephone(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.concat(F.lit("(+"), F.substring(digits, 1, 1), F.lit(")"), F.substring(digits, 2, 4), F.lit("-****"))


def url(c: Column) -> Column:
    return F.regexp_replace(c, r"(://[^:/@]+):[^@/]*@", "$1:xxxxx@")


def _bound(text: str, n: Column) -> Column:
    if text.endswith("%"):
        return F.floor(n * F.lit(int(text[:-1])) / 100).cast("int")
    return F.lit(int(text))


def custom(c: Column, begin: str = "0", end: str = "100%", unmask: bool = False) -> Column:
    """Mask (or, with ``unmask``, all but) the characters from ``begin`` to ``end``, each a number or a share of the length."""
    n = F.length(c)
    bounds = [F.least(F.greatest(_bound(x, n), F.lit(0)), n) for x in (begin, end)]
    low, high = F.least(*bounds), F.greatest(*bounds)
    head, middle, tail = F.substr(c, F.lit(1), low), F.substr(c, low + 1, high - low), F.substr(c, high + 1)
    return F.concat(_stars(low), middle, _stars(n - high)) if unmask else F.concat(head, _stars(high - low), tail)


STYLES = {
    "default": default, "password": password, "name": name, "address": address, "id": identifier, "email": email, "mobile": mobile,
    "tel": telephone, "credit_card": credit_card, "url": url, "custom": custom,
}

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def uniform_hash(c: Column, seed: str = "") -> Column:
    """A number in [0, 2**60) that value and seed decide."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), c.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def in_range(c: Column, low: int, high: int, seed: str = "") -> Column:
    return F.when(c.isNotNull(), F.lit(low) + F.pmod(uniform_hash(c, seed), F.lit(high - low + 1)))


def float_in_range(c: Column, low: float, high: float, precision: int = 2, seed: str = "") -> Column:
    steps = round((high - low) * 10**precision)
    return F.when(c.isNotNull(), (F.lit(round(low * 10**precision)) + F.pmod(uniform_hash(c, seed), F.lit(steps + 1))) / F.lit(float(10**precision)))


def date_in_range(c: Column, low: str, high: str, seed: str = "") -> Column:
    first, last = F.to_date(F.lit(low)), F.to_date(F.lit(high))
    return F.when(c.isNotNull(), F.date_add(first, F.pmod(uniform_hash(c, seed), F.datediff(last, first) + 1).cast("int")))


def in_span(c: Column, span: str, kind: str, seed: str = "span") -> Column:
    """A value of a range such as ``[1,10)`` of bigint, double, date or timestamp; for doubles a bracket includes its bound or not
    without a difference."""
    found = re.fullmatch(r"\s*([\[(])\s*([^,]+?)\s*,\s*([^,]+?)\s*([\])])\s*", span)
    if not found or kind not in ("bigint", "double", "date", "timestamp"):
        raise ValueError(f"no range of {kind}: {span!r}")
    low, high = F.lit(found[2]).cast(kind), F.lit(found[3]).cast(kind)
    h = uniform_hash(c, seed)
    if kind == "double":
        return F.when(c.isNotNull(), low + (high - low) * h / F.lit(float(2**60)))
    number = {"bigint": lambda x: x, "date": F.unix_date, "timestamp": F.unix_micros}[kind]
    back = {"bigint": lambda x: x, "date": lambda x: F.date_from_unix_date(x.cast("int")), "timestamp": F.timestamp_micros}[kind]
    first = number(low).cast("long") + int(found[1] == "(")
    count = number(high).cast("long") - int(found[4] == ")") - first + 1
    return F.when(c.isNotNull() & (count > 0), back(first + F.try_mod(h, count)))


def choice(c: Column, values: list[str], seed: str = "") -> Column:
    picked = F.element_at(F.array(*map(F.lit, values)), (F.pmod(uniform_hash(c, seed), F.lit(len(values))) + 1).cast("int"))
    return F.when(c.isNotNull(), picked)


def boolean(c: Column, seed: str = "") -> Column:
    return F.when(c.isNotNull(), F.pmod(uniform_hash(c, seed), F.lit(2)) == 0)


def uuid(c: Column, seed: str = "") -> Column:
    h = F.md5(F.concat(F.lit(seed), c.cast("string")).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def text_of(c: Column, length: int, symbols: str = _LETTERS, seed: str = "") -> Column:
    """``length`` symbols that value and seed decide."""
    part = [F.substr(F.lit(symbols), (F.pmod(uniform_hash(c, f"{seed}{i}"), F.lit(len(symbols))) + 1).cast("int"), F.lit(1)) for i in range(length)]
    return F.when(c.isNotNull(), F.concat(*part))


def digest(c: Column, salt: str = "", algorithm: str = "sha256") -> Column:
    salted = F.concat(c.cast("string"), F.lit(salt)).cast("binary")
    if algorithm == "md5":
        return F.md5(salted)
    return F.sha2(salted, {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}[algorithm])


def partial(c: Column, prefix: int, padding: str, suffix: int) -> Column:
    return F.concat(F.substring(c, 1, prefix), F.lit(padding), F.substr(c, F.greatest(F.length(c) - suffix + 1, F.lit(1))) if suffix else F.lit(""))


def partial_email(c: Column) -> Column:
    mailbox, domain = F.split_part(c, F.lit("@"), F.lit(1)), F.split_part(c, F.lit("@"), F.lit(2))
    ending = F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    return F.concat(F.substring(mailbox, 1, 2), F.lit("******@"), F.substring(domain, 1, 2), F.lit("******"), ending)
