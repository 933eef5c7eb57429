"""Scrambled emails, phone numbers, strings, names and times, as Catalyst expressions over bytes of a SHA-256 digest.

Equal values give equal results; null stays null. Texts longer than a digest take further digests, one for each 32 characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltaloom.functions import masking as M

#: Output alphabet of the email scramble, a fixed value.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEMALE = "Ada Alma Beth Cora Dora Edith Elsa Emma Flora Greta Hanna Irene Jane Karin Lena Mary Nora Olga Paula Rosa".split()
MALE = "Adam Alan Bob Carl Dan Emil Erik Felix Georg Hugo Ivan Jack Kurt Leo Max Nils Oskar Paul Ralf Tom".split()
LAST = "Adler Bauer Clark Dietz Ebert Fuchs Green Huber Ibsen Jones Klein Lang Meyer Noll Olsen Peters Quinn Reed Smith Wolf".split()


def _byte(digest: Column, i: Column) -> Column:
    """Byte ``i``, modulo 32, of a digest in hexadecimal."""
    return F.conv(F.substr(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _scramble(text: Column, salt: str) -> Column:
    digest = F.sha2(F.concat(F.lit(salt), text).cast("binary"), 256)

    def one(i: Column) -> Column:
        code = F.pmod(_byte(digest, i) + F.ascii(F.substr(text, i + 1, F.lit(1))), F.lit(256))
        return F.substr(F.lit(ALPHABET), F.pmod(code, F.lit(len(ALPHABET))) + 1, F.lit(1))

    places = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.expr("array()").cast("array<int>"))
    return F.array_join(F.transform(places, one), "")


def email(c: Column, replacement_domain: str = "@example.com", exclude_domain: str = "", salt: str = "defaultsalt") -> Column:
    """Mailbox and domain scrambled before another domain; the excluded domain stays; without an @ the salt is the mailbox.
    Elements of ``{a,b}`` one by one; texts of less than two characters stay. Characters are taken by their code points."""

    def one(s: Column) -> Column:
        at = F.instr(s, "@")
        mailbox = F.when(at > 0, F.substr(s, F.lit(1), at - 1)).otherwise(F.lit(salt))
        domain = F.substr(s, at + 1)
        return F.when(domain == exclude_domain, s).otherwise(F.concat(_scramble(F.concat(mailbox, domain), salt), F.lit(replacement_domain)))

    several = F.startswith(c, F.lit("{")) | F.endswith(c, F.lit("}"))
    inner = F.substr(c, F.lit(2), F.length(c) - 2)
    listed = F.concat(F.lit("{"), F.array_join(F.transform(F.split(inner, ","), one), ","), F.lit("}"))
    return F.when(c.isNull() | (F.octet_length(c) < 2), c).when(several, listed).otherwise(one(c))


def phone(c: Column, prefix: str | Column = "", min_length: int = 6, max_length: int = 10) -> Column:
    """The prefix and digits, ``min_length`` to ``max_length`` characters in all."""
    if not 0 < min_length <= max_length <= 31:
        raise ValueError("phone numbers have 1 to 31 characters, the least length first")
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    digest = F.sha2(c.cast("string").cast("binary"), 256)
    length = F.lit(min_length) + F.pmod(_byte(digest, F.lit(0)), F.lit(max_length - min_length + 1))
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(max_length)), lambda i: F.pmod(_byte(digest, i), F.lit(10)).cast("string")), "")
    return F.when(c.isNotNull(), F.concat(prefix, F.substr(digits, F.lit(1), F.greatest(length - F.length(prefix), F.lit(0)))))


def symbols(c: Column, length: Column, alphabet: str = M._LETTERS, seed: str = "") -> Column:
    """``length`` symbols that value and seed decide."""

    def one(i: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(seed), c.cast("string"), F.lit("/"), F.floor(i / 32).cast("string")).cast("binary"), 256)
        return F.substr(F.lit(alphabet), F.pmod(_byte(digest, i), F.lit(len(alphabet))) + 1, F.lit(1))

    return F.when(length > 0, F.array_join(F.transform(F.sequence(F.lit(0), length - 1), one), "")).when(length == 0, F.lit(""))


def string(c: Column, alphabet: str = M._LETTERS[:52]) -> Column:
    """As many letters as the value has characters."""
    return symbols(c, F.length(c), alphabet, "string")


def string_between(c: Column, min_length: int = 1, max_length: int = 100, alphabet: str = M._LETTERS, preserve_length: bool = False) -> Column:
    if min_length > max_length:
        raise ValueError("the least length is above the largest")
    n = F.length(c) if preserve_length else (F.lit(min_length) + F.pmod(M.uniform_hash(c, "length"), F.lit(max_length - min_length + 1))).cast("int")
    return symbols(c, n, alphabet)


def first_name(c: Column, gender: str | Column = "any") -> Column:
    """A name of a gender, which may come from a column; other words than male and female mean any."""
    gender = F.lower(F.lit(gender) if isinstance(gender, str) else gender)
    female, male = M.choice(c, FEMALE, "first"), M.choice(c, MALE, "first")
    return F.when(gender == "female", female).when(gender == "male", male).otherwise(M.choice(c, FEMALE + MALE, "first"))


def _of_length(c: Column, names: list[str], n: Column, seed: str) -> Column:
    """A name of ``n`` characters, or a capital and letters where the list has none."""
    out = F.concat(symbols(c, F.least(n, F.lit(1)), M._LETTERS[26:52], seed), symbols(c, F.greatest(n - 1, F.lit(0)), M._LETTERS[:26], seed))
    for size in sorted({len(x) for x in names}):
        out = F.when(n == size, M.choice(c, [x for x in names if len(x) == size], seed)).otherwise(out)
    return out


def list_name(c: Column, names: list[str], preserve_length: bool = False, max_length: int = 100, seed: str = "") -> Column:
    """A name of the list of at most ``max_length`` characters; with ``preserve_length`` of as many as the value has."""
    if preserve_length:
        return F.when(c.isNotNull(), _of_length(c, names, F.least(F.length(c), F.lit(max_length)), seed))
    short = [x for x in names if len(x) <= max_length]
    return M.choice(c, short, seed) if short else symbols(c, F.lit(1), M._LETTERS[26:52], seed)


def full_name(c: Column, preserve_length: bool = False, max_length: int = 100, seed: str = "") -> Column:
    """First and last name; of 3 or 4 characters random letters; cut to ``max_length``, at least 3."""
    if max_length < 3:
        raise ValueError("a full name has at least 3 characters")
    both = F.concat_ws(" ", M.choice(c, FEMALE + MALE, f"{seed}f"), M.choice(c, LAST, f"{seed}l"))
    n = F.least(F.length(c), F.lit(max_length)) if preserve_length else F.lit(max_length)
    padded = F.concat(both, symbols(c, F.greatest(n - F.length(both), F.lit(0)), M._LETTERS[:26], seed)) if preserve_length else both
    return F.when(c.isNotNull(), F.when(n < 5, symbols(c, n, M._LETTERS[:52], seed)).otherwise(F.trim(F.substr(padded, F.lit(1), n))))


def new_email(
    c: Column, email_type: str = "uuidv4", preserve_domain: bool = False, preserve_length: bool = False, excluded_domains: tuple[str, ...] = (),
    max_length: int = 100, invalid_email_action: str = "reject", seed: str = "",
) -> Column:
    """Another address. Values without an @ follow ``invalid_email_action``: reject (null, an error of the stage), passthrough,
    null or generate. Domains stay if preserved, unless they are excluded; then, and else, they are example.com."""
    if email_type not in ("uuidv4", "fullname", "any") or invalid_email_action not in ("reject", "passthrough", "null", "generate"):
        raise ValueError("unknown email_type or invalid_email_action")
    valid = c.rlike(r"^[^@\s]+@[^@\s]+$")
    domain = F.split_part(c, F.lit("@"), F.lit(2))
    kept = F.when(valid & ~domain.isin(*excluded_domains) if excluded_domains else valid, domain) if preserve_domain else F.lit(None).cast("string")
    domain = F.coalesce(kept, F.lit("example.com"))
    mailbox = F.replace(M.uuid(c, seed), F.lit("-"), F.lit("")) if email_type != "fullname" else F.lower(F.replace(full_name(c, seed=seed), F.lit(" "), F.lit(".")))
    room = F.least(F.length(c), F.lit(max_length)) if preserve_length else F.lit(max_length)
    made = F.concat(F.substr(mailbox, F.lit(1), F.greatest(room - F.length(domain) - 1, F.lit(1))), F.lit("@"), domain)
    other = {"passthrough": c, "generate": made}.get(invalid_email_action, F.lit(None).cast("string"))
    return F.when(c.isNull(), F.lit(None)).when(valid, made).otherwise(other)


def utc_timestamp(c: Column, min_timestamp: str, max_timestamp: str, truncate_part: str | None = None) -> Column:
    """A time between the two, in RFC 3339 and UTC, cut to a part such as hour or day."""
    low, high = (F.unix_micros(F.to_timestamp(F.lit(x))) for x in (min_timestamp, max_timestamp))
    at = F.timestamp_micros(low + F.pmod(M.uniform_hash(c, "utc"), high - low + 1))
    return F.when(c.isNotNull(), F.date_format(F.date_trunc(truncate_part, at) if truncate_part else at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def noise(c: Column, ratio: float, seed: str = "") -> Column:
    """A number within ``ratio`` of the value."""
    share = F.pmod(M.uniform_hash(c, f"noise{seed}"), F.lit(2_000_001)) / F.lit(1_000_000.0) - 1
    return (c.cast("double") * (1 + share * F.lit(ratio))).cast("double")


def date_noise(c: Column, days: int, seed: str = "") -> Column:
    """A date at most ``days`` days off."""
    return F.date_add(c.cast("date"), (F.pmod(M.uniform_hash(c, f"days{seed}"), F.lit(2 * days + 1)) - days).cast("int"))


LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def lorem_ipsum(c: Column, count: int = 0, unit: str = "paragraphs") -> Column:
    """``count`` characters, words or paragraphs (of 40 words; 0: five paragraphs) that the value decides."""
    if unit not in ("characters", "words", "paragraphs") or count < 0 or (not count and unit != "paragraphs"):
        raise ValueError(f"no filler text of {count} {unit}")
    count = count or 5
    start = F.pmod(M.uniform_hash(c, "lorem"), F.lit(len(LOREM)))
    listed = F.array(*map(F.lit, LOREM))

    def words(n: int, after: Column | None = None) -> Column:
        first = start if after is None else start + after
        one = lambda i: F.element_at(listed, (F.pmod(first + i * 7, F.lit(len(LOREM))) + 1).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one), " ")

    if unit == "words":
        made = words(count)
    elif unit == "characters":
        made = F.substring(words(count // 3 + 1), 1, count)
    else:
        made = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda p: words(40, p)), "\n")
    return F.when(c.isNotNull(), made)
