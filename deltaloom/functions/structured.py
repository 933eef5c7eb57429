"""Edits of JSON and key-value texts, templates, and encryption that keeps equality.

Templates are Catalyst expressions. The others need a parser or a cipher that Spark lacks and run as Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PATH = re.compile(r"(?:[^.\\]|\\.)+")


def _batched(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return run


class EditError(ValueError):
    """A value that an edit cannot be made on."""


def _operations(operations: list[dict], key: str) -> list[dict]:
    if not operations:
        raise ValueError("operations must not be empty")
    for op in operations:
        if op.get("operation") not in ("set", "delete") or not op.get(key):
            raise ValueError(f"an operation needs set or delete and a {key}: {op}")
        if op["operation"] == "set" and "value" not in op and "value_template" not in op:
            raise ValueError(f"set needs a value or a value_template: {op}")
    return operations


def _may(op: dict, there: bool, name: str) -> bool:
    """Whether to go on where nothing is there: skipping wins over the error."""
    if there:
        return True
    if op.get("skip_not_exist", True):
        return False
    if op.get("error_not_exist", False):
        raise EditError(f"nothing at {name}")
    return op["operation"] == "set"


def _new(op: dict, old: Any) -> Any:
    return op["value"] if "value" in op else re.sub(r"\{\{-?\s*\.GetValue\s*-?\}\}", lambda _: "" if old is None else str(old), op["value_template"])


def _find(root: Any, steps: list[str]) -> tuple[bool, Any]:
    for s in steps:
        if isinstance(root, dict) and s in root:
            root = root[s]
        elif isinstance(root, list) and s.isdigit() and int(s) < len(root):
            root = root[int(s)]
        else:
            return False, None
    return True, root


def edit_json(text: str, operations: list[dict]) -> str:
    """``operations`` in turn at dotted paths (a backslash escapes a dot, numbers index arrays, -1 appends)."""
    root = json.loads(text)
    for op in operations:
        steps = [re.sub(r"\\(.)", r"\1", x) for x in _PATH.findall(op["path"])]
        there, old = _find(root, steps)
        if not _may(op, there, op["path"]):
            continue
        at = root
        for i, s in enumerate(steps[:-1]):
            if isinstance(at, list):
                at = at[int(s)]
            else:
                if not isinstance(at.get(s), (dict, list)):
                    at[s] = [] if steps[i + 1].lstrip("-").isdigit() else {}
                at = at[s]
        last = steps[-1]
        if op["operation"] == "delete":
            at.pop(int(last) if isinstance(at, list) else last)
        elif isinstance(at, list):
            place = len(at) if last == "-1" else int(last)
            at[place : place + 1] = [_new(op, old)]
        else:
            at[last] = _new(op, old)
    return json.dumps(root, separators=(",", ":"), ensure_ascii=False)


def json_edits(c: Column, operations: list[dict]) -> Column:
    """Edited JSON; null for texts that are not JSON or miss a path that an operation requires."""
    checked = _operations(operations, "path")

    def one(text: str) -> str | None:
        try:
            return edit_json(text, checked)
        except (EditError, ValueError, LookupError, TypeError, AttributeError):
            return None

    return _batched(one)(c.cast("string"))


_PAIR = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|([^\s"=,]+))\s*=>\s*(?:"((?:[^"\\]|\\.)*)"|([^\s",]+))\s*(?:,|$)', re.S)


def parse_pairs(text: str) -> dict[str, str | None]:
    """``"k"=>"v", "n"=>NULL`` to a dictionary."""
    out, at = {}, 0
    bare = lambda x: re.sub(r"\\(.)", r"\1", x, flags=re.S)
    while at < len(text.rstrip()):
        m = _PAIR.match(text, at)
        if not m:
            raise EditError(f"not key-value pairs at {at}")
        key = bare(m[1]) if m[1] is not None else m[2]
        out[key] = bare(m[3]) if m[3] is not None else None if m[4].upper() == "NULL" else m[4]
        at = m.end()
    return out


def pairs_text(pairs: dict[str, str | None]) -> str:
    quoted = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return ", ".join(f"{quoted(k)}=>{'NULL' if v is None else quoted(v)}" for k, v in pairs.items())


def edit_pairs(text: str, operations: list[dict]) -> str:
    pairs = parse_pairs(text)
    for op in operations:
        key = op["key"]
        if _may(op, key in pairs, key):
            if op["operation"] == "delete":
                del pairs[key]
            else:
                value = _new(op, pairs.get(key))
                pairs[key] = None if value is None or value == "<no value>" else str(value)
    return pairs_text(pairs)


def pair_edits(c: Column, operations: list[dict]) -> Column:
    checked = _operations(operations, "key")

    def one(text: str) -> str | None:
        try:
            return edit_pairs(text, checked)
        except EditError:
            return None

    return _batched(one)(c.cast("string"))


def template(c: Column, template: str, dynamic: dict[str, Column] | None = None) -> Column:
    """``{{.GetValue}}`` or ``{{.GetDynamicValue "column"}}`` with pipes upper, lower, trim, trunc N, default "x", replace "a" "b",
    sha256sum, quote. Anything else is an error when the rule is compiled."""
    pieces: list[Column] = []
    for i, part in enumerate(re.split(r"\{\{-?(.*?)-?\}\}", template)):
        if i % 2 == 0:
            pieces += [F.lit(part)] if part else []
            continue
        first, *pipes = [x.strip() for x in part.split("|")]
        named = re.fullmatch(r'\.GetDynamicValue\s+"([^"]+)"', first)
        quoted = re.fullmatch(r'"([^"]*)"', first)
        if first == ".GetValue":
            value = c.cast("string")
        elif named and named[1] in (dynamic or {}):
            value = dynamic[named[1]].cast("string")
        elif quoted:
            value = F.lit(quoted[1])
        else:
            raise ValueError(f"not supported in a template: {first!r}")
        for pipe in pipes:
            name, *args = [a or b for a, b in re.findall(r'"([^"]*)"|(\S+)', pipe)]
            try:
                value = _PIPES[name](value, *args)
            except (KeyError, TypeError) as e:
                raise ValueError(f"not supported in a template: {pipe!r}") from e
        pieces.append(F.coalesce(value, F.lit("")))
    return F.when(c.isNotNull(), F.concat(*pieces) if pieces else F.lit(""))


_PIPES: dict[str, Callable[..., Column]] = {
    "upper": F.upper, "lower": F.lower, "trim": F.trim, "trunc": lambda v, n: F.substr(v, F.lit(1), F.lit(int(n))),
    "default": lambda v, x: F.when(v.isNull() | (v == ""), F.lit(x)).otherwise(v),
    "replace": lambda v, a, b: F.replace(v, F.lit(a), F.lit(b)), "sha256sum": lambda v: F.sha2(v.cast("binary"), 256),
    "quote": lambda v: F.concat(F.lit('"'), v, F.lit('"')),
}


# --- AES-SIV (RFC 5297)


def _sbox() -> list[int]:
    """From inverses in the field of 256 elements."""
    out, p, q = [0] * 256, 1, 1
    while True:
        p = p ^ (p << 1 & 0xFF) ^ (0x1B if p & 0x80 else 0)
        for s in (1, 2, 4):
            q ^= q << s & 0xFF
        q ^= 0x09 if q & 0x80 else 0
        out[p] = q ^ (q << 1 | q >> 7) & 0xFF ^ (q << 2 | q >> 6) & 0xFF ^ (q << 3 | q >> 5) & 0xFF ^ (q << 4 | q >> 4) & 0xFF ^ 0x63
        if p == 1:
            out[0] = 0x63
            return out


_SBOX = _sbox()
_TWICE = [x << 1 & 0xFF ^ (0x1B if x & 0x80 else 0) for x in range(256)]
_SUB = np.array(_SBOX, np.uint8)
_TIMES = np.stack([_SUB, np.array(_TWICE, np.uint8)[_SUB], np.array(_TWICE, np.uint8)[_SUB] ^ _SUB])
#: By row of a column, what a byte of that row adds to its column in a round: substituted, times 2, 1, 1 and 3 from its row on.
_MIXED = [np.stack([_TIMES[(2, 1, 1, 3)[(i - r) % 4] - 1] for i in range(4)], axis=1).view("<u4")[:, 0] for r in range(4)]
_AT_ONCE = 4096


class Aes:
    """Encryption of single blocks, one by one or many at once."""

    def __init__(self, key: bytes):
        words, rcon = [list(key[i : i + 4]) for i in range(0, len(key), 4)], 1
        n = len(words)
        self.rounds = n + 6
        for i in range(n, 4 * (self.rounds + 1)):
            w = list(words[-1])
            if i % n == 0:
                w = [_SBOX[x] for x in w[1:] + w[:1]]
                w[0] ^= rcon
                rcon = _TWICE[rcon]
            elif n > 6 and i % n == 4:
                w = [_SBOX[x] for x in w]
            words.append([a ^ b for a, b in zip(words[-n], w)])
        self.keys = [sum(words[i : i + 4], []) for i in range(0, len(words), 4)]

    def block(self, data: bytes) -> bytes:
        s = [a ^ b for a, b in zip(data, self.keys[0])]
        for r in range(1, self.rounds + 1):
            s = [_SBOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < self.rounds:
                mixed = []
                for c in range(0, 16, 4):
                    a = s[c : c + 4]
                    every = a[0] ^ a[1] ^ a[2] ^ a[3]
                    mixed += [a[i] ^ every ^ _TWICE[a[i] ^ a[(i + 1) % 4]] for i in range(4)]
                s = mixed
            s = [a ^ b for a, b in zip(s, self.keys[r])]
        return bytes(s)

    def blocks(self, data: np.ndarray) -> np.ndarray:
        """The blocks of ``data``, rows of 16 bytes."""
        if len(data) < 4:  # where numpy's calls cost more than its loops save
            return np.frombuffer(b"".join(self.block(x.tobytes()) for x in data), np.uint8).reshape(-1, 16)
        return np.concatenate([self._blocks(data[i : i + _AT_ONCE]) for i in range(0, len(data), _AT_ONCE)])

    def _blocks(self, data: np.ndarray) -> np.ndarray:
        keys = np.array(self.keys, np.uint8).view("<u4")
        s = [w ^ k for w, k in zip(np.ascontiguousarray(data).view("<u4").T, keys[0])]
        for r in range(1, self.rounds):
            b = [w.view(np.uint8).reshape(-1, 4) for w in s]
            s = [_MIXED[0][b[c][:, 0]] ^ _MIXED[1][b[c - 3][:, 1]] ^ _MIXED[2][b[c - 2][:, 2]] ^ _MIXED[3][b[c - 1][:, 3]] ^ keys[r][c] for c in range(4)]
        last = np.stack(s, axis=1).view(np.uint8)
        return _SUB[last[:, [(i + 4 * (i % 4)) % 16 for i in range(16)]]] ^ np.array(self.keys[-1], np.uint8)


def _double(x: bytes) -> bytes:
    n = int.from_bytes(x, "big")
    return ((n << 1 & (1 << 128) - 1) ^ (0x87 if n >> 127 else 0)).to_bytes(16, "big")


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b))


def _cmac(aes: Aes, data: bytes) -> bytes:
    sub = _double(aes.block(bytes(16)))
    whole = data and len(data) % 16 == 0
    data = data if whole else data + b"\x80" + bytes(-(len(data) + 1) % 16)
    data = data[:-16] + _xor(data[-16:], sub if whole else _double(sub))
    out = bytes(16)
    for i in range(0, len(data), 16):
        out = aes.block(_xor(out, data[i : i + 16]))
    return out


class Siv:
    """Encryption of texts under one key and associated data, many at once."""

    def __init__(self, key: bytes, *associated: bytes):
        self.mac, self.ctr = Aes(key[: len(key) // 2]), Aes(key[len(key) // 2 :])
        self.d = _cmac(self.mac, bytes(16))
        for a in associated:
            self.d = _xor(_double(self.d), _cmac(self.mac, a))

    def encrypt(self, texts: list[bytes]) -> list[bytes]:
        """Synthetic initialisation vector and cipher text of each text.

        Block i of all texts that have one is encrypted at once, longest texts first; what is held grows with the texts' bytes."""
        if not texts:
            return []
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        n = np.maximum(-(-size // 16), 1)
        start = np.cumsum(n) - n
        plain = np.frombuffer(b"".join(texts[i].ljust(16 * m, b"\0") for i, m in zip(order.tolist(), n.tolist())), np.uint8)
        mixed, end = plain.copy(), 16 * start + size
        long, last = size >= 16, start + n - 1
        part = ~long | (size % 16 != 0)
        mixed[(end[long] - 16)[:, None] + np.arange(16)] ^= np.frombuffer(self.d, np.uint8)
        mixed[end[part]] = 0x80
        mixed = mixed.reshape(-1, 16)
        mixed[last[~long]] ^= np.frombuffer(_double(self.d), np.uint8)
        sub = _double(self.mac.block(bytes(16)))
        mixed[last] ^= np.where((long & part)[:, None], np.frombuffer(_double(sub), np.uint8), np.frombuffer(sub, np.uint8))
        siv, has = np.zeros((len(texts), 16), np.uint8), np.searchsorted(-n, -np.arange(n[0]))
        for i, k in enumerate(has.tolist()):
            siv[:k] = self.mac.blocks(siv[:k] ^ mixed[start[:k] + i])
        # The counter's low half starts with a clear bit and never carries into the high half.
        counter = np.repeat(siv, n, axis=0).view(">u8")
        counter[:, 1] = (counter[:, 1] & np.uint64(~(1 << 63 | 1 << 31) & (1 << 64) - 1)) + (np.arange(len(counter)) - np.repeat(start, n)).astype(np.uint64)
        hidden = (self.ctr.blocks(counter.view(np.uint8)).reshape(-1) ^ plain).tobytes()
        out = [b""] * len(texts)
        for i, v, a, m in zip(order.tolist(), siv, (16 * start).tolist(), size.tolist()):
            out[i] = v.tobytes() + hidden[a : a + m]
        return out


def aes_siv(key: bytes, text: bytes, *associated: bytes) -> bytes:
    """Synthetic initialisation vector and cipher text."""
    return Siv(key, *associated).encrypt([text])[0]


def encrypted(c: Column, key_hex: str, associated_data: str = "") -> Column:
    """AES-SIV with a key of 64 bytes, in base64url without padding: unlike values stay unlike."""
    import base64

    key = bytes.fromhex(key_hex)
    if len(key) != 64:
        raise ValueError("the key must have 64 bytes")
    siv = Siv(key, *((associated_data.encode(),) if associated_data else ()))

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        there = values.notna()
        made = siv.encrypt([v.encode() for v in values[there]])
        out = pd.Series(None, values.index, object)
        out[there] = [base64.urlsafe_b64encode(x).decode().rstrip("=") for x in made]
        return out

    return run(c.cast("string"))
