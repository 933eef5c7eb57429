"""Byte-pair encoding and decoding with a contiguous rank array per word.

A short word is held in two contiguous rows: its parts, between their boundaries, and the merge ranks of adjacent parts.
The smallest rank is found by a scan, its boundary deleted (the rest of both rows moves up) and the two neighbouring
ranks refreshed, until no pair can merge. Words of like length are scanned side by side in numpy. The scan is quadratic,
so words of more than LONG bytes take a heap over linked boundaries instead, which merges in the same order. Ids of
words are kept in a bounded memo.

Null is the empty text and gives no ids. Any text is encoded whole, special tokens in it included, and each row alone:
no shuffle, and other columns are not read. Equal texts give equal ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm.arrow import map_rows

LONG = 96
MEMO = 400_000
_NONE = np.int64(1 << 60)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible in Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """A tokenizer read from a tokenizers-library JSON file of the kind: NFC, white space folded, lower case, byte letters,
    BPE with an end-of-word suffix, no decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.numbers = [str(i) for i in range(len(self.tokens))]
        self.shared = list(range(len(self.tokens)))  # one object for each id, however many words of the memo have it
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = {i: c for i, c in enumerate(_byte_letters())}
        self.stride, self.pad = len(self.tokens) + 1, len(self.tokens)
        keys = np.array([self.ids[a] * self.stride + self.ids[b] for a, b in self.ranks], dtype=np.int64)
        self.pair_ranks = np.argsort(keys)
        self.pair_keys = keys[self.pair_ranks]
        self.merged = np.array([self.ids[a + b] for a, b in self.ranks], dtype=np.int64)
        letters = _byte_letters()
        self.first = np.array([self.ids[c] for c in letters], dtype=np.int64)
        self.last = np.array([self.ids[c + self.suffix] for c in letters], dtype=np.int64)
        self.memo: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Words not met before are merged together, then every text is put together from the memo."""
        split = [list(self._split(t)) for t in texts]
        memo = self.memo
        new = {w for parts in split for part in parts if part.__class__ is list for w in part if w not in memo}
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = {w for parts in split for part in parts if part.__class__ is list for w in part}
        memo |= self._merge_all(new)
        out = []
        for parts in split:
            ids: list[int] = []
            for part in parts:
                if part.__class__ is list:
                    for word in part:
                        ids += memo[word]
                else:
                    ids.append(part)
            out.append(ids)
        if len(memo) > MEMO:
            memo.clear()
        return out

    def _split(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and ids of special tokens between them."""
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.special:
                yield self.special[part]
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower case letter by letter
            yield self.words.findall(part.lower())

    def decode(self, ids: list[int]) -> str:
        """What the library gives without a decoder: the tokens joined by spaces, special ones kept."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def text(self, ids: list[int]) -> str:
        """The words that ``ids`` stand for, with one space after each, as text (not what the library's decode gives)."""
        joined = "".join(map(self.tokens.__getitem__, ids)).replace(self.suffix, "Ġ")
        back = {c: i for i, c in self.letters.items()}
        return bytes(back[c] for c in joined).decode("utf-8", "replace").strip()

    def _merge_all(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        out = {}
        for w in words:
            b = w.encode("utf-8")
            if len(b) > LONG:
                out[w] = self._by_heap(b)
            else:
                by_length.setdefault(-(-len(b) // 4) * 4, []).append((w, b))
        for width, group in by_length.items():
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                out |= zip([w for w, _ in part], self._by_scan([b for _, b in part], width), strict=True)
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.stride + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def _by_scan(self, group: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Merge words of at most ``width`` bytes side by side: a row of part ids and a row of adjacent ranks for each."""
        n = len(group)
        size = np.array([len(b) for b in group])
        raw = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in group), dtype=np.uint8).reshape(n, width)
        column = np.arange(width)
        parts = np.where(column < size[:, None], self.first[raw], self.pad)
        parts[np.arange(n), size - 1] = self.last[raw[np.arange(n), size - 1]]
        parts = np.concatenate([parts, np.full((n, 1), self.pad)], axis=1)
        ranks = self._rank(parts[:, :-1], parts[:, 1:])
        row = np.arange(n)
        out: list[tuple[int, ...]] = [()] * n
        while len(row):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), at]
            done = least == _NONE
            if done.any():
                for r, ids in zip(row[done].tolist(), parts[done].tolist(), strict=True):
                    out[r] = tuple(map(self.shared.__getitem__, ids[: ids.index(self.pad)]))
                row, parts, ranks, at, least = (x[~done] for x in (row, parts, ranks, at, least))
                if not len(row):
                    break
            here = np.arange(len(row))
            gone = np.arange(parts.shape[1]) > at[:, None]
            source = np.minimum(np.arange(parts.shape[1]) + gone, parts.shape[1] - 1)
            parts = np.take_along_axis(parts, source, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(source[:, :-1], ranks.shape[1] - 1), axis=1)
            parts[:, -1] = self.pad
            parts[here, at] = self.merged[least]
            ranks[here, at] = self._rank(parts[here, at], parts[here, at + 1])
            ranks[here, at - 1] = np.where(at > 0, self._rank(parts[here, at - 1], parts[here, at]), ranks[here, at - 1])
        return out

    def _by_heap(self, b: bytes) -> tuple[int, ...]:
        """One long word: a heap of ranks over linked boundaries, in time n log n."""
        w = b.decode("latin-1").translate(self.letters) + self.suffix
        bounds = [*range(len(b)), len(w)]
        n = len(bounds)
        before, after, live = [*range(-1, n - 1)], [*range(1, n + 1)], [True] * n

        def rank(i: int) -> int:
            """Of the pair whose parts meet at boundary i."""
            a, z = before[i], after[i]
            return _NONE if a < 0 or z >= n else self.ranks.get((w[bounds[a] : bounds[i]], w[bounds[i] : bounds[z]]), _NONE)

        now = [rank(i) for i in range(n)]
        heap = [(r, i) for i, r in enumerate(now) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not live[i] or now[i] != r:
                continue
            live[i] = False
            a, z = before[i], after[i]
            after[a], before[z] = z, a
            for j in (a, z):
                now[j] = rank(j)
                if now[j] < _NONE:
                    heapq.heappush(heap, (now[j], j))
        left = [x for x, ok in zip(bounds, live, strict=True) if ok]
        return tuple(self.ids[w[a:z]] for a, z in zip(left, left[1:]))


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """The tokenizer of a file, once per worker."""
    return WordBpe(path)


def _id_kind(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of each row."""

    def rows(got: dict[str, list]) -> dict[str, list]:
        bpe = load(path)
        return {"__id": got[id_col], "ids": bpe.encode_all([(t or b"").decode("utf-8", "replace") for t in got[text_col]])}

    return map_rows(df, [id_col, text_col], f"__id {_id_kind(df, id_col)}, ids array<int>", rows).withColumnRenamed("__id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded`` of each row of ids; null ids give an empty string."""

    def rows(got: dict[str, list]) -> dict[str, list]:
        bpe = load(path)
        return {"__id": got[id_col], "decoded": [bpe.decode(i or []) for i in got[ids_col]]}

    return map_rows(df, [id_col, ids_col], f"__id {_id_kind(df, id_col)}, decoded string", rows).withColumnRenamed("__id", id_col)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each row, encoded and decoded in one pass so
    that neither ids nor decoded texts leave the worker."""

    def rows(got: dict[str, list]) -> dict[str, list]:
        bpe, n, a, b = load(path), [], [], []
        for ids in bpe.encode_all([(t or b"").decode("utf-8", "replace") for t in got[text_col]]):
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join(map(bpe.numbers.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return {"__id": got[id_col], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    out = f"__id {_id_kind(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(df, [id_col, text_col], out, rows).withColumnRenamed("__id", id_col)


def vocabulary_path() -> str:
    """The installed public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
