"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Rolling hashes of n-word windows, for several n, mark the windows that a text repeats; coverage is the share of
its word characters inside their later occurrences, each character counted once. Together with the share of repeated lines,
of symbols, and of words without a letter this decides whether a document is kept.

Each text is judged alone and whole, in one pass without a shuffle. Null and empty texts have no words: all counts
are 0 and the base rule fails them. Repeated rows give repeated results. Columns other than the two named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm import words
from deltaloom.llm.arrow import map_rows

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. ``coverage`` maps n to the largest share of characters inside duplicated n-grams."""

    min_words: int = 50
    max_repeat_percent: int = 50
    coverage: dict[int, float] = field(default_factory=lambda: {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20})
    max_dup_lines: float = 0.40
    max_dup_line_chars: float = 0.20
    max_symbols_per_word: float = 0.10
    max_upper: float = 0.50
    min_lettered: float = 0.80


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
SHARES = "coverage double, dup_line_share double, dup_line_chars double"


def _characters(b: np.ndarray) -> np.ndarray:
    """Running count of code points: entry i is the number of them that begin before byte i."""
    out = np.zeros(len(b) + 1, dtype=np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=out[1:])
    return out


def _lines(data: bytes) -> tuple[int, int, int, int]:
    """Lines with a word; those equal to an earlier one; characters of all; characters of the repeats."""
    seen: set[bytes] = set()
    n = dup = chars = dup_chars = 0
    for line in data.split(b"\n"):
        if line.strip():
            size = len(line) if line.isascii() else len(line.decode("utf-8", "replace"))
            n, chars = n + 1, chars + size
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + size
            else:
                seen.add(line)
    return n, dup, chars, dup_chars


def judge(data: bytes, rules: Rules) -> tuple:
    """The columns of COUNTS and SHARES for one text."""
    b = np.frombuffer(data, dtype=np.uint8)
    h, a, z = words.hash_words(data)
    n = len(h)
    at = _characters(b)
    size = at[z] - at[a]
    total = int(size.sum())
    symbols = int(_SYMBOL[b].sum())
    n_lines, dup_lines, line_chars, dup_chars = _lines(data)
    triples = words.repeated(words.windows(h, 3))
    repeat = int(words.covered(triples, 3, n).sum()) if triples.any() else 0
    base_failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    worst, ok = 0.0, not base_failed
    if repeat:
        for k, most in rules.coverage.items():
            dup = words.repeated(words.windows(h, k), later_only=True)
            if not dup.any():
                break  # a longer window that repeats would hold a shorter one
            share = float(size[words.covered(dup, k, n)].sum()) / total
            worst = max(worst, share)
            ok &= share <= most
    line_share = dup_lines / n_lines if n_lines else 0.0
    line_char_share = dup_chars / line_chars if line_chars else 0.0
    ok &= line_share <= rules.max_dup_lines and line_char_share <= rules.max_dup_line_chars
    if ok:
        letters = np.zeros(len(b) + 1, dtype=np.int64)
        np.cumsum(_LETTER[b], out=letters[1:])
        upper = int(_UPPER[b].sum())
        ascii_letters = int(_LETTER[b][b < 128].sum())
        lettered = float(np.count_nonzero(letters[z] > letters[a])) / n
        ok = symbols <= rules.max_symbols_per_word * n and upper <= rules.max_upper * max(1, ascii_letters)
        ok &= lettered >= rules.min_lettered
    return n, total, symbols, dup_lines, repeat, bool(base_failed), bool(ok), worst, line_share, line_char_share


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """One row per row of ``df``: its id, the counts, the verdict ``kept`` and the shares behind it."""
    rules = rules or Rules()
    names = [x.split()[0] for x in f"{COUNTS}, {SHARES}".split(", ")]
    kind = df.schema[id_col].dataType.simpleString()

    def rows(got: dict[str, list]) -> dict[str, list]:
        made = [judge(t or b"", rules) for t in got[text_col]]
        return {"__id": got[id_col]} | {k: [m[i] for m in made] for i, k in enumerate(names)}

    return map_rows(df, [id_col, text_col], f"__id {kind}, {COUNTS}, {SHARES}", rows).withColumnRenamed("__id", id_col)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
