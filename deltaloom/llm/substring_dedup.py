"""Removal of word runs that occur more than once, by prefix-partitioned suffix trees.

A window is WINDOW consecutive words. Every word inside a window whose words also start anywhere else is removed.

Suffixes are taken at anchors: positions whose PREFIX-word hash is the least of some window around them, so each window holds
an anchor at a place that its words alone decide, and equal windows hold the same one. The anchors of a
text with one prefix (many in periodic text) are one row with packed positions, and those whose surroundings are the same words
are one suffix that counts as several. Anchors whose prefix occurs once are dropped; the others are dealt by prefix into groups
that fit in memory. For each group the suffixes are sorted, and the lengths of common prefixes of neighbours give the tree: the
nodes of depth d are the runs of neighbours that agree in d words. A node is deep enough for a window that reaches l words left
of the anchor if d = WINDOW - l, and the window repeats if two of the node's leaves also agree in their l words on the left.

A prefix with more than GROUP suffixes is lengthened. All windows that reach between a and b words left of an anchor hold the
words from a before it to WINDOW - b after it, so the narrower the range of reaches, the longer the prefix that its suffixes,
beginning a words before the anchor, are dealt by: PREFIX words for all reaches, then about 30 for a few of them, at last the
whole window for a single one. A group that fits is a subtree; one whose prefix is a whole window has equal suffixes only, and
then each of them repeats, however many they are. So no group is too large for a task and none is split but between equal ones.

Words are compared by 48 bits of their hashes, and a window of 35 by all of its words. Texts are tied to their marks by 128 bits
of a digest of id and text, so rows that repeat an id are told apart, and rows that repeat both are each other's copies.
Null and empty texts have no words, and an empty table gives an empty one. Windows are judged on the input. Other columns are
not read, or pass through unchanged in ``without_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from deltaloom.llm import words
from deltaloom.llm.arrow import add_columns, schema, tidy
from deltaloom.llm.shared import Scratch, bound_batches, written

WINDOW = 35
PREFIX = 8
GROUP = 2_048
AT_ONCE = 16_384  # suffixes of whole groups that are handled together
BROADCAST_GROUPS = 1_000_000
_BYTES = 6
_U = np.uint64


def sliding(pick: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each run of ``width`` entries."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(h: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of word hashes ``h``, and the hashes of their prefixes."""
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, _U)
    g = words.windows(h, prefix)
    around = window - prefix + 1
    least = sliding(np.minimum, g, around)
    zeros = np.zeros(around - 1, dtype=_U)
    at = np.flatnonzero(sliding(np.maximum, np.concatenate((zeros, least, zeros)), around) == g)
    return at, g[at]


def _batch(columns: list[np.ndarray | list], to: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, to, strict=True)], schema=to)


#: ``pos`` holds positions as little-endian 32-bit integers, ``n`` of them. Suffixes are dealt by k1 and k2 for the windows that
#: reach between ``low`` and ``high`` words left of the anchor.
_ANCHORS = schema("prefix long, rid binary, n int, pos binary")
_SUFFIXES = schema("k1 long, k2 long, low int, high int, rid binary, pos binary, n int, before int, words binary")
_MARKS = schema("rid binary, pos binary, mask long")
_DEALT = ["k1", "k2", "low", "high"]
_RID = 16
_POS = np.dtype("<i4")
_POSITIONS = 1 << 20


def _by_prefix(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct prefixes of one text's anchors, the number of positions of each, and all positions in that order."""
    order = np.argsort(g, kind="stable")
    prefixes, counts = np.unique(g, return_counts=True)
    return prefixes.view(np.int64), counts, at[order].astype(_POS)


def _packed(counts: np.ndarray, positions: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))) * _POS.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(positions.tobytes())])


def _find_anchors(window: int, prefix: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = to_arrow_schema(_ANCHORS)

        def flush(made: list[tuple]) -> pa.RecordBatch:
            prefixes, counts, positions = (np.concatenate([m[i] for m in made]) for i in (1, 2, 3))
            each = np.frombuffer(b"".join(m[0] for m in made), np.uint8).reshape(-1, _RID).repeat([len(m[1]) for m in made], axis=0)
            rids = _packed(np.full(len(each), _RID // _POS.itemsize), each)
            return _batch([prefixes, rids, counts.astype(np.int32), _packed(counts, positions)], to)

        for batch in batches:
            rids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.large_binary())
            made: list[tuple] = []
            held = 0
            for rid, text in zip(rids, texts, strict=True):
                prefixes, counts, positions = _by_prefix(*anchors(words.hash_words(text.as_py() or b"")[0], window, prefix))
                made.append((rid, prefixes, counts, positions))
                held += len(positions)
                if len(made) == 512 or held >= _POSITIONS:
                    yield flush(made)
                    made, held = [], 0
            if made:
                yield flush(made)

    return run


def _cut_suffixes(rid: int, text: int, lists: int, window: int, prefix: int) -> Callable:
    """From rows with rid, text and lists of anchors at those places, the words around each anchor; anchors of a text with
    equal surroundings are one suffix."""
    left = window - prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = to_arrow_schema(_SUFFIXES)
        for batch in batches:
            texts = batch.column(text).cast(pa.large_binary())
            made: list[list] = [[] for _ in to]
            for i in range(batch.num_rows):
                h, _, _ = words.hash_words(texts[i].as_py() or b"")
                packed = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 8 - _BYTES :]).tobytes()
                row = batch.column(rid)[i].as_py()
                for a in {a["prefix"]: a for a in batch.column(lists)[i].as_py()}.values():
                    around: dict[tuple[int, bytes], list[int]] = {}
                    for pos in np.frombuffer(a["pos"], _POS).tolist():
                        low, high = max(0, pos - left), min(len(h), pos + window)
                        around.setdefault((pos - low, packed[low * _BYTES : high * _BYTES]), []).append(pos)
                    for (before, cut), at in around.items():
                        values = (a["prefix"], 0, 0, left, row, np.array(at, _POS).tobytes(), len(at), before, cut)
                        for column, value in zip(made, values, strict=True):
                            column.append(value)
                if len(made[0]) >= 4096:
                    yield _batch(made, to)
                    made = [[] for _ in to]
            yield _batch(made, to)

    return run


def _unpack(cuts: list[bytes], before: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left words (nearest first) and right words of each suffix, zeros where the text ends; number of right words."""
    left = window - prefix
    width = left + window
    raw = b"".join(cuts)
    lengths = np.array([len(c) for c in cuts]) // _BYTES
    flat = np.zeros((len(raw) // _BYTES, 8), dtype=np.uint8)
    flat[:, :_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, _BYTES)
    row = np.arange(len(cuts)).repeat(lengths)
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    column = np.arange(len(flat)) - start[row] + (left - before)[row]
    table = np.zeros((len(cuts), width), dtype=_U)
    table[row, column] = flat.view(_U)[:, 0]
    return table[:, :left][:, ::-1], table[:, left:], lengths - before


def repeats(
    group: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray, before: np.ndarray, cuts: list[bytes], window: int, prefix: int
) -> np.ndarray:
    """For each suffix the mask of its repeated windows (bit l: the window that begins l words before the anchor), of those
    between ``low`` and ``high``. The windows of a suffix that stands for many repeat by themselves."""
    left, right, after = _unpack(cuts, before, window, prefix)
    order = np.lexsort((*right.T[::-1], group))
    g, right_, left_ = group[order], right[order], left[order]
    before_, after_, low_, high_, many_ = before[order], after[order], low[order], high[order], many[order]
    same = np.concatenate([(g[1:] == g[:-1])[:, None], right_[1:] == right_[:-1]], axis=1)
    common = np.concatenate(([-1], np.where(same[:, 0], np.logical_and.accumulate(same, axis=1).sum(axis=1) - 1, -1)))
    mask = np.zeros(len(g), dtype=np.int64)
    reach = np.zeros(len(g), dtype=_U)
    for l in range(window - prefix + 1):
        if l:
            reach = words.mix(reach + left_[:, l - 1]) + _U(l)
        depth = window - l
        node = np.cumsum(common < depth).astype(_U)
        whole = np.flatnonzero((before_ >= l) & (after_ >= depth) & (low_ <= l) & (l <= high_))
        again = words.repeated(words.mix(reach[whole] ^ words.mix(node[whole]))) | many_[whole]
        mask[whole[again]] |= 1 << l
    out = np.zeros_like(mask)
    out[order] = mask
    return out


def _grow_trees(window: int, prefix: int) -> Callable:
    """Suffixes that come group by group, to their marks. Whole groups are handled together, about AT_ONCE suffixes at once."""

    def keys(table: pa.Table) -> np.ndarray:
        return np.stack([table.column(k).to_numpy().astype(np.int64) for k in _DEALT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = to_arrow_schema(_MARKS)

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            of = keys(table)
            group = np.cumsum(np.concatenate(([0], (of[:, 1:] != of[:, :-1]).any(axis=0))))
            n, before = (table.column(k).to_numpy().astype(np.int64) for k in ("n", "before"))
            mask = repeats(group, of[2], of[3], n > 1, before, table.column("words").to_pylist(), window, prefix)
            hit = pa.array(np.flatnonzero(mask))
            rid, pos = (pa.array(table.column(k).take(hit).to_pylist(), pa.binary()) for k in ("rid", "pos"))
            yield _batch([rid, pos, mask[mask != 0]], to)

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= AT_ONCE:
                table = pa.Table.from_batches(held).combine_chunks()
                of = keys(table)
                ends = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1
                if len(ends):
                    yield from flush(table.slice(0, int(ends[-1])).to_batches())
                    held = table.slice(int(ends[-1])).to_batches()
                    rows -= int(ends[-1])
                else:
                    held = table.to_batches()
        if held:
            yield from flush(held)

    return run


def _trees(suffixes: DataFrame, window: int, prefix: int) -> DataFrame:
    return suffixes.repartition(*_DEALT).sortWithinPartitions(*_DEALT).mapInArrow(tidy(_grow_trees(window, prefix)), _MARKS)


def _lengthened(suffixes: DataFrame, width: int, window: int) -> DataFrame:
    """Suffixes dealt by longer prefixes: a row for each part of ``width`` of its range of reaches, its words and key cut to that."""
    starts = F.sequence(F.col("low"), F.col("high"), F.lit(width))
    parts = F.transform(starts, lambda a: F.struct(a.alias("low"), F.least(a + (width - 1), F.col("high")).alias("high")))
    rows = suffixes.select("rid", "pos", "n", "before", "words", F.explode(parts).alias("part")).select("rid", "pos", "n", "before", "words", "part.*")
    whole = f"before >= low AND length(words) div {_BYTES} - before >= {window} - high"
    words_of = F.expr(f"substring(words, (before - low) * {_BYTES} + 1, ({window} - high + low) * {_BYTES})")
    around = F.expr(f"substring(words, (before - least(before, high)) * {_BYTES} + 1, (least(before, high) + {window} - low) * {_BYTES})")
    keyed = rows.filter(whole).withColumns({"k1": F.xxhash64(F.lit(1), words_of), "k2": F.xxhash64(F.lit(2), words_of), "words": around})
    return keyed.withColumn("before", F.least("before", "high")).select(*[f.name for f in _SUFFIXES])


def mark(docs: DataFrame, text_col: str, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """``docs``, which has a column ``rid``, with ``marks``: an array of (pos, mask) of its anchors with repeated windows, or null.

    A prefix has a row for each text, however often the text repeats it; ``often`` is written so that both sides of the join
    are plain tables, of which a hot prefix can be split at run time."""
    bound_batches(docs.sparkSession)
    early, late, marks = Scratch(), Scratch(), []
    found = early.written(docs.select("rid", text_col).mapInArrow(tidy(_find_anchors(window, prefix)), _ANCHORS), "anchors")
    often = early.written(found.groupBy(F.col("prefix").alias("twice")).agg(F.sum("n").alias("times")).filter("times > 1"), "often")
    kept = found.join(often, found["prefix"] == often["twice"]).select("rid", F.struct("prefix", "pos", (F.col("times") > group).alias("over")).alias("anchor"))
    lists = late.written(kept.groupBy(F.col("rid").alias("__rid")).agg(F.collect_set("anchor").alias("anchors")), "lists")
    any_over = not often.filter(F.col("times") > group).isEmpty()
    early.drop()

    def suffixes(over: bool) -> DataFrame:
        some = lists.withColumn("anchors", F.filter("anchors", lambda a: a["over"] == F.lit(over))).filter(F.size("anchors") > 0)
        near = docs.select("rid", text_col).join(some, docs["rid"] == some["__rid"])
        places = tuple(near.columns.index(c) for c in ("rid", text_col, "anchors"))
        return near.mapInArrow(tidy(_cut_suffixes(*places, window, prefix)), _SUFFIXES)

    marks.append(written(_trees(suffixes(False), window, prefix), "marks"))
    reaches = window - prefix + 1
    held, now = Scratch(), suffixes(True)
    for width in [math.isqrt(reaches) + 1, 1] if any_over else []:
        turn = Scratch()
        longer = turn.written(_lengthened(now, width, window), "longer")
        held.drop()
        held = turn
        counts = longer.groupBy(*_DEALT).agg(F.sum("n").alias("times")).filter(F.col("times") > group).select(*_DEALT)
        large = held.written(counts, "large")
        small = large.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
        large = F.broadcast(large) if small else large
        marks.append(written(_trees(longer.join(large, _DEALT, "left_anti"), window, prefix), "marks"))
        now = longer.join(large, _DEALT, "left_semi")
        if width == 1:  # equal windows all, and more than one
            marks.append(written(now.select("rid", "pos", F.expr("shiftleft(1L, low)").alias("mask")), "marks"))
    held.drop()
    late.drop()
    every = marks[0]
    for some in marks[1:]:
        every = every.unionByName(some)
    of_row = every.groupBy(F.col("rid").alias("__rid")).agg(F.collect_set(F.struct("pos", "mask")).alias("marks"))
    return docs.join(of_row, docs["rid"] == of_row["__rid"], "left").drop("__rid")


def keep_words(data: bytes, marks: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    """Number of words, number of removed words, and the kept words joined by one space."""
    found = data.split()
    if not marks:
        return len(found), 0, b" ".join(found)
    starts = np.zeros(len(found), dtype=bool)
    pos = np.frombuffer(b"".join([m["pos"] for m in marks]), _POS)
    mask = np.repeat(np.array([m["mask"] for m in marks], np.int64), [len(m["pos"]) // _POS.itemsize for m in marks])
    for l in range(int(mask.max()).bit_length()):
        starts[pos[(mask >> l & 1).astype(bool)] - l] = True
    gone = words.covered(starts, window, len(found))
    return len(found), int(gone.sum()), b" ".join(found[i] for i in np.flatnonzero(~gone).tolist())


def with_rid(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with ``rid``, sixteen bytes that tell rows of unlike id or text apart."""
    whose = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    return df.withColumn("rid", F.unhex(F.md5(F.concat_ws("\n", whose, F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP, texts: bool = False) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed`` and ``kept_sha256`` of each row; with ``texts`` also ``kept``, the text that stays."""
    docs = with_rid(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    marked = mark(docs, "text", window=window, group=group).select("id", "text", "marks")
    kind = docs.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                data = batch.column(1).cast(pa.large_binary()).to_pylist()
                made = [keep_words(d or b"", m, window) for d, m in zip(data, batch.column(2).to_pylist(), strict=True)]
                columns = [batch.column(0), *(pa.array([m[i] for m in made], pa.int64()) for i in (0, 1))]
                columns.append(pa.array([hashlib.sha256(m[2]).hexdigest() for m in made]))
                yield pa.RecordBatch.from_arrays(columns + [pa.array([m[2].decode() for m in made])] * texts, names=["id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + texts])

    return marked.mapInArrow(tidy(run), out).withColumnRenamed("id", id_col)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with repeated runs taken out of its texts: a text that loses words becomes its kept words joined by one space,
    other texts stay as they are. A long column ``n_chars``, if any, is made to fit."""
    docs = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = with_rid(docs, "id", "text").drop("id")
    marked = mark(docs, "text", window=window).select("row", "text", "marks")
    out = add_columns(marked, ["text", "marks"], "kept string", lambda got: {"kept": [_kept(t, m, window) for t, m in zip(got["text"], got["marks"], strict=True)]}, 128)
    new = {text_col: F.col("kept")} | ({"n_chars": F.length("kept").cast("long")} if "n_chars" in df.columns else {})
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in df.columns])


def _kept(data: bytes | None, marks: list[dict] | None, window: int) -> str | None:
    if data is None or not marks:
        return None if data is None else data.decode()
    return keep_words(data, marks, window)[2].decode()


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
