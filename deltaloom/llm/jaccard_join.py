"""Near duplicates by Jaccard similarity of word shingles, found with PartEnum signatures.

Sets are put in bands of size, each band as wide as the threshold allows, and a pair within reach lies in one band or in two
adjacent ones. For two bands a threshold is a bound k on the symmetric difference. The features are dealt to n1 partitions of
n2 parts; with n1 > k / (k2 + 1) some partition differs in at most k2 features, so at most k2 of its parts differ and some
choice of n2 - k2 parts is equal in both sets. A signature is a hash of one such choice; every similar pair shares one. A
choice without a feature says nothing, so it is left out; ``spare`` more partitions than needed make up for that in any set
with at most so many partitions that have such a choice, and the few sets with more keep their empty choices: of a pair in
which both have more, both keep them. No similar pair is lost.

Texts with equal sets are one class, and only its least id goes on. Of all signatures those of two or more texts go on: they are
dealt by their value and counted. One that a sample shows to be frequent goes on untold and is dealt to PARTS parts, so that one
which very many texts share is no hot key. Signatures have 48 bits; equal ones of unlike texts cost a comparison, nothing else.

Classes that share a signature are compared exactly, but not all with all: in each bucket of a signature one member is compared with the rest, classes found linked become one
component, and pairs inside a component need no more comparison. A member that has met all of its bucket leaves it; after
HUB_ROUNDS such rounds, or one without a link, the members still open are narrowed by prefixes: with the features in one
order for all, the rarest among open members first, the first feature that two similar sets share is among the first
n - ceil(t * n) + 1 of the larger and the first n - ceil(2 * t / (1 + t) * n) + 1 of the smaller, with enough features after
it in both. Only pairs of different components that have such a feature are compared. So a large group of near copies costs about its size,
unlike texts around one passage are not paired all with all, and every similar pair has been compared or lies in one
component. Rarity is read from CELLS hashed counts; it steers cost, not results.

Before two sets are sent to each other, sizes out of reach and sketches out of reach end a comparison. A sketch has SKETCH bits,
each the parity of the features that fall on it, so two sketches differ in at most as many bits as the sets in features: the
bound on the symmetric difference holds for them too, and no similar pair is lost.

Null, empty and wordless texts have an empty set and are linked with nothing. Texts of fewer words than a shingle have their
whole sequence as one. Rows that repeat an id share a component. Other columns are not read. Ids of classes and candidates
are broadcast up to BROADCAST_IDS of them, as 8 bytes each or a string; beyond that, texts are joined by shuffle.
The sample for common features and signatures is SAMPLE texts of up to SAMPLE_CHARS characters; it steers cost, not results.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.llm import words
from deltaloom.llm.arrow import map_rows, tidy
from deltaloom.llm.components import components
from deltaloom.llm.shared import Scratch, least_keys, written

BROADCAST_IDS = 2_000_000
HUB_ROUNDS = 3
CELLS = 1 << 18
SKETCH = 512
LEAST_HOT = 20
PARTS = 1000
SAMPLE = 8000
SAMPLE_CHARS = 20_000
_U = np.uint64
_SIGNATURE = _U((1 << 48) - 1)


@dataclass(frozen=True)
class Scheme:
    """Signatures of one pair of adjacent bands."""

    band: int
    n1: int
    n2: int
    k2: int
    spare: int

    @property
    def choices(self) -> list[tuple[int, ...]]:
        return list(itertools.combinations(range(self.n2), self.n2 - self.k2))


def _weak_chance(features: float, n2: int, k2: int) -> float:
    """Chance that a partition with so many features on average has at most k2 parts with any."""
    empty = math.exp(-features / n2)
    return sum(math.comb(n2, i) * (1 - empty) ** i * empty ** (n2 - i) for i in range(k2 + 1))


def _scheme(band: int, k: int, smallest: int) -> Scheme:
    """The cheapest scheme with at least eight features to a signature of the smallest set, or the one with most of them
    among those of at most 1.6 signatures for each unit of k."""
    found = []
    for n2, k2 in ((1, 0), (3, 1), (4, 2), (5, 2), (6, 3)):
        need = k // (k2 + 1) + 1
        spare = 0
        for _ in range(8):
            mean = (need + spare) * _weak_chance(smallest / (need + spare), n2, k2)
            spare = min(need + 8, math.ceil(mean + 4 * math.sqrt(mean))) if mean > 1e-7 else 0
        n1 = need + spare
        cost = n1 * math.comb(n2, k2)
        features = smallest * (n2 - k2) / (n1 * n2)
        found.append((cost, features, Scheme(band, n1, n2, k2, spare)))
    enough = [x for x in found if x[1] >= 8 and x[2].k2]
    if enough:
        return min(enough, key=lambda x: x[0])[2]
    cheap = [x for x in found if x[0] <= 1.6 * (k + 1) + 4] or found[:1]
    return max(cheap, key=lambda x: x[1])[2]


@lru_cache(maxsize=8)
def _bands(part: int, whole: int, largest: int) -> tuple[list[int], list[Scheme | None]]:
    """First sizes of the bands, and the scheme of each band with the one below; None where only equal sets are similar.

    A scheme finds pairs of both bands and pairs inside the lower one; those inside the upper are the next scheme's."""
    firsts, schemes, low, below = [], [], 1, 1
    while True:
        high = low * whole // part
        k = (low - 1 + high) * (whole - part) // (whole + part)  # of the largest sets of both bands
        schemes.append(_scheme(len(firsts), k, below) if k else None)
        firsts.append(low)
        if low > largest:
            return firsts, schemes
        below, low = low, high + 1


def bands(part: int, whole: int, size: int) -> tuple[list[int], list[Scheme | None]]:
    return _bands(part, whole, 1 << max(12, (size * whole // part).bit_length()))


def signatures(features: np.ndarray, part: int, whole: int, common: np.ndarray | None = None) -> np.ndarray:
    """Signatures of a set of feature hashes, for a threshold of ``part`` / ``whole``, over its features not in ``common``
    (sorted): two sets differ no more outside ``common`` than on the whole."""
    n = len(features)
    if not n:
        return np.empty(0, _U)
    firsts, schemes = bands(part, whole, n)
    band = int(np.searchsorted(firsts, n, side="right")) - 1
    if common is not None and len(common):
        at = np.minimum(np.searchsorted(common, features), len(common) - 1)
        features = features[common[at] != features]
    return np.concatenate([_of_scheme(features, s) for s in schemes[band : band + 2] if s] or [np.empty(0, _U)])


def common_features(sets: DataFrame, least: int = 5) -> np.ndarray:
    """Features, sorted, of at least ``least`` of ``sets`` (features) whose least features mostly differ: passages that unlike
    texts share, not the features of one group of near copies. ``sets`` is a sample, so that its features are few."""

    def spread(batches):
        for batch in batches:
            for s in batch.column(0):
                x = np.frombuffer(s.as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x[0] if len(x) else 0)), pa.array(x)], names=["owner", "feature"])

    each = sets.select("features").mapInArrow(tidy(spread), "owner long, feature long").groupBy("feature", "owner").agg(F.count(F.lit(1)).alias("n"))
    both = each.groupBy("feature").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("n")).filter(f"owners >= {least} AND 2 * owners >= n")
    return np.sort(both.select("feature").toArrow().column(0).to_numpy().astype(np.int64).view(_U))


def _of_scheme(x: np.ndarray, s: Scheme) -> np.ndarray:
    first = ((x >> _U(32)) * _U(s.n1) >> _U(32)).astype(np.int64)
    cell = first * s.n2 + ((x & _U(0xFFFFFFFF)) * _U(s.n2) >> _U(32)).astype(np.int64)
    code = words.mix(x)
    cells = s.n1 * s.n2
    low = np.bincount(cell, (code & _U(0xFFFFFFFF)).astype(np.float64), cells).astype(_U)  # exact below 2**21 features
    high = np.bincount(cell, (code >> _U(32)).astype(np.float64), cells).astype(_U)
    total = (low + high * _U(0x9E3779B97F4A7C15)).reshape(s.n1, s.n2)
    some = np.bincount(cell, minlength=cells).reshape(s.n1, s.n2) > 0
    keep_empty = int(np.count_nonzero(some.sum(axis=1) <= s.k2)) > s.spare
    out = []
    for c, choice in enumerate(s.choices):
        tag = words.mix(np.arange(s.n1, dtype=_U) * _U(64) + _U(c) + _U(s.band << 40))
        made = words.mix(total[:, choice].sum(axis=1, dtype=_U) ^ tag)
        out.append(made if keep_empty else made[some[:, choice].any(axis=1)])
    return np.concatenate(out)


def _class_key(features: np.ndarray) -> bytes:
    """Sixteen bytes that tell sets apart."""
    a = words.mix(features).sum(dtype=_U)
    b = words.mix(features ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U)
    return np.array([a, b ^ _U(len(features))], dtype=_U).tobytes()


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` with (left_semi) or without (left_anti) ``ids``, a written table."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "id", how)


def _first_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """One text, of up to SAMPLE_CHARS characters, of each id of ``sample`` (at most SAMPLE)."""
    short = docs.filter(F.length("text") <= SAMPLE_CHARS)
    return short.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"))


def sketch(features: np.ndarray) -> bytes:
    """Parities of the features on SKETCH bits."""
    bits = np.bincount((words.mix(features ^ _U(0x5BD1E9955BD1E995)) % _U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _in_reach(pairs: DataFrame, sketches: DataFrame, part: int, whole: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and sketches (id, n, sketch) allow that they are similar."""
    right = pairs.join(sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")
    both = right.join(sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
    sized = both.filter(F.least("n_a", "n_b") * whole >= F.greatest("n_a", "n_b") * part)

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), _U).reshape(batch.num_rows, -1) for i in (3, 4))
                apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                keep = apart * (whole + part) <= (whole - part) * batch.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    kind = pairs.schema["a"].dataType.simpleString()
    return sized.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "sketch_a", "sketch_b").mapInArrow(tidy(near), f"a {kind}, b {kind}")


def _linked(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar, as (u, v)."""
    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("features").alias("set_b")), "b")
    both = right.join(sets.select(F.col("id").alias("a"), F.col("features").alias("set_a")), "a")

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=_U) for s in (x, y))
                joined = np.sort(np.concatenate([x, y]))
                shared = int(np.count_nonzero(joined[1:] == joined[:-1]))
                keep.append(whole * shared >= part * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "set_a", "set_b").mapInArrow(tidy(compare), f"u {kind}, v {kind}")


def _cell(features: np.ndarray) -> np.ndarray:
    return (words.mix(features) % _U(CELLS)).astype(np.int64)


def prefix(features: np.ndarray, counts: np.ndarray, part: int, whole: int) -> np.ndarray:
    """The features of a set that come first, rarest first by ``counts`` of cells: one of them is in every similar set's."""
    n = len(features)
    length = n + part * -n // whole + 1
    return features[np.lexsort((features, counts[_cell(features)]))[:length]]


def _by_prefix(members: DataFrame, sets: DataFrame, part: int, whole: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of ``members`` (id, component) of different components that share a feature of their prefixes."""
    own = scratch.written(sets.join(members, "id"), "members")

    def count(batches):
        seen = np.zeros(CELLS, np.int64)
        for batch in batches:
            for s in batch.column(0):
                np.add.at(seen, _cell(np.frombuffer(s.as_buffer(), dtype=_U)), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["cell", "times"])

    cells = own.select("features").mapInArrow(tidy(count), "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times"))
    counts = np.zeros(CELLS, np.int64)
    table = cells.toArrow()  # CELLS rows at most
    counts[table.column("cell").to_numpy()] = table.column("times").to_numpy()

    def head(got: dict[str, list]) -> dict[str, list]:
        heads = [prefix(np.frombuffer(s, dtype=_U), counts, part, whole).view(np.int64) for s in got["features"]]
        return {"id": got["id"], "component": got["component"], "n": got["n"], "heads": heads}

    kind = members.schema["id"].dataType.simpleString()
    spelled = map_rows(own, ["id", "component", "n", "features"], f"id {kind}, component {kind}, n long, heads array<long>", head, 64)
    rows = scratch.written(spelled.select("id", "component", "n", F.posexplode("heads").alias("at", "feature")), "prefixes")
    a, b = (rows.select("feature", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "n", "at"))) for x in "ab")
    both = part + whole
    a = a.filter(f"at_a <= n_a - ({2 * part} * n_a + {both - 1}) div {both}")
    ordered = f"(n_a < n_b OR n_a = n_b AND id_a < id_b) AND n_a * {whole} >= n_b * {part}"
    enough = f"least(n_a - at_a, n_b - at_b) * {both} >= {part} * (n_a + n_b)"
    met = a.join(b, "feature").filter(f"component_a <> component_b AND {ordered} AND {enough}")
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _in_components(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """``buckets`` (sig, id, n) still to compare: with the component of each member, without buckets of one component."""
    of = buckets.join(found.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    ends = of.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return of.join(ends.filter("low <> high").select("sig"), "sig").select("sig", "id", "n", "component")


def _hot_signatures(signed: DataFrame) -> np.ndarray:
    """Signatures, sorted, of at least LEAST_HOT texts of a sample."""
    often = signed.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_HOT)
    return np.sort(often.select("sig").toArrow().column(0).to_numpy().astype(np.int64).view(_U))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, part: int = 80, whole: int = 100, fold_case: bool = True
) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` of each row: the least id that links of at least ``part`` / ``whole``
    between sets of ``k``-word shingles reach, A-Z in lower case with ``fold_case``."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def features(t: bytes | None) -> np.ndarray:
        return words.shingles((t or b"").lower() if fold_case else t or b"", k)

    def classify(got: dict[str, list]) -> dict[str, list]:
        sets = [features(t) for t in got["text"]]
        return {"id": got["id"], "n": [len(s) for s in sets], "key": [_class_key(s) if len(s) else None for s in sets]}

    def spell(got: dict[str, list]) -> dict[str, list]:
        sets = [features(t) for t in got["text"]]
        return {"id": got["id"], "n": [len(s) for s in sets], "sketch": [sketch(s) for s in sets], "features": [s.tobytes() for s in sets]}

    scratch, spelling = Scratch(), f"id {kind}, n long, sketch binary, features binary"
    classes = written(map_rows(docs, ["id", "text"], f"id {kind}, n long, key binary", classify), "classes")
    least = classes.filter("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_rows"))
    firsts = written(least.select("key", "first", "n_rows"), "firsts")
    copied = classes.join(firsts.filter("n_rows > 1"), "key").filter("id <> first").select("id").distinct()
    copies = scratch.written(copied.join(firsts.select(F.col("first").alias("id")), "id", "left_anti"), "copies")

    sample = least_keys(firsts, "key", SAMPLE, firsts.count()).select(F.col("first").alias("id"))
    sampled = scratch.written(map_rows(_first_texts(docs, sample), ["id", "text"], spelling, spell, 64), "sample")
    common = common_features(sampled)

    def signatures_of(s: np.ndarray) -> np.ndarray:
        return np.unique(signatures(s, part, whole, common) & _SIGNATURE)

    def sign_sets(got: dict[str, list]) -> dict[str, list]:
        return {"sigs": [signatures_of(np.frombuffer(s, _U)).view(np.int64) for s in got["features"]]}

    hot = _hot_signatures(map_rows(sampled, ["features"], "sigs array<long>", sign_sets, 64))

    def sign(got: dict[str, list]) -> dict[str, list]:
        """A signature's high bits are 0, or for a hot one the part, 1 to PARTS, that the text is dealt to."""
        sets, sigs = [features(t) for t in got["text"]], []
        for x in sets:
            code = signatures_of(x)
            if len(hot) and len(code):
                dealt = (words.mix(x[:1]) % _U(PARTS) + _U(1)) << _U(48)
                code = np.where(hot[np.minimum(np.searchsorted(hot, code), len(hot) - 1)] == code, code | dealt, code)
            sigs.append(code.view(np.int64))
        return {"id": got["id"], "n": [len(x) for x in sets], "sigs": sigs}

    to_sign = _only(docs.filter("id IS NOT NULL"), copies, "left_anti")
    signed = map_rows(to_sign, ["id", "text"], f"id {kind}, n long, sigs array<long>", sign, 64).select("id", "n", F.explode("sigs").alias("code"))
    times = signed.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("code")))
    sig = F.col("code").bitwiseAND(F.lit(int(_SIGNATURE)))
    buckets = scratch.written(times.filter((F.col("times") > 1) | (F.col("code") != sig)).select(sig.alias("sig"), "id", "n"), "buckets")
    candidates = scratch.written(buckets.select("id").distinct(), "candidates")
    sets = scratch.written(map_rows(_only(docs, candidates, "left_semi"), ["id", "text"], spelling, spell, 64), "sets")

    found = df.sparkSession.createDataFrame([], f"id {kind}, component {kind}")
    open_, last = buckets.withColumn("component", F.col("id")), False
    mine, its = Scratch(), Scratch()  # tables of the last components, and of the round
    for round_ in itertools.count():
        before, its = its, Scratch()
        if round_:
            open_ = its.written(open_, "open")
            before.drop()
        if open_.isEmpty():
            break
        if last:
            pairs = _by_prefix(open_.select("id", "component").distinct(), sets.select("id", "n", "features"), part, whole, its)
        else:
            if round_ == 0:
                hubs = open_.groupBy("sig").agg(F.min("id").alias("hub"), F.min("id").alias("hub_component"), F.min_by("n", "id").alias("hub_n"))
            else:
                sizes = open_.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("size"))
                main = sizes.groupBy("sig").agg(F.max(F.struct("size", "component")).alias("most")).select("sig", F.col("most.component").alias("main"))
                outside = open_.join(main, "sig").filter("component <> main").groupBy("sig").agg(F.min(F.struct("id", "component", "n")).alias("h"))
                hubs = outside.select("sig", F.col("h.id").alias("hub"), F.col("h.component").alias("hub_component"), F.col("h.n").alias("hub_n"))
            met = open_.join(hubs, "sig").filter("component <> hub_component" if round_ else "id <> hub")
            met = met.filter(F.least("n", "hub_n") * whole >= F.greatest("n", "hub_n") * part)
            pairs = met.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
        reach = its.written(_in_reach(pairs, sets.select("id", "n", "sketch"), part, whole).distinct(), "reach")
        linked = its.written(_linked(reach, sets.select("id", "features"), part, whole), "linked")
        none = linked.isEmpty()
        if not none:
            now = Scratch()
            found = components(linked.unionByName(found.select(F.col("id").alias("u"), F.col("component").alias("v"))), now)
            mine.drop()
            mine = now
        if last:
            break
        last = none or round_ + 1 >= HUB_ROUNDS
        rest = open_.join(hubs.select("sig", F.col("hub").alias("id")), ["sig", "id"], "left_anti")
        open_ = _in_components(rest.select("sig", "id", "n"), found)

    its.drop()
    scratch.drop()  # the result reads classes, firsts and the last components
    of_class = firsts.join(found.withColumnRenamed("id", "first"), "first", "left").select("key", F.coalesce("component", "first").alias("component"))
    return classes.join(of_class, "key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def _with_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with ``__key``: the id, or a hash of id and text, above all but very large ids, where the id is null or other
    texts have it too. Rows of equal id and text, and only they, have the same key."""
    shape = F.xxhash64(F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    shared = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__shared")).agg(F.min(shape).alias("low"), F.max(shape).alias("high"))
    shared = written(shared.filter("low <> high").select("__shared"), "shared_ids")
    small = shared.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    if df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        own, made = F.col(id_col).cast("long"), F.shiftrightunsigned(shape, 4) + F.lit(0x7 << 60)
    else:
        own, made = F.col(id_col).cast("string"), F.concat(F.lit("\U0010ffff"), F.hex(shape))
    both = df.join(F.broadcast(shared) if small else shared, df[id_col] == F.col("__shared"), "left")
    return both.withColumn("__key", F.when(F.col(id_col).isNull() | F.col("__shared").isNotNull(), made).otherwise(own)).drop("__shared")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """One row of ``df`` of each group of near duplicates, that of the least id; rows of equal id and text, and rows without an
    id, are members as all others. Unlike texts stay, whether they share an id or not."""
    keyed = _with_key(df, id_col, text_col)
    found = near_duplicates(keyed, "__key", text_col, k, part, whole)
    rows = found.groupBy(F.col("__key").alias("__of")).agg(F.max(F.col("component_id") != F.col("__key")).alias("__gone"), F.count(F.lit(1)).alias("n"))
    fate = written(rows.filter("__gone OR n > 1").select("__of", "__gone"), "fate")
    small = fate.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    judged = keyed.join(F.broadcast(fate) if small else fate, F.col("__key") == F.col("__of"), "left")
    out = judged.filter("__of IS NULL").select(*df.columns)
    if fate.filter("NOT __gone").isEmpty():
        return out
    several = judged.filter("NOT __gone").groupBy("__key").agg(F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("row"))
    return out.unionByName(several.select("row.*"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, part=90, whole=100)
