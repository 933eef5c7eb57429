"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of the word given the one before, of the word alone, and a uniform share. The
weights depend on the bucket of the context's frequency (its binary logarithm) and are learned by expectation-maximisation
on held-out counts: the counts of all training documents with each token's own occurrence deleted.

Counts cover every training document. Documents are dealt by row to batches of about BATCH tokens in a written table, so that
repeated rows spread and a batch is the same in every reading; a batch looks the
distinct words and word pairs of its documents up together: keys of 64 hash bits are dealt to buckets of about BUCKET keys,
a batch sends each bucket one row with its keys and their training occurrences, the bucket adds them up and sends back the
counts, in the order in which the batch asked. Keys that
a sample shows to be frequent (HOT at most) are counted before the shuffle and known to every task, so no bucket fills with
one key; the sample steers cost, not results.

Null and empty texts are one end token. Rows that repeat id and text each count as a document and get equal scores. A null id
is a training row. An empty table gives no rows; without training tokens every estimate but the uniform one is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from deltaloom.llm import words
from deltaloom.llm.arrow import schema
from deltaloom.llm.shared import Scratch, bound_batches, least_keys, written
from deltaloom.llm.substring_dedup import with_rid

BUCKET = 3_000_000
BATCH = 1_000_000
HOT = 65_536
SAMPLE = 4_000
SAMPLE_CHARS = 20_000
LEAST_HOT = 20
STEPS = 4  # bins for each factor of two of a probability, when weights are learned
_U = np.uint64
_START, _END = (words.mix(np.array([x], dtype=_U)) for x in (0x5354415254, 0x454E44))
_LOW = _U((1 << 48) - 1)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def keys(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token (words in lower case, then the end): its key, its context's key, and the key of both."""
    token = np.concatenate((words.hash_words(data.lower())[0], _END))
    before = np.concatenate((_START, token[:-1]))
    pair = words.mix(before * _U(0x9E3779B97F4A7C15) + token) | _U(1)
    return token & ~_U(1), before & ~_U(1), pair


class Batch:
    """Keys of the documents of a batch: ``cold`` has those that are not hot, sorted by bucket (that is, by value)."""

    def __init__(self, texts: pa.Array, hot: np.ndarray):
        found = [keys(t.as_py() or b"") for t in texts.cast(pa.large_binary())]
        self.lengths = np.array([len(f[0]) for f in found])
        self.token, _, self.pair = (np.concatenate(x) for x in zip(*found, strict=True))
        both = np.concatenate((self.token, self.pair))
        self.key, self.place = np.unique(both, return_inverse=True)
        self.warm, self.warm_at = _in(self.key, hot)
        self.cold = self.key[~self.warm]

    def training(self, train: list[bool]) -> np.ndarray:
        """Occurrences of each cold key in training documents."""
        learn = np.tile(np.array(train, dtype=bool).repeat(self.lengths), 2)
        return np.bincount(self.place[learn], minlength=len(self.key))[~self.warm]

    def counts(self, replies: pa.Table, hot_counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of each token and each pair."""
        edges = np.searchsorted(_bucket(self.cold, buckets), np.arange(buckets + 1))
        cold = np.zeros(len(self.cold), dtype=np.int64)
        for b, c in zip(replies.column("bucket").to_pylist(), replies.column("counts").to_pylist(), strict=True):
            cold[edges[b] : edges[b + 1]] = unpack(c, int(edges[b + 1] - edges[b]))
        of = np.zeros(len(self.key), dtype=np.int64)
        of[~self.warm] = cold
        if len(hot_counts):
            of[self.warm] = hot_counts[self.warm_at[self.warm]]
        n = len(self.token)
        return of[self.place[:n]], of[self.place[n:]]


def _in(key: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``key`` are in the sorted ``table``, and where."""
    if not len(table):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return table[at] == key, at


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def pack(counts: np.ndarray) -> bytes:
    """A byte for each count, 255 for those that follow as four bytes."""
    big = counts >= 255
    return np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype("<u4").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, dtype="<u4", offset=n)
    return out


def _hot_keys(docs: DataFrame) -> np.ndarray:
    """Keys that occur at least LEAST_HOT times in a sample of SAMPLE documents, HOT of them at most."""
    short = docs.filter(F.length("text") <= SAMPLE_CHARS)
    sample = least_keys(short.select("rid", "text"), "rid", SAMPLE, docs.count()).select("text")
    parts = [np.concatenate((t, p)) for t, _, p in (keys((r[0] or "").encode()) for r in sample.toLocalIterator())]
    if not parts:
        return np.empty(0, _U)
    key, times = np.unique(np.concatenate(parts), return_counts=True)
    key, times = key[times >= LEAST_HOT], times[times >= LEAST_HOT]
    return np.sort(key[np.argsort(-times, kind="stable")[:HOT]])


_SUMS = schema("place long, n long")


def _count_hot(hot: np.ndarray) -> Callable:
    """Training occurrences of each hot key, of tokens (place -1), of documents (-2), and tokens of all documents (-3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(hot) + 3, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary())
            for text, train in zip(texts, batch.column(1).to_pylist(), strict=True):
                token, _, pair = keys(text.as_py() or b"")
                counts[-3] += len(token)
                if train:
                    there, at = _in(np.concatenate((token, pair)), hot)
                    counts[: len(hot)] += np.bincount(at[there], minlength=len(hot)) if len(hot) else 0
                    counts[-1] += len(token)
                    counts[-2] += 1
        place = np.flatnonzero(counts)
        made = np.where(place < len(hot), place, place - len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(made), pa.array(counts[place])], schema=to_arrow_schema(_SUMS))

    return run


_ASKED = schema("bucket int, batch long, keys binary, times binary")
_ANSWERS = schema("batch long, bucket int, counts binary, new_words long")


def _ask(hot: np.ndarray, buckets: int) -> Callable:
    def run(docs: pa.Table) -> pa.Table:
        batch = Batch(docs.column("text").combine_chunks(), hot)
        times = batch.training([not h for h in docs.column("held_out").to_pylist()])
        packed = np.ascontiguousarray((batch.cold & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
        bucket = _bucket(batch.cold, buckets)
        edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
        spans = list(zip(edges, edges[1:]))
        columns = [
            [int(bucket[a]) for a, _ in spans], [docs.column("batch")[0].as_py()] * len(spans),
            [packed[6 * a : 6 * z] for a, z in spans], [pack(times[a:z]) for a, z in spans],
        ]
        to = to_arrow_schema(_ASKED)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to, strict=True)], schema=to)

    return run


def _unpack_keys(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(data)
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8")[:, 0].astype(_U), np.array([len(d) // 6 for d in data])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come bucket by bucket, to the training counts of each row's keys; with a bucket's first row its number of
    distinct training words."""
    to = to_arrow_schema(_ANSWERS)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        data, times = table.column("keys").to_pylist(), table.column("times").to_pylist()
        key, sizes = _unpack_keys(data)
        weight = np.concatenate([unpack(x, n) for x, n in zip(times, sizes.tolist(), strict=True)])
        known, place = np.unique(key, return_inverse=True)
        total = np.bincount(place, weight).astype(np.int64)  # exact below 2**53
        counts, ends = total[place], np.cumsum(sizes)
        made = [pack(counts[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        new = np.zeros(len(made), dtype=np.int64)
        new[0] = np.count_nonzero(((known & _U(1)) == 0) & (total > 0))
        columns = [table.column("batch").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(made, pa.binary()), pa.array(new)]
        yield from pa.Table.from_arrays(columns, schema=to).to_batches(max_chunksize=16_384)

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        ids = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                if held and ids[a] != now:
                    yield from flush(held)
                    held = []
                now = ids[a]
                held.append(batch.slice(a, z - a))
    if held:
        yield from flush(held)


class Counts:
    """Training counts of one document's tokens, contexts and pairs."""

    def __init__(self, token: np.ndarray, pair: np.ndarray, documents: int):
        self.token, self.pair = token, pair
        self.context = np.concatenate(([documents], token[:-1]))


def parts(c: Counts, n: int, deleted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context bucket, pair estimate and word estimate of each token; ``deleted``: without the token's own occurrence."""
    less = 1 if deleted else 0
    context = c.context - less
    bucket = np.floor(np.log2(np.maximum(context, 0) + 1)).astype(np.int64)
    pair = np.where(context > 0, np.maximum(c.pair - less, 0) / np.maximum(context, 1), 0.0)
    word = np.maximum(c.token - less, 0) / max(n - less, 1)
    return bucket, pair, word


def _bin(p: np.ndarray) -> np.ndarray:
    """Steps below 1 of a probability; -1 for 0."""
    return np.where(p > 0, np.round(-STEPS * np.log2(np.maximum(p, 1e-300))), -1).astype(np.int64)


def learn_weights(bins: list[tuple[int, int, int, int]], vocabulary: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, [pair, word, uniform]) by expectation-maximisation over (bucket, pair bin, word bin, tokens)."""
    table = np.array(bins, dtype=np.float64).reshape(-1, 4)
    out = np.tile([0.3, 0.5, 0.2], (64, 1))
    out[0] = [0.0, 0.8, 0.2]
    estimates = np.where(table[:, 1:3] < 0, 0.0, 2.0 ** (-table[:, 1:3] / STEPS))
    estimates = np.column_stack([estimates, np.full(len(table), 1 / (vocabulary + 1))])
    for b in np.unique(table[:, 0]).astype(int):
        mine = table[:, 0] == b
        e, times = estimates[mine], table[mine, 3]
        w = np.array([0.3, 0.5, 0.2]) if b else np.array([0.0, 0.8, 0.2])
        for _ in range(rounds):
            share = w * e
            w = (share / share.sum(axis=1, keepdims=True) * times[:, None]).sum(axis=0)
            w = (w + [0.0, 0.5, 0.5]) / (w.sum() + 1.0)  # no weight of word and uniform shrinks to 0
        out[b] = w
    return out


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET, batch_tokens: int = BATCH) -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row."""
    named = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = with_rid(named, "id", "text").withColumn("held_out", held_out("id")).select("id", "rid", "text", "held_out")
    bound_batches(df.sparkSession)
    scratch = Scratch()
    hot = _hot_keys(docs)
    sums = docs.select("text", ~F.col("held_out")).mapInArrow(_count_hot(hot), _SUMS).groupBy("place").agg(F.sum("n").alias("n"))
    place = {r["place"]: r["n"] for r in sums.collect()}  # one row for each hot key at most
    hot_counts = np.array([place.get(i, 0) for i in range(len(hot))], dtype=np.int64)
    n, documents = place.get(-1, 0), place.get(-2, 0)
    tokens = place.get(-3, 0)
    buckets = max(1, -(-2 * tokens // bucket_keys))
    batches = max(1, -(-tokens // batch_tokens))
    dealt = F.pmod(F.xxhash64("rid", F.monotonically_increasing_id()), F.lit(batches))
    docs = written(docs.select("id", "text", "held_out", dealt.alias("batch")), "dealt")
    asked = docs.select("batch", "text", "held_out").groupBy("batch").applyInArrow(_ask(hot, buckets), _ASKED)
    answers = written(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, _ANSWERS), "answers")
    new_words = answers.agg(F.sum("new_words")).first()[0] or 0
    vocabulary = int(new_words) + int(np.count_nonzero(hot_counts[(hot & _U(1)) == 0])) if len(hot) else int(new_words)
    replies = answers.select("batch", "bucket", "counts")

    def counts_of(some: pa.Table, answered: pa.Table) -> Iterator[Counts]:
        batch = Batch(some.column("text").combine_chunks(), hot)
        token, pair = batch.counts(answered, hot_counts, buckets)
        ends = np.cumsum(batch.lengths)
        for a, z in zip((ends - batch.lengths).tolist(), ends.tolist(), strict=True):
            yield Counts(token[a:z], pair[a:z], documents)

    def bin_counts(some: pa.Table, answered: pa.Table) -> pa.Table:
        seen = [np.zeros(0, np.int64)]
        for c, held in zip(counts_of(some, answered), some.column("held_out").to_pylist(), strict=True):
            if held:
                continue
            bucket, pair, word = parts(c, n, deleted=True)
            seen.append((bucket << 40) + ((_bin(pair) + 1) << 20) + _bin(word) + 1)
        code, times = np.unique(np.concatenate(seen), return_counts=True)
        return pa.table({"code": code, "times": times})

    binned = docs.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(bin_counts, "code long, times long")
    binned = scratch.written(binned.groupBy("code").agg(F.sum("times").alias("times")), "bins")  # written, so that its shuffle files go
    split = [(r[0] >> 40, ((r[0] >> 20) & 0xFFFFF) - 1, (r[0] & 0xFFFFF) - 1, r[1]) for r in binned.collect()]  # bounded by the bins
    scratch.drop()
    weights = learn_weights(sorted(split), vocabulary)

    def score_rows(some: pa.Table, answered: pa.Table) -> pa.Table:
        rows = []
        for c in counts_of(some, answered):
            bucket, pair, word = parts(c, n, deleted=False)
            w = weights[bucket]
            p = w[:, 0] * pair + w[:, 1] * word + w[:, 2] / (vocabulary + 1)
            base = np.log10((c.token + 1) / (n + vocabulary + 1))
            rows.append((len(word), int(np.count_nonzero(c.token)), n, float(base.sum()), float(np.log10(p).sum())))
        columns = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.float64()) for i in range(5)]
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.Table.from_arrays([some.column("id"), some.column("held_out"), *columns], names=names)

    kind = docs.schema["id"].dataType.simpleString()
    out = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(score_rows, out).withColumnRenamed("id", id_col)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
