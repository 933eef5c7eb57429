"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, all of them. A passage is encoded from shares of letter cases, digits,
symbols, stops, distinct and repeated words, and from a hashed bag of its words; a hidden layer turns it into a vector.
Gated attention, learned from document labels alone, weighs the passages; the score is a logistic function of the weighted
vector. Labels, language, source and ids are never inputs.

Training is on the driver, in numpy, over a bounded sample of labelled rows: at most ``train_docs`` documents, taken in the order
of a hash of their id as long as all their passages fit into ``train_passages`` in total; a text is trained on whole or not at
all. Scoring covers every passage of every text, in one pass without a shuffle. A label that is null or whose id is null is not
used; repeated labels of an id count as the least, repeated documents of an id as the least text. Null and empty texts are one
passage of zeros and get a score like any other. Without a usable label every score is 0.5. An empty table gives no rows. Other
columns pass through; one named like the new column is replaced. Scores are rounded to six places, so that batching does not
show in them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import words
from deltaloom.llm.arrow import add_columns, map_rows
from deltaloom.llm.shared import Scratch

PASSAGE = 64
BAG = 128
SHARES = 14
WIDTH = BAG + SHARES
HIDDEN = 32
GATE = 16


def _kind(members: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(members.encode())] = 1
    return out


_UPPER = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _kind("abcdefghijklmnopqrstuvwxyz")
_LOWER[128:] = 1
_KINDS = np.stack([_UPPER, _LOWER, _kind("0123456789"), _kind("#*$%&|<>=+@^~_{}[]\\/"), _kind(".,;:"), _kind("!?"), _kind("\"'()-")])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def passages(data: bytes) -> np.ndarray:
    """One row of WIDTH features for each passage."""
    h, start, end = words.hash_words(data)
    n = len(h)
    if not n:
        return np.zeros((1, WIDTH), dtype=np.float32)
    b = np.frombuffer(data, dtype=np.uint8)
    first = np.arange(0, n, PASSAGE)
    out = np.zeros((len(first), WIDTH), dtype=np.float32)
    for group in range(0, len(first), 256):  # bounded memory for very long texts
        _encode(out[group : group + 256], first[group : group + 256], h, start, end, b)
    return out


def _encode(out: np.ndarray, first: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, b: np.ndarray) -> None:
    last = np.minimum(first + PASSAGE, len(h))
    size = last - first
    at = np.arange(len(out)).repeat(size)
    word = np.arange(len(at)) + (first - np.concatenate(([0], np.cumsum(size)[:-1]))).repeat(size)
    hw = h[word]
    np.add.at(out, (at, (hw & np.uint64(BAG - 1)).astype(np.int64)), np.where(hw >> np.uint64(63), 1.0, -1.0))
    out[:, :BAG] /= np.sqrt(size)[:, None] * 4
    shares = out[:, BAG:]
    low, high = start[first[0]], end[last[-1] - 1]
    span_start, span_end = start[first] - low, end[last - 1] - low
    chars = np.maximum(span_end - span_start, 1)
    part = b[low:high]
    for k, kind in enumerate(_KINDS):
        total = np.concatenate(([0], np.cumsum(kind[part])))
        shares[:, k] = (total[span_end] - total[span_start]) / chars
    length = (end - start)[word]
    shares[:, 7] = np.bincount(at, length, len(out)) / size / 20
    order = np.lexsort((hw, at))
    ranked_h, ranked_at = hw[order], at[order]
    repeat = (ranked_h[1:] == ranked_h[:-1]) & (ranked_at[1:] == ranked_at[:-1])
    shares[:, 8] = np.bincount(ranked_at[1:][repeat], minlength=len(out)) / size
    twin = (hw[1:] == hw[:-1]) & (at[1:] == at[:-1])
    shares[:, 9] = np.bincount(at[1:][twin], minlength=len(out)) / size
    tail = b[end[word] - 1]
    shares[:, 10] = np.bincount(at, (_UPPER[tail] + _LOWER[tail]) == 0, len(out)) / size
    head = b[start[word]]
    shares[:, 11] = np.bincount(at, (_UPPER[head] + _LOWER[head]) == 0, len(out)) / size
    shares[:, 12] = np.bincount(at, length == 1, len(out)) / size
    shares[:, 13] = size / PASSAGE


@dataclass
class Model:
    """Weights of the encoder (w1, b1), of the gated attention (v, u, w) and of the score (c, d)."""

    p: dict[str, np.ndarray]

    @classmethod
    def start(cls, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"w1": normal(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "v": normal(HIDDEN, GATE), "u": normal(HIDDEN, GATE)}
        return cls(p | {"w": normal(GATE, 1)[:, 0], "c": np.zeros(HIDDEN, np.float32), "d": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        """``x``: passages of all documents one after another; ``sizes``: how many each has, at least one."""
        p = self.p
        ends = np.cumsum(sizes)
        starts = ends - sizes
        doc = np.arange(len(sizes)).repeat(sizes)
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        a = e / np.add.reduceat(e, starts)[doc]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        logit = np.clip(z @ p["c"] + p["d"][0], -30, 30)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "doc": doc, "starts": starts, "score": 1 / (1 + np.exp(-logit))}

    def gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, sizes)
        h, t, g, a, doc = f["h"], f["t"], f["g"], f["a"], f["doc"]
        error = ((f["score"] - y) / len(y)).astype(np.float32)
        dz = error[:, None] * p["c"]
        da = (dz[doc] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, f["starts"])[doc])
        gate = de[:, None] * p["w"]
        dt, dg = gate * g * (1 - t * t), gate * t * g * (1 - g)
        dh = (a[:, None] * dz[doc] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        out = {"w1": x.T @ dh, "b1": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ error, "d": error.sum(keepdims=True)}
        return {k: v + decay * p[k] for k, v in out.items()}

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.round(self.forward(x, sizes)["score"].astype(np.float64), 6)


def train(bags: list[np.ndarray], labels: list[int], epochs: int = 20, rate: float = 0.004, decay: float = 1e-5, seed: int = 11) -> Model:
    """Adam over batches of documents; the same bags in the same order give the same model."""
    model = Model.start(seed)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    y = np.array(labels, dtype=np.float32)
    step = 0
    for _ in range(epochs if bags else 0):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            grad = model.gradient(np.concatenate([bags[i] for i in pick]), np.array([len(bags[i]) for i in pick]), y[pick], decay)
            step += 1
            for k, d in grad.items():
                m[k] += 0.1 * (d - m[k])
                s[k] += 0.01 * (d * d - s[k])
                model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str) -> Column:
    """Rows that training never sees: the CRC-32 of the id's text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _that_fit(sizes: list[tuple], most: int) -> list:
    """Ids of (id, passages) in their order, as long as they add up to ``most``; one too large for what is left is passed over."""
    out, left = [], most
    for id_, n in sizes:
        if n <= left:
            out.append(id_)
            left -= n
    return out


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 4000, train_passages: int = 200_000) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out."""
    scratch = Scratch()
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    texts = scratch.written(  # at most train_docs ids, so the broadcast is bounded
        docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "labelled"
    )

    def count(got: dict[str, list]) -> dict[str, list]:
        return {"doc_id": got["doc_id"], "n": [max(1, -(-len((t or b"").split()) // PASSAGE)) for t in got["text"]]}

    def rows(got: dict[str, list]) -> dict[str, list]:
        return {k: got[k] for k in ("doc_id", "quality")} | {"bag": [passages(t or b"").tobytes() for t in got["text"]]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    sizes = map_rows(texts, ["doc_id", "text"], f"doc_id {kind}, n long", count).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    chosen = docs.sparkSession.createDataFrame([(i,) for i in _that_fit(sizes, train_passages)], f"doc_id {kind}")
    made = map_rows(texts.join(F.broadcast(chosen), "doc_id"), ["doc_id", "quality", "text"], f"doc_id {kind}, quality int, bag binary", rows, 16)
    found = sorted(map(tuple, made.collect()))
    scratch.drop()
    return train([np.frombuffer(b, dtype=np.float32).reshape(-1, WIDTH) for _, _, b in found], [q for _, q, _ in found])


def _score_texts(model: Model, texts: list[bytes | None]) -> list[float]:
    bags = [passages(t or b"") for t in texts]
    out: list[float] = []
    for at in range(0, len(bags), 32):
        part = bags[at : at + 32]
        out += model.scores(np.concatenate(part), np.array([len(b) for b in part])).tolist()
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each text in ``out_col``, in place of a column of that name."""
    return add_columns(docs, [text_col], f"`{out_col}` double", lambda got: {out_col: _score_texts(model, got[text_col])}, 64)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
