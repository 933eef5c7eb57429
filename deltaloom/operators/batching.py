"""Batch boundaries by bytes and count, and the tuner of the byte limit. Both are pure functions of their input's order."""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import fmean, stdev

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def boundaries(sizes: list[int], max_bytes: int, max_size: int) -> list[int]:
    """Batch number of each message: a batch ends before a message that would fill its bytes, or after ``max_size``."""
    out, batch, held, n = [], 0, 0, 0
    for size in sizes:
        if n and held + size >= max_bytes:
            batch, held, n = batch + 1, 0, 0
        out.append(batch)
        held, n = held + size, n + 1
        if n >= max_size:
            batch, held, n = batch + 1, 0, 0
    return out


@dataclass
class Tuner:
    """Looks for the batch size of the best throughput in [low, high].

    A size in the wider part beside the best one so far is tried until the mean of its samples is steady; the range shrinks to
    the side where the throughput is better, until it is within ``threshold`` of the largest size. Unsteady samples end it."""

    low: int
    high: int
    threshold: float = 0.1
    samples: list[float] = field(default_factory=list)
    best: float = 0.0
    middle: int = 0
    done: bool = False

    @property
    def size(self) -> int:
        """The size to take for the next sample; the best one once done."""
        if not self.middle or self.done:
            return self.middle or (self.low + self.high) // 2
        above = self.high - self.middle >= self.middle - self.low
        return (self.middle + self.high + 1) // 2 if above else (self.low + self.middle) // 2

    def record(self, throughput: float) -> None:
        if self.done:
            return
        self.samples.append(throughput)
        n = len(self.samples)
        if n < 3:
            return
        mean, tried = fmean(self.samples), self.size
        if mean and stdev(self.samples) / mean >= 0.4:
            self.done = n >= 50
            return
        if not self.middle:
            self.best, self.middle = mean, tried
        elif mean > self.best:
            self.low, self.high = (self.middle, self.high) if tried > self.middle else (self.low, self.middle)
            self.best, self.middle = mean, tried
        elif tried > self.middle:
            self.high = tried
        else:
            self.low = tried
        self.samples = []
        self.done = self.high - self.low <= max(2, self.threshold * self.high)


def lane_batches(messages: DataFrame, lane: str, order: str, size: str, max_bytes: int, max_size: int) -> DataFrame:
    """``messages`` with the number of their ``batch`` inside their lane. A batch's end depends on where it began, so a lane is
    read in order by one task, row batch by row batch, with two numbers of state; lanes spread over tasks."""
    kind = messages.schema

    def number(batches):
        now, batch, held, n = object(), 0, 0, 0
        for rows in batches:
            out = []
            for l, s in zip(rows.column(kind.names.index(lane)).to_pylist(), rows.column(kind.names.index(size)).to_pylist()):
                if l != now:
                    now, batch, held, n = l, 0, 0, 0
                if n and held + s >= max_bytes:
                    batch, held, n = batch + 1, 0, 0
                out.append(batch)
                held, n = held + s, n + 1
                if n >= max_size:
                    batch, held, n = batch + 1, 0, 0
            yield rows.append_column("batch", pa.array(out, pa.int64()))

    spread = messages.repartition(lane).sortWithinPartitions(lane, order)
    return spread.mapInArrow(number, T.StructType([*kind.fields, T.StructField("batch", T.LongType())]))


def backoff(attempt: Column, initial_ms: int, max_ms: int, factor: float = 2.0) -> Column:
    """Milliseconds before the next attempt, the first being 0."""
    return F.least(F.lit(float(initial_ms)) * F.pow(F.lit(factor), attempt), F.lit(float(max_ms))).cast("long")


def lag(now: Column, at: Column) -> Column:
    """Microseconds that an event is behind."""
    return F.unix_micros(now) - F.unix_micros(at)


def drops(messages: DataFrame, reason: Column) -> DataFrame:
    """Number and bytes of dropped messages (size) by reason; others are not dropped."""
    return messages.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
