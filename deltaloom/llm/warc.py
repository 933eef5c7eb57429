"""WARC archives as a table of chunks.

A record's bytes (WARC header, HTTP header, payload, two line ends) are rows of (record_id, chunk_no, n_chunks, data) with
the SHA-1 of the payload so far; their data, in order of chunk_no, is the record. A payload is cut as it is written and
hashed chunk by chunk as it is read, so neither side holds a second copy of a record, and a reader holds one batch.
Records of one chunk are read where they lie; only the chunks of larger ones are brought together by record.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the largest id is the response and the others
revisit it. Null html is an empty payload, and a null id never becomes the response of others. Rows that repeat an id are
each a record; equal large payloads under the largest id are all responses. Records are told apart by a uuid of their row,
not by their id. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from deltaloom.llm.arrow import schema
from deltaloom.llm.shared import new_path

CHUNK = 1 << 16
MIN_REVISIT = 1000
CHUNKS = schema("record_id string, chunk_no int, n_chunks int, payload_sha1 string, data binary")
_END = b"\r\n\r\n"


def resolve(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``pages`` with ``__size``, ``__digest`` and, for revisits, ``__refers_to``.

    Only digests that occur twice or more are joined; a digest that a third of the pages share is counted before the
    shuffle, and its side of the join can be split.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    sized = pages.withColumns({"__size": F.octet_length(payload).cast("long"), "__digest": F.sha1(payload)})
    shared = (
        sized.filter(F.col("__size") >= min_revisit)
        .groupBy(F.col("__digest").alias("__same"))
        .agg(F.max(id_col).alias("__last"), F.count(F.lit(1)).alias("__n"))
        .filter("__n > 1 AND __last IS NOT NULL")
        .drop("__n")
    )
    other = F.col("__last").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__last"))
    joined = sized.join(shared, sized["__digest"] == shared["__same"], "left")
    return joined.withColumn("__refers_to", F.when(other, F.col("__last"))).drop("__same", "__last")


def _head(kind: str, page_id: str, url: str, refers_to: str | None, digest: str, size: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {url}"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>"]
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    length = len(http) + (size if kind == "response" else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + _END + http


def chunks_of(head: bytes, payload: memoryview, chunk: int) -> Iterator[tuple[int, int, str, bytes]]:
    """(chunk_no, n_chunks, SHA-1 of the payload so far, data): the head comes with the first cut of the payload."""
    n = max(1, -(-len(payload) // chunk))
    running = hashlib.sha1(usedforsecurity=False)
    for i in range(n):
        part = payload[i * chunk : (i + 1) * chunk]
        running.update(part)
        yield i, n, running.hexdigest(), b"".join((head if i == 0 else b"", part, _END if i == n - 1 else b""))


def to_chunks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """The chunk table of ``resolve``'d pages."""
    arrow = to_arrow_schema(CHUNKS)
    rows = pages.select(
        F.expr("uuid()").alias("record"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7F]", "").alias("url"),
        F.col("__refers_to").cast("string").alias("refers_to"),
        F.col("__digest").alias("digest"),
        F.col("__size").alias("size"),
        F.when(F.col("__refers_to").isNull(), F.coalesce(F.col(payload_col), F.lit(""))).cast("binary").alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list] = [[] for _ in arrow]
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                record, page_id, url, refers_to, digest, size = (batch.column(k)[i].as_py() for k in range(6))
                body = batch.column(6)[i]
                payload = memoryview(body.as_buffer() or b"") if body.is_valid else memoryview(b"")
                kind = "response" if refers_to is None else "revisit"
                head = _head(kind, page_id, url, refers_to, digest, size)
                for row in chunks_of(head, payload, chunk):
                    for column, value in zip(made, (record, *row), strict=True):
                        column.append(value)
                    held += len(row[3])
                    if held > 4 * CHUNK + 8 * chunk:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)
                        made, held = [[] for _ in arrow], 0
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, CHUNKS)


class _Reader:
    """State of the record whose chunks are coming in."""

    def __init__(self, record: str, first: memoryview):
        head, _, rest = self._cut(first)
        self.record = record
        self.fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
        http, _, payload = self._cut(rest)
        self.size_said = int(dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:])["Content-Length"])
        self.left = int(self.fields["Content-Length"]) - len(http) - len(_END)
        self.hash, self.size = hashlib.sha1(usedforsecurity=False), 0
        self.next = 0
        self.add(payload)

    @staticmethod
    def _cut(data: memoryview) -> tuple[bytes, bytes, memoryview]:
        window = 512
        while (at := bytes(data[:window]).find(_END)) < 0:
            if window >= len(data):
                raise ValueError("a WARC record without the end of its header")
            window *= 2
        return bytes(data[:at]), _END, data[at + len(_END) :]

    def add(self, data: memoryview) -> None:
        part = data[: self.left]
        self.hash.update(part)
        self.size, self.left, self.next = self.size + len(part), self.left - len(part), self.next + 1

    def row(self) -> tuple:
        kind, said = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        strip = lambda urn: urn.removeprefix("<urn:page:").removesuffix(">")
        page, refers = strip(self.fields["WARC-Record-ID"]), self.fields.get("WARC-Refers-To")
        if kind == "response" and (self.left or self.size != self.size_said or self.hash.hexdigest() != said):
            raise ValueError(f"record {self.record} does not hold the payload that its header names")
        return page or None, self.fields["WARC-Target-URI"], self.size_said, said, kind, strip(refers) if refers else None


RECORDS = schema("id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that come record by record and in order, to a row for each record."""
    arrow = to_arrow_schema(RECORDS)
    now: _Reader | None = None
    for batch in batches:
        made = []
        data = batch.column(3)
        ids, numbers, counts = (batch.column(k).to_pylist() for k in range(3))
        for i, (record, number, count) in enumerate(zip(ids, numbers, counts, strict=True)):
            part = memoryview(data[i].as_buffer())
            if number == 0:
                now = _Reader(record, part)
            elif now is None or now.record != record or now.next != number:
                raise ValueError(f"chunk {number} of record {record} is out of place")
            else:
                now.add(part)
            if number == count - 1:
                made.append(now.row())
                now = None
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], f.type) for k, f in enumerate(arrow)], schema=arrow)
    if now is not None:
        raise ValueError(f"record {now.record} lacks its last chunks")


def read_chunks(chunks: DataFrame) -> DataFrame:
    """A row of RECORDS for each record of a chunk table; a payload that differs from its digest is an error."""
    chunks = chunks.select("record_id", "chunk_no", "n_chunks", "data")
    small = chunks.filter("n_chunks = 1").mapInArrow(_read, RECORDS)
    large = chunks.filter("n_chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_read, RECORDS)
    return small.unionByName(large)


def archive(pages: DataFrame, path: str, chunk: int = CHUNK, min_revisit: int = MIN_REVISIT) -> None:
    """Write the archive of ``pages`` (page_id, url, html) to a folder."""
    to_chunks(resolve(pages.select("page_id", "url", "html"), min_revisit=min_revisit), chunk=chunk).write.parquet(path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = new_path(spark, "warc")
    archive(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_chunks(spark.read.schema(CHUNKS).parquet(path)).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
m AS (SELECT page_id, n, s, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY s) END AS last FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, s AS payload_digest,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""
