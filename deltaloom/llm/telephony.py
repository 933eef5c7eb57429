"""Telephony audio columns: WAV files of mu-law, A-law or IMA ADPCM samples, their decoding and resampling.

Mu-law and A-law bytes expand through tables of 256 samples. ADPCM is decoded for all blocks of a file at once: blocks are
independent, so one numpy step takes the n-th code of every block. Decoded audio is PCM of 16 bits, resampled to twice the
rate (8 to 16 kHz) by linear interpolation. Files are decoded in stretches of bounded length, so memory beside the file's
own bytes does not follow its length.

The stored form of a payload is a WAV file whose data chunk is the payload, byte for byte: a byte is a sample of mu-law or
A-law, and 64 bytes are a block of ADPCM (predictor, step index, reserved byte, codes). A step index above 88 counts as 88.
Each row is handled alone. Null is the empty payload, padded to 64 zero bytes. Equal payloads give equal values, repeated rows
repeated ones; an empty table gives an empty one. Other columns are not read, whatever their names.

``store_text`` makes media, ``store_pcm`` reads a media table's stored bytes, digests them and stores the resampled PCM beside the
digests, and ``describe_pcm`` computes features from the stored PCM. Each writes a table in the shared folder for the next. PCM is
stored packed without loss (``pack_pcm``), and media files are dropped as soon as their PCM is written.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm.arrow import map_rows
from deltaloom.llm.shared import Scratch, drop_files, new_path

UNIT = 64
RATE = 8000
STRETCH = 1 << 16
GROUP = 1 << 20
#: Parts of the media table that are decoded and dropped one after another.
PORTIONS = 4
#: WAVE format tags, fixed by the format: A-law 6, mu-law 7, IMA ADPCM 17.
FORMATS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
_NAMES = {tag: name for name, tag in FORMATS.items()}


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    magnitude = ((((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    magnitude = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def _steps() -> np.ndarray:
    """The 89 IMA step sizes, fixed by the format."""
    return np.array(
        [
            7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
            130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
            1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
            7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
        ],
        dtype=np.int32,
    )


STEPS = _steps()
#: Change of the step index by the low three bits of a code, fixed by the format.
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def expand_mulaw(data: bytes) -> np.ndarray:
    return MULAW[np.frombuffer(data, dtype=np.uint8)]


def expand_alaw(data: bytes) -> np.ndarray:
    return ALAW[np.frombuffer(data, dtype=np.uint8)]


def compress_mulaw(pcm: np.ndarray) -> bytes:
    """The mu-law code nearest to each sample."""
    order = np.argsort(MULAW, kind="stable")
    levels = MULAW[order].astype(np.int32)
    at = np.clip(np.searchsorted(levels, pcm), 1, 255)
    near = np.where(pcm - levels[at - 1] <= levels[at] - pcm, at - 1, at)
    return order[near].astype(np.uint8).tobytes()


def decode_adpcm(data: bytes, block: int = UNIT) -> np.ndarray:
    """Samples of whole mono IMA blocks: the header's predictor, then two for each code byte, low half first."""
    b = np.frombuffer(data, dtype=np.uint8).reshape(-1, block)
    value = b[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(b[:, 2].astype(np.int32), 88)
    out = np.empty((len(b), 1 + 2 * (block - 4)), dtype=np.int16)
    out[:, 0] = value
    for j in range(2 * (block - 4)):
        code = (b[:, 4 + j // 2] >> (4 * (j % 2))) & 15
        step = STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + _INDEX[code], 0, 88)
        out[:, j + 1] = value
    return out.reshape(-1)


def encode_adpcm(pcm: np.ndarray, block: int = UNIT) -> bytes:
    """Mono IMA blocks whose decoding follows ``pcm``; the last block is filled with its last sample."""
    per = 1 + 2 * (block - 4)
    blocks = max(1, -(-len(pcm) // per))
    filled = np.concatenate([pcm, np.full(blocks * per - len(pcm), pcm[-1] if len(pcm) else 0)]).reshape(blocks, per).astype(np.int32)
    out = np.zeros((blocks, block), dtype=np.uint8)
    value, index = filled[:, 0].copy(), np.zeros(blocks, dtype=np.int32)
    out[:, :2] = filled[:, :1].astype("<i2").view(np.uint8)
    for j in range(per - 1):
        step, difference = STEPS[index], filled[:, j + 1] - value
        code, left, change = np.where(difference < 0, 8, 0), np.abs(difference), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = left >= part
            code, left, change = code | np.where(take, bit, 0), left - np.where(take, part, 0), change + np.where(take, part, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + _INDEX[code], 0, 88)
        out[:, 4 + j // 2] |= (code << (4 * (j % 2))).astype(np.uint8)
    return out.tobytes()


def wav(data: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAV file with ``data`` as its data chunk."""
    adpcm = codec == "ima_adpcm"
    align, bits = (UNIT, 4) if adpcm else (1, 8)
    per_block = 1 + 2 * (UNIT - 4) if adpcm else 1
    extra = struct.pack("<HH", 2, per_block) if adpcm else struct.pack("<H", 0)
    shape = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, rate * align // per_block, align, bits) + extra
    fact = struct.pack("<I", len(data) // align * per_block)
    body = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", shape), (b"fact", fact), (b"data", data)))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


@dataclass(frozen=True)
class Audio:
    codec: str
    rate: int
    align: int
    data: memoryview

    def stretches(self) -> Iterator[np.ndarray]:
        """Decoded samples, a bounded stretch at a time."""
        step = max(1, STRETCH // self.align) * self.align
        for at in range(0, len(self.data), step):
            part = bytes(self.data[at : at + step])
            yield decode_adpcm(part, self.align) if self.codec == "ima_adpcm" else expand_alaw(part) if self.codec == "alaw" else expand_mulaw(part)


def read_wav(media: bytes) -> Audio:
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at, shape = 12, None
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), struct.unpack("<I", view[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            shape = struct.unpack("<HHIIHH", view[at + 8 : at + 24])
        elif kind == b"data" and shape:
            return Audio(_NAMES[shape[0]], shape[2], shape[4], view[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("a WAV file without its format or data")


def resample_twice(stretches: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """PCM at twice the rate: each sample, and before it the mean with the one before (the first has itself)."""
    last = None
    for pcm in stretches:
        if not len(pcm):
            continue
        now = pcm.astype(np.int32)
        before = np.concatenate(([now[0] if last is None else last], now[:-1]))
        out = np.empty(2 * len(now), dtype="<i2")
        out[0::2], out[1::2] = (before + now) >> 1, now
        last = now[-1]
        yield out


def _between(odd: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` means of neighbours in ``odd``, rounded down; at the ends the only neighbour, 0 without any."""
    if not len(odd):
        return np.zeros(n, dtype="<i2")
    before = np.concatenate((odd[:1], odd))[:n]
    after = np.concatenate((odd, odd[-1:]))[:n]
    return (before & after) + ((before ^ after) >> 1)


def pack_pcm(pcm: bytes) -> bytes:
    """PCM of 16 bits by a lifting step, of the same length and without loss: every second sample, then what the samples between
    differ from the mean of their neighbours. Smooth PCM leaves small differences, which compress."""
    whole = np.frombuffer(pcm, dtype="<i2")
    odd, even = whole[1::2], whole[0::2]
    return odd.tobytes() + (even - _between(odd, len(even))).astype("<i2").tobytes()


def unpack_pcm(packed: bytes) -> bytes:
    """What ``pack_pcm`` packed."""
    whole = np.frombuffer(packed, dtype="<i2")
    odd, rest = whole[: len(whole) // 2], whole[len(whole) // 2 :]
    out = np.empty(len(whole), dtype="<i2")
    out[1::2], out[0::2] = odd, rest + _between(odd, len(rest))
    return out.tobytes()


def decode_together(audios: list[Audio]) -> list[Iterator[np.ndarray]]:
    """The stretches of each file. ADPCM files of up to a stretch are decoded side by side, up to GROUP bytes at once."""
    out = [a.stretches() for a in audios]
    group: list[int] = []

    def flush() -> None:
        if group:
            pcm = decode_adpcm(b"".join(audios[i].data for i in group))
            ends = np.cumsum([len(audios[i].data) // UNIT * (1 + 2 * (UNIT - 4)) for i in group])
            for i, part in zip(group, np.split(pcm, ends[:-1]), strict=True):
                out[i] = iter([part])
            group.clear()

    size = 0
    for i, a in enumerate(audios):
        if a.codec == "ima_adpcm" and a.align == UNIT and len(a.data) <= STRETCH:
            if size + len(a.data) > GROUP:
                flush()
                size = 0
            group.append(i)
            size += len(a.data)
    flush()
    return out


def pcm_features(codec: str, rate: int, pcm: bytes) -> str:
    """A line of features of PCM of 16 bits: codec, rate, samples, peak, mean square, zero crossings, CRC-32."""
    whole = np.frombuffer(pcm, dtype="<i2")
    peak = energy = crossings = 0
    for at in range(0, len(whole), STRETCH):
        wide = whole[at : at + STRETCH].astype(np.int64)
        peak, energy = max(peak, int(np.abs(wide).max())), energy + int((wide * wide).sum())
        negative = whole[max(at - 1, 0) : at + STRETCH] < 0
        crossings += int(np.count_nonzero(negative[1:] != negative[:-1]))
    return f"{codec}:{rate}:{len(whole)}:{peak}:{energy // max(len(whole), 1)}:{crossings}:{zlib.crc32(pcm):08x}"


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return data + b"\0" * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def codec_of(payload: bytes) -> str:
    """Payloads go round the three codecs by their number of units."""
    return ("mulaw", "alaw", "ima_adpcm")[len(payload) // UNIT % 3]


def store_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` of the text in UTF-8, and ``media``, the WAV file that holds it."""

    def rows(got: dict[str, list]) -> dict[str, list]:
        texts = [t or b"" for t in got[text_col]]
        return {"__id": got[id_col], "n_bytes": [len(t) for t in texts], "media": [wav(p := pad(t), codec_of(p)) for t in texts]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df, [id_col, text_col], f"__id {kind}, n_bytes long, media binary", rows, 64).withColumnRenamed("__id", id_col)


def decode_media(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``pcm`` (binary, 16 bits, resampled to twice the rate) of each stored file; null for null."""

    def rows(got: dict[str, list]) -> dict[str, list]:
        audios = [None if m is None else read_wav(m) for m in got["__media"]]
        decoded = iter(decode_together([a for a in audios if a]))
        pcm = [a and b"".join(x.tobytes() for x in resample_twice(next(decoded))) for a in audios]
        return {k: got[k] for k in keep} | {"pcm": pcm, "pcm_rate": [a and 2 * a.rate for a in audios]}

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keep)
    renamed = df.select(*keep, df[media_col].alias("__media"))
    return map_rows(renamed, [*keep, "__media"], f"{kinds}pcm binary, pcm_rate int", rows, 64)


_DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def store_pcm(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of what ``store_text`` stored, from the stored bytes, with ``codec``, ``pcm_rate`` and ``packed``, the
    resampled PCM as ``pack_pcm`` gives it."""

    def rows(got: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"__id": got[id_col], "n_bytes": got["n_bytes"]}
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "pcm_rate", "packed")
        made = []
        audios = [read_wav(m) for m in got["media"]]
        for whole, audio, stretches in zip(got["media"], audios, decode_together(audios), strict=True):
            made.append((
                len(audio.data), hashlib.sha256(audio.data).hexdigest(), zlib.crc32(audio.data[-UNIT:]), len(whole), hashlib.sha256(whole).hexdigest(),
                audio.codec, 2 * audio.rate, pack_pcm(b"".join(x.tobytes() for x in resample_twice(stretches))),
            ))
        return out | {k: [m[i] for m in made] for i, k in enumerate(names)}

    kind = media.schema[id_col].dataType.simpleString()
    made = map_rows(media, [id_col, "n_bytes", "media"], f"__id {kind}, {_DIGESTS}, codec string, pcm_rate int, packed binary", rows, 64)
    return made.withColumnRenamed("__id", id_col)


def describe_pcm(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``stored`` digests with ``feature``, computed from the stored PCM, in place of it."""
    names = [x.split()[0] for x in _DIGESTS.split(", ")]

    def rows(got: dict[str, list]) -> dict[str, list]:
        text = lambda k: [x.decode() for x in got[k]]
        feature = [pcm_features(c, r, unpack_pcm(x)) for c, r, x in zip(text("codec"), got["pcm_rate"], got["packed"], strict=True)]
        kept = {k: text(k) if k.endswith("sha256") else got[k] for k in names}
        return {"__id": got[id_col], **kept, "feature": feature}

    kind = stored.schema[id_col].dataType.simpleString()
    made = map_rows(stored, [id_col, *names, "codec", "pcm_rate", "packed"], f"__id {kind}, {_DIGESTS}, feature string", rows, 64)
    return made.withColumnRenamed("__id", id_col)


def through_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as media, read back, stored as resampled PCM, and described from that. The files of the media table are taken
    in PORTIONS, each dropped once its PCM is written, so the disk never holds the media and the PCM of all rows together."""
    scratch = Scratch()
    media = scratch.written(store_text(df, id_col, text_col), "media", "zstd")
    spark, files = df.sparkSession, sorted(media.inputFiles())
    if not files:  # an empty table may be written without any
        return describe_pcm(store_pcm(media, id_col), id_col)
    path = new_path(spark, "pcm")
    for portion in [files[i::PORTIONS] for i in range(PORTIONS)]:
        if portion:
            pcm = store_pcm(spark.read.schema(media.schema).parquet(*portion), id_col)
            pcm.write.mode("append").option("compression", "zstd").parquet(path)
            drop_files(spark, portion)
    scratch.drop()
    return describe_pcm(spark.read.parquet(path), id_col)


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
