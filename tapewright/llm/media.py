"""Operator 6, media columns: telephony audio.

Bytes are kept losslessly as the samples of a WAVE file (G.711 mu-law or A-law codes, or IMA ADPCM blocks of 64 bytes).
Reading parses the file, expands mu-law and A-law by lookup tables, decodes ADPCM with numpy over all blocks of many
documents at once, and resamples the 8 kHz PCM to 16 kHz by linear interpolation in integers, stored as a PCM column.

Null text is empty text; every payload has at least 64 bytes; equal texts give equal files and features; extra columns
stay out of the way, as only the two named columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import arrow_rows, materialize

UNIT = 64
#: Bytes of files that are decoded together, and one file more.
TOGETHER = 256 << 10
RATE = 8000
CODECS = ("mulaw", "alaw", "ima_adpcm")
#: WAVE format tags. Fixed values of the file format.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}

#: IMA ADPCM quantiser steps and index moves. Fixed values of the codec.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    step, low = (code >> 4) & 7, (code & 15) << 4
    size = np.where(step == 0, low + 8, (low + 264) << np.maximum(step - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw_table(), "alaw": _alaw_table()}


def pad(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def codec_for(payload: bytes) -> str:
    """The codec is a function of the payload, so that equal texts are stored alike."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def write_wave(payload: bytes, codec: str) -> bytes:
    """A mono WAVE file that holds ``payload`` as its coded samples."""
    if codec == "ima_adpcm":
        per_block = (UNIT - 4) * 2 + 1
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * UNIT // per_block, UNIT, 4, 2, per_block)
        samples = len(payload) // UNIT * per_block
    else:
        fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0)
        samples = len(payload)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, bytes]:
    """The codec and the coded samples of a WAVE file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            return next(c for c, t in TAGS.items() if t == tag), media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAVE file without data")


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (one a row), all blocks in step: the loop runs over the samples of one block."""
    head = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(IMA_STEPS) - 1)
    codes = np.empty((blocks.shape[0], (blocks.shape[1] - 4) * 2), np.uint8)
    codes[:, 0::2], codes[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    codes = np.ascontiguousarray(codes.T)
    out = np.empty((codes.shape[0] + 1, blocks.shape[0]), np.int16)
    out[0] = level = head
    for j, code in enumerate(codes, 1):
        step, low = IMA_STEPS[index], code & 7
        move = (step >> 3) + np.where(low & 4, step, 0) + np.where(low & 2, step >> 1, 0) + np.where(low & 1, step >> 2, 0)
        level = np.clip(np.where(code & 8, level - move, level + move), -32768, 32767)
        index = np.clip(index + IMA_MOVES[low], 0, len(IMA_STEPS) - 1)
        out[j] = level
    return out.T.reshape(-1)


def decode(codec: str, data: bytes) -> np.ndarray:
    """16-bit PCM at 8 kHz."""
    raw = np.frombuffer(data, np.uint8)
    return decode_ima(raw.reshape(-1, UNIT)) if codec == "ima_adpcm" else TABLES[codec][raw]


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: every sample, and the mean with its successor (the last one's is itself), rounded down."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
    out[-1] = pcm[-1]
    return out


def features(codec: str, pcm: np.ndarray, wide: np.ndarray) -> str:
    """Codec, samples, peak, mean level, zero crossings, and CRC-32 of the resampled PCM (little endian)."""
    level = np.abs(pcm.astype(np.int32))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec};{len(pcm)};{int(level.max())};{int(level.sum(dtype=np.int64)) // len(pcm)};{crossings};{zlib.crc32(wide.astype('<i2').tobytes()):08x}"


def store_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str | None = None) -> DataFrame:
    """``id_col``, n_bytes, media: each text's padded UTF-8 bytes as a WAVE file. codec: None chooses one by the payload."""

    def make(rows):
        for key, text in rows:
            data = (text or "").encode("utf-8", "surrogatepass")
            payload = pad(data)
            yield key, len(data), write_wave(payload, codec or codec_for(payload))

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return arrow_rows(df, [id_col, text_col], make, schema)


def decode_many(files: list[bytes]) -> Iterator[tuple[str, bytes, np.ndarray]]:
    """Codec, coded samples and 8 kHz PCM of each file; the ADPCM blocks of all of them are decoded in step."""
    parsed = [read_wave(f) for f in files]
    blocks = [np.frombuffer(data, np.uint8).reshape(-1, UNIT) for codec, data in parsed if codec == "ima_adpcm"]
    pcm = decode_ima(np.concatenate(blocks)) if blocks else None
    at = 0
    for codec, data in parsed:
        if codec == "ima_adpcm":
            n = len(data) // UNIT * ((UNIT - 4) * 2 + 1)
            yield codec, data, pcm[at : at + n]
            at += n
        else:
            yield codec, data, decode(codec, data)


def read_audio(df: DataFrame, id_col: str = "doc_id", with_pcm: bool = True) -> DataFrame:
    """The stored files read back: id, n_bytes, media, payload, feature, and pcm (16 kHz, 16-bit little endian) on request."""

    def make(rows):
        def some():
            held, size = [], 0
            for row in rows:
                held.append(row)
                size += len(row[2])
                if size >= TOGETHER:
                    yield held
                    held, size = [], 0
            yield held

        for held in some():
            for (key, n, media), (codec, payload, pcm) in zip(held, decode_many([r[2] for r in held])):
                wide = resample(pcm)
                row = key, n, media, payload, features(codec, pcm, wide)
                yield (*row, wide.astype("<i2").tobytes()) if with_pcm else row

    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())]
    return arrow_rows(df, [id_col, "n_bytes", "media"], make, T.StructType(fields + [T.StructField("pcm", T.BinaryType())] * with_pcm), nbytes=8 << 20)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: digests of what ``store_audio`` wrote and ``read_audio`` read back, for every document; the files are a table in
    the shared folder between the two."""
    stored = materialize(store_audio(spark.read.parquet(f"{sf_dir}/documents.parquet")), "audio")
    return read_audio(stored).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{UNIT}, {UNIT})")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.length("pcm").cast("long").alias("pcm_bytes"),
        F.crc32("pcm").alias("pcm_crc32"),
    )
