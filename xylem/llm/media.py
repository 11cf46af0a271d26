"""Media columns: telephony audio.

G.711 mu-law and A-law expand through 256-entry lookup tables, IMA ADPCM
decodes with numpy across blocks (one vector lane per block, one step per
nibble), and the PCM is resampled and stored as 16-bit WAV.

Cases: a null text is an empty one; an empty payload is one unit of padding;
a null or unreadable media value gives a null PCM; columns whose names clash
with the results are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import key_text

UNIT = 576
PAD = 255
MULAW, ALAW, IMA = 7, 6, 17

# IMA ADPCM step sizes and index changes.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << (u >> 4 & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    e = a >> 4 & 7
    size = np.where(e == 0, ((a & 0x0F) << 4) + 8, (((a & 0x0F) << 4) + 0x108) << np.maximum(e - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Decode mono IMA ADPCM blocks (rows of uint8: 2 bytes predictor, index, 0, nibbles low first) to int16 rows."""
    n = len(blocks)
    head = blocks[:, :4].astype(np.int32)
    value = (head[:, 0] | head[:, 1] << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.clip(head[:, 2], 0, 88)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(data) + 1, n), dtype=np.int16)
    out[0] = value
    for i, byte in enumerate(data):
        for half in (0, 1):
            code = (byte >> 4 if half else byte & 15).astype(np.int32)
            step = IMA_STEPS[index]
            diff = (step * ((code & 7) * 2 + 1)) >> 3
            value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
            index = np.clip(index + IMA_MOVES[code & 7], 0, 88)
            out[2 * i + half + 1] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear resampling with integer arithmetic, so that equal samples give equal bytes everywhere."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    n = len(pcm) * to // rate
    at = np.arange(n, dtype=np.int64) * rate
    i, part = at // to, at % to
    x = pcm.astype(np.int64)
    return (x[i] + (x[np.minimum(i + 1, len(x) - 1)] - x[i]) * part // to).astype(np.int16)


def wav(tag: int, data: bytes, rate: int = 8000, align: int = 1, bits: int = 8, samples: int | None = None, extra: bytes = b"") -> bytes:
    """A mono RIFF/WAVE file around ``data``."""
    n = len(data) if samples is None else samples
    per_s = rate * align if tag != IMA else rate * align * len(data) // max(align, 1) // max(n, 1)
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, per_s, align, bits, len(extra)) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body) + len(data) % 2) + body + b"\0" * (len(data) % 2)


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block align, data) of a RIFF/WAVE file; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        found[name] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    tag, _, rate, _, align = struct.unpack_from("<HHIIH", found[b"fmt "])
    return tag, rate, align, found[b"data"]


def store_payload(text: str | None) -> tuple[int, bytes]:
    """(unpadded bytes, payload): UTF-8 and then bytes 255 up to a positive multiple of 576."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes([PAD]) * ((-len(raw)) % UNIT or (0 if raw else UNIT))


def decode_wav(media: bytes | None) -> tuple[np.ndarray, int] | None:
    """PCM and rate of mu-law, A-law or IMA ADPCM WAVE bytes; None for null or unreadable ones."""
    try:
        tag, rate, align, data = read_wav(bytes(media))
    except (TypeError, ValueError, KeyError, struct.error):
        return None
    codes = np.frombuffer(data, np.uint8)
    if tag in (MULAW, ALAW):
        return (MULAW_PCM if tag == MULAW else ALAW_PCM)[codes], rate
    if tag == IMA and align > 4:
        return ima_decode(codes[: len(codes) // align * align].reshape(-1, align)).reshape(-1), rate
    return None


def decode_telephony(df: DataFrame, media: str = "media", pcm: str = "pcm", rate: int = 16000) -> DataFrame:
    """Add ``pcm``: a 16-bit WAV at ``rate`` decoded from the telephony WAV in ``media``; null where it can't be read."""
    schema = T.StructType([f for f in df.schema if f.name != pcm] + [T.StructField(pcm, T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for m in b[media]:
                got = decode_wav(m)
                out.append(None if got is None else wav(1, resample(*got, rate).astype("<i2").tobytes(), rate, 2, 16))
            b = b.drop(columns=[pcm], errors="ignore")
            b[pcm] = out
            yield b

    return df.mapInPandas(run, schema)


def ima_views(payloads: list[bytes]) -> list[int]:
    """A checksum of each payload read as IMA nibbles, all blocks of the batch decoded together (zeroed block heads)."""
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    sums = []
    for at in range(0, len(data), 16384):
        part = data[at : at + 16384]
        pcm = ima_decode(np.hstack([np.zeros((len(part), 4), np.uint8), part]))
        sums.append(np.abs(pcm.astype(np.int64)).sum(axis=1))
    sums = np.concatenate(sums)
    ends = np.cumsum([len(p) // UNIT for p in payloads])
    total = np.concatenate([[0], np.cumsum(sums)])
    return (total[ends] - total[np.concatenate([[0], ends[:-1]])]).tolist()


AUDIO_SCHEMA = (
    "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def texts_as_telephony(df: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each whole text as a mu-law WAV, read it back and describe it.

    The feature has the samples, mean square, zero crossings and peak of the
    16 kHz PCM resampled from the read-back file, and the mean magnitude of the payload
    read as ADPCM. ``keep_media`` adds the stored file and its resampled PCM file.
    Nulls and empty texts: one unit of padding. Equal texts give equal values; rows stay as they are, repeated ones too.
    """
    schema = AUDIO_SCHEMA + (", media binary, pcm binary" if keep_media else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, payloads = [], []
            for text_ in b["text"]:
                n, payload = store_payload(text_)
                media = wav(MULAW, payload)
                _, rate, _, data = read_wav(media)
                pcm = resample(MULAW_PCM[np.frombuffer(data, np.uint8)], rate, 16000)
                x = pcm.astype(np.int64)
                square, cross, peak = int((x * x).sum()) // len(x), int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))), int(np.abs(x).max())
                rows.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"n={len(x)};ms={square};zc={cross};peak={peak}", media, pcm))
                payloads.append(data)
            if not rows:
                continue
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "pcm"])
            out["feature"] = [f"{f};ima={s // (2 * n)}" for f, s, n in zip(out["feature"], ima_views(payloads), out["payload_bytes"], strict=True)]
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            if keep_media:
                out["pcm"] = [wav(1, p.astype("<i2").tobytes(), 16000, 2, 16) for p in out["pcm"]]
            yield out if keep_media else out.drop(columns=["media", "pcm"])

    return df.select(key_text(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
