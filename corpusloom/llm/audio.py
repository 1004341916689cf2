"""Media columns: audio features.

Each text's bytes, padded with zeros, are stored losslessly as the 8-bit samples of a mono WAV in a
binary column. The stored column is read back and, from its samples alone, features are made:
polyphase resampling (to half the rate), overlapped windowed frames through a log-mel filterbank,
and segments by energy with hysteresis (begun above the higher level, ended below the lower one).
Frames are stored as a fixed-shape tensor column (`frames` x `mels` float32 patches, flat and in order, for each row;
Spark has no tensor type, so the column's metadata in the schema name Arrow's, with its shape, and stay with it in Parquet)
beside the time spans of the segments; tensors() gives the column as Arrow's fixed-shape tensor type by that metadata.

Every stage is one row at a time over bounded pieces of a row, so a task holds one batch of
bounded weight plus its longest row. Defined results: a null text is the empty one (64 zero
samples); equal texts give equal values; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, materialise, pairs, table, texts

RATE, UP, DOWN = 16_000, 1, 2
FRAME, HOP, MELS, PATCH = 256, 128, 16, 32
#: Decibels under the loudest frame at which a segment begins, and at which it ends.
BEGIN_DB, END_DB = -12.0, -18.0
BLOCK = 1 << 18


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV of unsigned 8-bit samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The data chunk of a RIFF file."""
    at = 12
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@lru_cache(8)
def lowpass(up: int, down: int, taps: int = 8) -> np.ndarray:
    """A Hann-windowed sinc at the lower of the two Nyquist rates, `taps` a phase of the slower side."""
    half = taps * max(up, down) // 2
    t = np.arange(-half, half + 1)
    kernel = np.sinc(t / max(up, down)) * np.hanning(2 * half + 3)[1:-1]
    return (kernel * up / kernel.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: output m takes the kernel's phase m*down mod up over the input, never the stuffed zeros."""
    kernel = lowpass(up, down)
    half, n = len(kernel) // 2, -(-len(x) * up // down)
    out = np.zeros(n, np.float32)
    reach = half // up + 1
    padded = np.concatenate([np.zeros(reach, np.float32), x, np.zeros(reach + down + 1, np.float32)])
    for first in range(up):  # outputs m = first, first + up, ...: all of one phase
        m = np.arange(first, n, up)
        if not len(m):
            continue
        at = first * down
        phase, start = at % up, at // up
        # taps k of the kernel for which (at + k - half) is a multiple of up
        for k in range((half - phase) % up, len(kernel), up):
            shift = start + (phase + k - half) // up + reach
            out[first::up] += kernel[len(kernel) - 1 - k] * padded[shift : shift + down * len(m) : down][: len(m)]
    return out


@lru_cache(8)
def filterbank(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, (frame // 2 + 1) x mels."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    hz = np.arange(frame // 2 + 1) * rate / frame
    rise = (hz[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


def log_mels(y: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Natural log-mels of half-overlapped Hann frames, and each frame's energy in decibels; at least one frame."""
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
    mel, energy = [], []
    for k in range(0, len(frames), 1024):
        part = frames[k : k + 1024]
        power = np.abs(np.fft.rfft(part * window, axis=1)).astype(np.float32) ** 2
        mel.append(np.log(np.einsum("fk,km->fm", power, filterbank(rate)) + 1e-6))
        energy.append(10 * np.log10((part.astype(np.float64) ** 2).mean(1) + 1e-10))
    return np.concatenate(mel).astype(np.float32), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Half-open frame spans: from a frame above BEGIN_DB below the loudest to the next one below END_DB."""
    top, spans, start = energy.max(), [], -1
    marks = np.where(energy >= top + BEGIN_DB, 1, np.where(energy < top + END_DB, -1, 0))
    for k in np.flatnonzero(marks).tolist():
        if marks[k] > 0 and start < 0:
            start = k
        elif marks[k] < 0 and start >= 0:
            spans.append((start, k))
            start = -1
    return spans + [(start, len(energy))] * (start >= 0)


def describe(media: bytes) -> tuple:
    """payload bytes, its SHA-256, CRC-32 of its last 64 bytes, media bytes, its SHA-256, feature, patches, spans in seconds."""
    payload = samples(media)
    rate = RATE * UP // DOWN
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mels(resample(x - x.mean()), rate)
    spans = [(a * HOP / rate, ((b - 1) * HOP + FRAME) / rate) for a, b in segments(energy)]
    padded = np.concatenate([mel, np.zeros((-len(mel) % PATCH, MELS), np.float32)]).astype(np.float32)
    feature = f"frames={len(mel)};segments={len(spans)};active={sum(b - a for a, b in spans):.4f};mel=" + ",".join(f"{v:.2f}" for v in mel.mean(0, dtype=np.float64))
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, padded, spans


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the stored column of WAVs, read back from the shared folder."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows(batches):
        for doc_id, text in pairs(batches):
            yield doc_id, len(text), wav(text.ljust(max(64, -(-len(text) // 64) * 64), b"\0"))

    return materialise(texts(docs).mapInArrow(lambda b: in_batches(rows(b), schema, lambda r: len(r[2])), "doc_id long, n_bytes long, media binary"), "audio")


SHAPE = (PATCH, MELS)
#: What Arrow writes of a fixed-shape tensor field, as metadata of the column.
TENSOR = {"ARROW:extension:name": "arrow.fixed_shape_tensor", "ARROW:extension:metadata": json.dumps({"shape": SHAPE})}
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, spans array<struct<begin: double, end: double>>"


def featured(stored: DataFrame, keep_patches: bool = True) -> DataFrame:
    """RESULT of each stored row and, if asked, `patches`: its frames as float32 patches of SHAPE, flat and in order."""
    span = pa.list_(pa.struct([("begin", pa.float64()), ("end", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), span]
    schema = pa.schema([pa.field(c.split()[0], k) for c, k in zip(RESULT.split(", ", 8), kinds, strict=True)] + [("patches", pa.list_(pa.float32()))] * keep_patches)

    def rows(batches):
        for batch in batches:
            for doc_id, n, media in zip(*(batch.column(k) for k in range(3)), strict=True):
                *digest, mel, spans = describe(media.as_py())
                yield (doc_id.as_py(), n.as_py(), *digest, [{"begin": a, "end": b} for a, b in spans]) + ((mel.ravel(),) if keep_patches else ())

    weigh = (lambda r: 400 + r[-1].nbytes) if keep_patches else (lambda r: 400)
    found = stored.select("doc_id", "n_bytes", "media").mapInArrow(lambda b: in_batches(rows(b), schema, weigh), RESULT + ", patches array<float>" * keep_patches)
    return found.withMetadata("patches", TENSOR) if keep_patches else found


def tensors(patches: pa.Array, metadata: dict) -> pa.ExtensionArray:
    """A row's flat patches, or a column of them joined, as Arrow's fixed-shape tensors; metadata of the column, as in its schema."""
    if metadata.get("ARROW:extension:name") != TENSOR["ARROW:extension:name"]:
        raise ValueError("the column is no tensor column")
    shape = json.loads(metadata["ARROW:extension:metadata"])["shape"]
    flat = patches.flatten() if pa.types.is_list(patches.type) else patches
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), shape), pa.FixedSizeListArray.from_arrays(flat.cast(pa.float32()), int(np.prod(shape))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(featured(store(table(spark, sf_dir, "documents"))), "audio-features")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("spans").alias("n_segments"), "spans", "patches")
