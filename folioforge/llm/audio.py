"""Telephony audio columns.

Mu-law and A-law are expanded by lookup tables; IMA ADPCM blocks are decoded by
numpy steps over all blocks of a batch at once; the samples are resampled and stored
as 16-bit PCM next to the coded form in its WAV container. A row's codec is given, or
picked by the CRC-32 of its payload, so that a table holds all of them.

Defined cases: a null payload is an empty one; an empty table gives no rows;
equal payloads give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind, steps, tune

RATE = 8000
BLOCK = 64

# Step sizes and index changes of IMA ADPCM.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8])


def mulaw_table() -> np.ndarray:
    """The 16-bit sample of every mu-law byte."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit sample of every A-law byte."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    step, low = (a >> 4) & 7, (a & 0x0F) << 4
    size = np.where(step == 0, low + 8, (low + 0x108) << np.maximum(step - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks, shape (blocks, bytes), all blocks in step.

    The first four bytes of a block are its first sample, the step index and a
    reserved byte; each further byte holds two samples, the low half first. A
    step index over 88 counts as 88.
    """
    n, size = blocks.shape
    out = np.empty((n, 1 + 2 * (size - 4)), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), 88)
    out[:, 0] = value
    for i in range(2 * (size - 4)):
        code = (blocks[:, 4 + i // 2] >> (4 * (i % 2))).astype(np.int64) & 15
        step = IMA_STEPS[index]
        move = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + IMA_MOVES[code], 0, 88)
        out[:, 1 + i] = value
    return out


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear resampling in whole numbers; the last sample is held at the end. Going down, samples are means over the span that they stand for."""
    return resample_all(pcm, np.array([0, len(pcm)]), source, target)[0] if source != target and len(pcm) else pcm


def resample_all(pcm: np.ndarray, bounds: np.ndarray, source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`resample` of every run pcm[bounds[i]:bounds[i + 1]]: samples, and their bounds."""
    if source == target:
        return pcm, bounds
    sizes, x = np.diff(bounds), pcm.astype(np.int64)
    last = np.repeat(bounds[1:], sizes)
    if target < source:
        sums, at = np.r_[0, np.cumsum(x)], np.arange(len(x))
        end = np.minimum(at + -(-source // target), last)
        x = (sums[end] - sums[at]) // np.maximum(end - at, 1)
    made = sizes * target // source
    out = np.r_[0, np.cumsum(made)]
    at = (np.arange(out[-1]) - np.repeat(out[:-1], made)) * source
    i, part = np.repeat(bounds[:-1], made) + at // target, at % target
    j = np.minimum(i + 1, np.repeat(bounds[1:], made) - 1)
    return ((x[i] * (target - part) + x[j] * part) // target).astype(np.int16), out


#: Codec: WAV format tag, bits a sample.
CODECS = {"mulaw": (7, 8), "alaw": (6, 8), "ima": (0x11, 4), "pcm": (1, 16)}


def wav(payload: bytes, codec: str, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A mono WAV file around coded bytes."""
    tag, bits = CODECS[codec]
    align = block if codec == "ima" else bits // 8
    per = 1 + 2 * (block - 4) if codec == "ima" else 1
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * align // per, align, bits)
    if codec == "ima":
        fmt += struct.pack("<HH", 2, per)
    elif codec != "pcm":
        fmt += struct.pack("<H", 0)
    data = payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 20 + len(fmt) + len(data)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + data


def unwav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and coded bytes of a WAV file."""
    at, tag, rate, align = 12, 0, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            return tag, rate, align, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


MULAW, ALAW = mulaw_table(), alaw_table()


def decode(media: bytes) -> np.ndarray:
    """16-bit samples of a WAV file."""
    return decode_all([media])[0]


def decode_all(files: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit samples of all WAV files, end to end, and the bounds of each; files of one form are decoded at once."""
    parts = [unwav(f) for f in files]
    forms: dict[tuple[int, int], list[int]] = {}
    for i, (tag, _, align, _) in enumerate(parts):
        forms.setdefault((tag, align), []).append(i)
    made: list[np.ndarray] = [np.empty(0, np.int16)] * len(files)
    for (tag, align), own in forms.items():
        # Whole blocks only.
        data = [parts[i][3][: len(parts[i][3]) // align * align] for i in own]
        codes = np.frombuffer(b"".join(data), np.uint8)
        if tag == 0x11:
            pcm, per = ima_decode(codes.reshape(-1, align)).ravel(), (1 + 2 * (align - 4), align)
        elif tag in (6, 7):
            pcm, per = (MULAW if tag == 7 else ALAW)[codes], (1, 1)
        else:
            pcm, per = codes.view("<i2"), (1, 2)
        ends = np.cumsum([len(d) * per[0] // per[1] for d in data])
        for i, x in zip(own, np.split(pcm, ends[:-1])):
            made[i] = x
    return np.concatenate([np.empty(0, np.int16), *made]), np.r_[0, np.cumsum([len(x) for x in made], dtype=np.int64)]


#: Codecs that are picked from where none is given.
TELEPHONY = ("mulaw", "alaw", "ima")


def store_audio(rows: DataFrame, payload: str, codec: str | None = None, rate: int = RATE, target: int = 2 * RATE, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media and pcm for each row.

    ``payload`` (binary or string; null: empty) holds coded bytes. They are filled up with zero
    bytes to a positive multiple of 64, stored unchanged in a WAV file
    (``media``), decoded from it, resampled, and stored as 16-bit PCM (``pcm``).
    ``n_bytes`` is the size before filling. Without a ``codec``, each row's is
    picked from TELEPHONY by the CRC-32 of its payload.
    """
    tune(rows.sparkSession)
    rows = rows.select(F.col(key).alias("doc_id"), F.col(payload).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "payload"):
            sizes, media = [], []
            for raw in batch.column("payload").to_pylist():
                raw = raw or b""
                sizes.append(len(raw))
                full = raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))
                media.append(wav(full, codec or TELEPHONY[zlib.crc32(full) % len(TELEPHONY)], rate))
            pcm, bounds = resample_all(*decode_all(media), rate, target)
            stored = pa.Array.from_buffers(pa.binary(), len(media), [None, pa.py_buffer((bounds * 2).astype(np.int32)), pa.py_buffer(pcm.astype("<i2"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), stored], ["doc_id", "n_bytes", "media", "pcm"])

    return rows.mapInArrow(run, f"doc_id {kind(rows, 'doc_id')}, n_bytes long, media binary, pcm binary")


def audio_digest(stored: DataFrame) -> DataFrame:
    """What the stored bytes of :func:`store_audio` hold, and features of the stored samples.

    ``feature`` is samples:peak:mean absolute value:changes of sign:format tag, in whole numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "pcm", 4 << 20):
            out = []
            for media, pcm in zip(batch.column("media").to_pylist(), batch.column("pcm").to_pylist()):
                tag, _, _, payload = unwav(media)
                x = np.frombuffer(pcm, "<i2").astype(np.int32)
                size, up = np.abs(x), x >= 0
                feature = f"{len(x)}:{size.max(initial=0)}:{int(size.sum()) // max(1, len(x))}:{int(np.count_nonzero(up[1:] != up[:-1]))}:{tag}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            made = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *made], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"doc_id {kind(stored, 'doc_id')}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(run, schema)
