"""Images of pages for text recognition: grey values, threshold and rotation of PNG images.

Only 8-bit grey, RGB and RGBA PNG files without interlacing are read; every function
gives back the image that it was given where it can't read it.
"""

from __future__ import annotations

import shutil
import struct
import subprocess
import zlib
from collections.abc import Callable

import numpy as np

#: Grey values above are paper, or a faint mark on it.
PAPER = 165
#: Longest side on which the orientation is looked for; least confidence in it.
OSD_SIDE, OSD_LEAST = 1500, 2.0


def read_png(data: bytes) -> np.ndarray:
    """Samples, shape (height, width, channels)."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        raise ValueError("no PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif name == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    width, height, bits, colour, _, _, lace = head
    channels = {0: 1, 2: 3, 6: 4}.get(colour, 0)
    if bits != 8 or not channels or lace:
        raise ValueError("kind of PNG")
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.uint8)
    before = np.zeros((width, channels), np.uint8)
    for y in range(height):
        kind, row = int(rows[y, 0]), rows[y, 1:].reshape(width, channels)
        if kind == 1:
            row = np.cumsum(row, 0, dtype=np.uint8)
        elif kind == 2:
            row = row + before
        elif kind in (3, 4):
            row, left, corner = row.copy(), np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for x in range(width):
                up = before[x].astype(np.int64)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                row[x] = (row[x] + guess) & 255
                left, corner = row[x].astype(np.int64), up
        out[y] = before = row
    return out


def write_png(samples: np.ndarray) -> bytes:
    height, width, channels = samples.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), samples.reshape(height, -1)], 1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def grey(samples: np.ndarray) -> np.ndarray:
    """Luma of samples, shape (height, width, 1)."""
    if samples.shape[2] == 1:
        return samples
    r, g, b = (samples[:, :, i].astype(np.uint32) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16).astype(np.uint8)[:, :, None]


def without_marks(image: bytes) -> bytes:
    """Black ink on white paper: what is lighter than PAPER is white, all else black."""
    try:
        return write_png(np.where(grey(read_png(image)) > PAPER, np.uint8(255), np.uint8(0)))
    except Exception:  # noqa: BLE001  an image that can't be read goes on as it is
        return image


def osd_program(image: bytes, timeout: int = 60) -> tuple[int, float]:
    """Angle by which a page is to be turned clockwise, and confidence, from the command-line program."""
    said = subprocess.run(["tesseract", "stdin", "stdout", "--psm", "0"], input=image, check=True, timeout=timeout, capture_output=True).stdout.decode("utf-8", "replace")
    values = dict(line.split(":", 1) for line in said.splitlines() if ":" in line)
    return int(values.get("Rotate", 0)), float(values.get("Orientation confidence", 0))


def upright(image: bytes, osd: Callable[[bytes], tuple[int, float]] | None = None) -> bytes:
    """The image turned by the angle that is found on a small copy of it, if that is sure enough."""
    osd = osd or (osd_program if shutil.which("tesseract") else None)
    if osd is None:
        return image
    try:
        samples = read_png(image)
        step = max(1, -(-max(samples.shape[:2]) // OSD_SIDE))
        angle, sure = osd(write_png(samples[::step, ::step]) if step > 1 else image)
        if angle in (90, 180, 270) and sure >= OSD_LEAST:
            return write_png(np.ascontiguousarray(np.rot90(samples, -(angle // 90))))
    except Exception:  # noqa: BLE001  as above
        pass
    return image
