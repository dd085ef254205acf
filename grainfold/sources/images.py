"""Images: dimensions from headers, PNG coding, and a deterministic check for decorative or broken pictures.

Fixed values, as they are output that others read: verdicts and the wording of their reasons.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds of the quality check.
SMALL_SIDE, THIN_SIDE, SMALL_BYTES, LONGEST_ASPECT, MOST_PIXELS, SAMPLED_ROWS = 32, 8, 512, 40, 40_000_000, 240
UNIFORM, INCOHERENT, INCOHERENT_LEAST, STRIPED, STRIPED_LEAST = 2.0, 1.15, 12.0, 0.93, 40.0


class Invalid(ValueError):
    """A header that can't be one of an image."""


def dimensions(data: bytes, media: str) -> tuple[int, int] | None:
    """(width, height); None for formats that aren't read. Raises Invalid for a broken header."""
    if media == "image/png":
        if data[:8] != b"\x89PNG\r\n\x1a\n" or len(data) < 24:
            raise Invalid("invalid PNG header")
        found = struct.unpack(">II", data[16:24])
    elif media == "image/gif":
        if data[:4] != b"GIF8" or len(data) < 10:
            raise Invalid("invalid GIF header")
        found = struct.unpack("<HH", data[6:10])
    elif media == "image/bmp":
        if data[:2] != b"BM" or len(data) < 26:
            raise Invalid("invalid BMP header")
        found = tuple(map(abs, struct.unpack("<ii", data[18:26])))
    elif media == "image/jpeg":
        found = jpeg(data)
    elif media == "image/webp":
        found = webp(data)
    else:
        return None
    if found is None:
        return None
    if min(found) <= 0:
        raise Invalid("invalid image dimensions")
    return found[0], found[1]


def jpeg(data: bytes) -> tuple[int, int]:
    if data[:2] != b"\xff\xd8":
        raise Invalid("invalid JPEG header")
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD9:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise Invalid("JPEG without a frame header")


def webp(data: bytes) -> tuple[int, int] | None:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or len(data) < 30:
        raise Invalid("invalid WebP header")
    kind = data[12:16]
    if kind == b"VP8 ":
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF
    if kind == b"VP8L":
        bits = struct.unpack("<I", data[21:25])[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X":
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    return None


def encode_png(width: int, height: int, channels: int, data: bytes) -> bytes:
    """PNG of raw samples with 1 (grey), 3 (RGB) or 4 (RGBA) channels."""
    colour = {1: 0, 3: 2, 4: 6}[channels]
    rows = np.frombuffer(data, np.uint8)[: width * height * channels].reshape(height, width * channels)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """RGBA samples (height, width, 4) of a PNG that isn't interlaced."""
    at, body, palette, alpha = 8, b"", None, None
    width = height = depth = colour = interlace = 0
    while at + 8 <= len(data):
        length = struct.unpack(">I", data[at : at + 4])[0]
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part[:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body += part
        at += 12 + length
    if interlace or colour not in (0, 2, 3, 4, 6) or not width:
        raise Invalid("unsupported PNG layout")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    bits = channels * depth
    stride, step = (width * bits + 7) // 8, max(1, bits // 8)
    raw = zlib.decompress(body)
    if len(raw) < height * (stride + 1):
        raise Invalid("PNG data end early")
    rows = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    before = np.zeros(stride, np.int32)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + before
        elif kind == 1:
            pad = np.concatenate([line, np.zeros(-len(line) % step, np.int32)]).reshape(-1, step)
            line = np.cumsum(pad, axis=0).ravel()[:stride]
        elif kind in (3, 4):
            for x in range(stride):
                a = line[x - step] if x >= step else 0
                b, c = before[x], before[x - step] if x >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                line[x] = (line[x] + guess) & 255
        before = line & 255
        out[y] = before
    if depth == 16:
        out = out[:, ::2]
    elif depth < 8:
        out = np.unpackbits(out, axis=1).reshape(height, -1, depth)
        out = out.dot(1 << np.arange(depth)[::-1]).astype(np.uint8)[:, : width * channels]
        if colour != 3:
            out = out * (255 // ((1 << depth) - 1))
    px = out[:, : width * channels].reshape(height, width, channels)
    full = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        full[..., :3] = palette[px[..., 0]]
        if alpha is not None:
            full[..., 3] = np.concatenate([alpha, np.full(256 - len(alpha), 255, np.uint8)])[px[..., 0]]
    elif colour in (0, 4):
        full[..., :3] = px[..., :1]
        if colour == 4:
            full[..., 3] = px[..., 1]
    else:
        full[..., :channels] = px
    return full


def measure(rgba: np.ndarray) -> dict[str, float]:
    """Mean differences of neighbours and the deviation of the luminance, over evenly sampled rows."""
    height, width = rgba.shape[:2]
    step = max(1, -(-height // SAMPLED_ROWS))
    at = np.arange(0, height, step)
    px = rgba.astype(np.int32)
    rows = px[at]
    mean = lambda d: float(np.abs(d).sum(axis=2).mean()) if d.size else 0.0
    below = at[at + 2 < height]
    alpha = rows[..., 3] / 255
    light = (rows[..., :3] @ np.array([0.299, 0.587, 0.114])) * alpha + 255 * (1 - alpha)
    return {
        "h1": mean(rows[:, 1:-2] - rows[:, :-3]) if width > 3 else 0.0,
        "h3": mean(rows[:, 3:] - rows[:, :-3]) if width > 3 else 0.0,
        "v1": mean(px[below] - px[below + 1]) if len(below) else 0.0,
        "v2": mean(px[below] - px[below + 2]) if len(below) else 0.0,
        "deviation": float(np.sqrt(max(0.0, (light**2).mean() - light.mean() ** 2))),
    }


def ratio_text(r: float) -> str:
    return ">99" if r > 99 else f"{r:.2f}"


def assess(s: dict[str, float]) -> tuple[str, str | None]:
    """content, or broken with a reason."""
    if s["deviation"] < UNIFORM:
        return "broken", "near-uniform (blank) image"
    across, down = s["h1"] / max(s["h3"], 1e-9), s["v1"] / max(s["v2"], 1e-9)
    if s["h1"] >= INCOHERENT_LEAST and across >= INCOHERENT:
        return "broken", f"incoherent pixel neighbourhoods (adjacent/3-apart difference ratio {ratio_text(across)}; likely mis-decoded pixel data)"
    if s["v1"] >= STRIPED_LEAST and down >= STRIPED:
        return "broken", f"row striping (adjacent/2-apart row difference ratio {ratio_text(down)})"
    return "content", None


def inspect(data: bytes, media: str) -> tuple[int | None, int | None, str, str | None]:
    """(width, height, verdict, reason); verdicts content, tiny, broken."""
    try:
        size = dimensions(data, media)
    except Invalid as e:
        return None, None, "broken", str(e)
    if size is None:
        return (None, None, "tiny", f"only {len(data)} bytes") if len(data) < SMALL_BYTES else (None, None, "content", None)
    w, h = size
    if w < SMALL_SIDE and h < SMALL_SIDE:
        return w, h, "tiny", f"{w}×{h} px"
    if min(size) < THIN_SIDE:
        return w, h, "tiny", f"thin {w}×{h} px line"
    if max(size) / min(size) > LONGEST_ASPECT:
        return w, h, "broken", f"extreme aspect ratio {max(size) / min(size):.0f}:1 ({w}×{h} px)"
    if media == "image/png" and w * h <= MOST_PIXELS:
        try:
            verdict, reason = assess(measure(decode_png(data)))
        except (Invalid, zlib.error, ValueError, IndexError, struct.error, TypeError) as e:
            verdict, reason = "broken", f"PNG cannot be decoded ({e})"
        return w, h, verdict, reason
    return w, h, "content", None


def inspected(df: DataFrame, key: str, data: str, media: str) -> DataFrame:
    """(key, width, height, verdict, reason) of images; null data are broken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [inspect(d, m or "") if d is not None else (None, None, "broken", "no data") for d, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string())))], names=["key", "width", "height", "verdict", "reason"])

    return df.select(F.col(key), F.col(data), F.col(media)).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, width int, height int, verdict string, reason string").withColumnRenamed("key", key)
