"""PNG images to and from arrays (height, width, channels) of 8 or 16 bits, or of booleans for 1-bit greys."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Channels of each colour type, and (first row, first column, row step, column step) of interlaced passes.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))
MAGIC = b"\x89PNG\r\n\x1a\n"


def encode_png(f: np.ndarray) -> bytes:
    """A grey (1), grey and alpha (2), RGB (3) or RGBA (4 channels) image of booleans (grey only), uint8 or uint16."""
    h, w, ch = f.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[ch]
    if f.dtype == bool:
        depth, rows = 1, np.packbits(f[:, :, 0], axis=1)
    else:
        depth = 8 * f.dtype.itemsize
        rows = np.ascontiguousarray(f.astype(">u2" if depth == 16 else np.uint8)).view(np.uint8).reshape(h, -1)
    body = np.hstack([np.zeros((h, 1), np.uint8), rows]).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, size: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:  # each byte adds the same byte of the pixel before it
        wide = np.concatenate([row, np.zeros(-len(row) % size, np.uint8)]).reshape(-1, size)
        return np.cumsum(wide, axis=0, dtype=np.uint8).ravel()[: len(row)]
    out, up = [0] * size + row.tolist(), [0] * size + above.tolist()
    for i in range(size, len(out)):
        a, b, c = out[i - size], up[i], up[i - size]
        if kind == 3:
            out[i] = (out[i] + (a + b) // 2) & 255
        else:
            p = a + b - c
            out[i] = (out[i] + min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]) & 255
    return np.array(out[size:], np.uint8)


def _samples(data: np.ndarray, h: int, w: int, ch: int, depth: int) -> tuple[np.ndarray, int]:
    """One pass: (height, width, channels) of samples, and the bytes that it took."""
    line, size = -(-w * ch * depth // 8), max(1, ch * depth // 8)
    if len(data) < h * (line + 1):
        raise ValueError("image ends early")
    rows, above = data[: h * (line + 1)].reshape(h, line + 1), np.zeros(line, np.uint8)
    plain = np.zeros((h, line), np.uint8)
    for y in range(h):
        plain[y] = above = _unfilter(int(rows[y, 0]), rows[y, 1:], above, size)
    if depth >= 8:
        out = plain.view(np.uint8 if depth == 8 else ">u2").astype(np.uint8 if depth == 8 else np.uint16)
    else:
        bits = np.unpackbits(plain, axis=1).reshape(h, -1, depth)
        out = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)
    return out[:, : w * ch].reshape(h, w, ch), h * (line + 1)


def parse_png(data: bytes) -> np.ndarray:
    """(height, width, channels); palettes become RGB, 1-bit greys booleans, greys of 2 and 4 bits fill 8 bits."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG image")
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, name = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(name + part)):
            raise ValueError("image ends early or is damaged")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body += part
        at += 12 + n
    if head is None or head[3] not in CHANNELS:
        raise ValueError("not a PNG image")
    w, h, depth, kind, _, _, interlaced = head
    ch = CHANNELS[kind]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)
    except zlib.error as e:
        raise ValueError(f"image is damaged: {e}") from None
    out = np.zeros((h, w, ch), np.uint16 if depth == 16 else np.uint8)
    for y, x, dy, dx in PASSES if interlaced else ((0, 0, 1, 1),):
        ph, pw = len(range(y, h, dy)), len(range(x, w, dx))
        if ph and pw:
            out[y::dy, x::dx], used = _samples(raw, ph, pw, ch, depth)
            raw = raw[used:]
    if kind == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ValueError("colour outside the palette")
        return palette[out[:, :, 0]]
    if depth < 8:
        return out.astype(bool) if depth == 1 else out * (255 // ((1 << depth) - 1))
    return out
