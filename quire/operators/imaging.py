"""Image bytes to arrays and back, for formats that need no codec beyond the standard library; others give an error.

Files of NATIVE formats are decoded by Spark's image source (sources.files.read_pixels); others need an opener in OPENERS.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np


class DecodeError(ValueError):
    pass


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit grey or RGB array as PNG."""
    h, w = image.shape[:2]
    grey = image.ndim == 2
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(image, np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if grey else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """RGB array of an 8-bit, non-interlaced PNG of grey, RGB or RGBA pixels."""
    if not data:
        raise DecodeError("empty file (0 bytes)")
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise DecodeError("not a PNG image")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise DecodeError("unsupported PNG")
    w, h, n = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * n + 1)
    except (zlib.error, ValueError) as e:
        raise DecodeError("corrupt PNG") from e
    out, above = np.zeros((h, w * n), np.int64), np.zeros(w * n, np.int64)
    for y in range(h):
        kind, row = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 1:
            row = (np.cumsum(row.reshape(w, n), axis=0) & 255).reshape(-1)
        elif kind == 2:
            row = (row + above) & 255
        elif kind:
            for x in range(w * n):
                a, b, c = (row[x - n] if x >= n else 0), above[x], (above[x - n] if x >= n else 0)
                p = a + b - c
                near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                row[x] = (row[x] + (a if kind == 1 else (a + b) // 2 if kind == 3 else near)) & 255
        out[y] = above = row
    image = out.reshape(h, w, n).astype(np.uint8)
    return np.repeat(image, 3, axis=2) if n == 1 else image[:, :, :3]


def decode_bmp(data: bytes) -> np.ndarray:
    """RGB array of an uncompressed BMP of 24 or 32 bits a pixel."""
    if data[:2] != b"BM" or len(data) < 54:
        raise DecodeError("not a BMP image")
    at, w, h, bits, packed = struct.unpack("<I4xii2xHI", data[10:34])
    if bits not in (24, 32) or packed or w <= 0 or not h:
        raise DecodeError("unsupported BMP")
    line = (w * bits // 8 + 3) // 4 * 4
    if len(data) < at + line * abs(h):
        raise DecodeError("corrupt BMP")
    rows = np.frombuffer(data, np.uint8, line * abs(h), at).reshape(abs(h), line)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return np.ascontiguousarray((rows if h < 0 else rows[::-1])[:, :, 2::-1])


#: Openers of further formats by the first bytes of a file; an optional codec registers itself here.
OPENERS: dict[bytes, object] = {b"\x89PNG\r\n\x1a\n": lambda data: decode_png(data), b"BM": decode_bmp}


def decode(data: bytes) -> np.ndarray:
    """RGB array of an image in a known format, turned as its Exif data say."""
    if not data:
        raise DecodeError("empty file (0 bytes)")
    for head, opener in OPENERS.items():
        if data.startswith(head):
            return transpose(opener(data), orientation(data))
    raise DecodeError("no opener for this format")


def picture(content: bytes | None, pixels: bytes | None = None, height: int = 0, width: int = 0, channels: int = 0, turn: int = 1) -> np.ndarray:
    """RGB array of rows of blue, green and red bytes as stored, or else of a file's content."""
    if pixels is not None:
        image = np.frombuffer(bytes(pixels), np.uint8).reshape(int(height), int(width), int(channels))
        return transpose(np.repeat(image, 3, axis=2) if channels == 1 else image[:, :, 2::-1], int(turn))
    if content is None:
        raise DecodeError("corrupt or unreadable image file")
    return decode(bytes(content))


def orientation(data: bytes) -> int:
    """The Exif orientation, 1 to 8, of the first bytes of a JPEG, PNG or TIFF file; 1 if they have none."""
    body = b""
    if data[:4] in (b"II*\0", b"MM\0*"):
        body = data
    elif data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                body = data[at + 10 : at + 2 + size]
                break
            if kind == 0xDA:
                break
            at += 2 + size
    elif (found := data.find(b"eXIf", 0, 1 << 16)) > 0:
        body = data[found + 4 :]
    if body[:2] not in (b"II", b"MM") or len(body) < 10:
        return 1
    end = "<" if body[:2] == b"II" else ">"
    at = struct.unpack(end + "I", body[4:8])[0]
    if at + 2 > len(body):
        return 1
    for i in range(struct.unpack(end + "H", body[at : at + 2])[0]):
        entry = body[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) == 12 and struct.unpack(end + "H", entry[:2])[0] == 0x0112:
            value = struct.unpack(end + "H", entry[8:10])[0]
            return value if 1 <= value <= 8 else 1
    return 1


def transpose(image: np.ndarray, turn: int) -> np.ndarray:
    """The image as it is to be seen, from its Exif orientation."""
    if turn >= 5:
        image = image.swapaxes(0, 1)
    if turn in (2, 3, 6, 7):
        image = image[:, ::-1]
    if turn in (3, 4, 7, 8):
        image = image[::-1]
    return np.ascontiguousarray(image)


def equalise(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of the grey image, in three equal channels.

    Each of tiles x tiles regions has its clipped histogram's cumulative curve; a pixel's value is interpolated between
    the curves of the four nearest regions.
    """
    grey = image if image.ndim == 2 else np.rint(image[:, :, :3] @ np.array([0.299, 0.587, 0.114]))
    grey = grey.astype(np.uint8)
    h, w = grey.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    full = np.pad(grey, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "edge")
    cut = full.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, -1)
    curves = np.empty((tiles * tiles, 256))
    limit = max(int(clip * th * tw / 256), 1)
    for i, block in enumerate(cut):
        n = np.bincount(block, minlength=256)
        over = int(np.maximum(n - limit, 0).sum())
        n = np.minimum(n, limit) + over // 256
        if rest := over % 256:
            n[:: max(256 // rest, 1)][:rest] += 1
        curves[i] = np.minimum(np.rint(np.cumsum(n) * (255 / (th * tw))), 255)
    curves = curves.reshape(tiles, tiles, 256)

    def near(n: int, size: int):
        at = (np.arange(n) + 0.5) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    y0, y1, fy = near(h, th)
    x0, x1, fx = near(w, tw)
    of = lambda y, x: curves[y[:, None], x[None, :], grey]
    top = of(y0, x0) * (1 - fx) + of(y0, x1) * fx
    low = of(y1, x0) * (1 - fx) + of(y1, x1) * fx
    out = np.rint(top * (1 - fy)[:, None] + low * fy[:, None]).astype(np.uint8)
    return np.repeat(out[:, :, None], 3, axis=2)


def thumbnail(image: np.ndarray, width: int = 400, height: int = 600) -> np.ndarray:
    """The image brought down to fit the box, its shape kept; smaller ones stay."""
    h, w = image.shape[:2]
    scale = min(width / w, height / h, 1)
    return downscale(image, max(int(round(max(h, w) * scale)), 1)) if scale < 1 else image


def downscale(image: np.ndarray, most: int = 2560) -> np.ndarray:
    """The longer side brought down to most by the mean over areas; 0 leaves it."""
    h, w = image.shape[:2]
    if not most or max(h, w) <= most:
        return image
    scale = most / max(h, w)
    to = max(int(h * scale), 1), max(int(w * scale), 1)
    for axis, n in enumerate(to):
        cut = np.linspace(0, image.shape[axis], n + 1).astype(int)[:-1]
        size = np.diff(np.r_[cut, image.shape[axis]])
        total = np.add.reduceat(image.astype(np.float64), cut, axis=axis)
        image = total / size.reshape([-1 if a == axis else 1 for a in range(image.ndim)])
    return np.rint(image).astype(np.uint8)


def split_spread(image: np.ndarray) -> list[np.ndarray]:
    """Both halves of a double page with 3 % overlap; else the image."""
    h, w = image.shape[:2]
    if w <= h * 1.15:
        return [image]
    mid, over = w // 2, int(w * 0.03)
    return [image[:, : min(w, mid + over)], image[:, max(0, mid - over) :]]
