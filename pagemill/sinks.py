"""Where results go: image files and data URIs, PNG bytes, progress on a stream."""

from __future__ import annotations

import base64
import struct
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np


def png(gray: np.ndarray) -> bytes:
    """PNG of an 8-bit gray (h, w) or RGB (h, w, 3) image."""
    h, w = gray.shape[:2]
    rgb = gray.ndim == 3
    rows = np.concatenate([np.zeros((h, 1), np.uint8), gray.reshape(h, -1).astype(np.uint8)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if rgb else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def pixels(data: bytes | None, width: int, height: int, codec: str) -> np.ndarray | None:
    """Gray or RGB array of a raw image of the scan; None for codecs that need a library."""
    if not data or not codec.startswith("raw") or width <= 0 or height <= 0:
        return None
    n = width * height
    if codec.startswith("raw1") and not codec.startswith("raw16"):
        line = (width + 7) // 8
        if len(data) < line * height:
            return None
        bits = np.unpackbits(np.frombuffer(data[: line * height], np.uint8).reshape(height, line), axis=1)[:, :width]
        return bits * np.uint8(255)
    a = np.frombuffer(data, np.uint8)
    if len(a) >= 3 * n:
        return a[: 3 * n].reshape(height, width, 3)
    return a[:n].reshape(height, width) if len(a) >= n else None


def data_uri(data: bytes, mime: str = "png") -> str:
    return f"data:image/{mime};base64,{base64.b64encode(data).decode()}"


def image_name(base: str, page: int, number: int, extension: str = "png") -> str:
    return f"{base}-{page}-{number}.{extension}".replace(" ", "-")


def big_enough(x0: float, y0: float, x1: float, y1: float, width: float, height: float, limit: float = 0.05) -> bool:
    """Images under the share of the page in width or height are not kept."""
    return x1 - x0 >= limit * width and y1 - y0 >= limit * height


class ProgressBar:
    """An iterable that writes its share done to a stream as it goes."""

    def __init__(self, items: Iterable, total: int | None = None, stream=None, width: int = 30):
        self.items, self.stream, self.width = items, stream or sys.stderr, width
        self.total = total if total is not None else len(items)

    def __iter__(self) -> Iterator:
        for k, item in enumerate(self.items):
            self._show(k)
            yield item
        self._show(self.total)
        self.stream.write("\n")

    def _show(self, k: int) -> None:
        share = k / self.total if self.total else 1.0
        full = int(share * self.width)
        self.stream.write(f"\r[{'=' * full}{' ' * (self.width - full)}] {int(share * 100)}%")
