"""Frames, lines and short labels drawn on a white picture, and its PNG file."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Signs of five columns, the lowest bit of a column on top; others are drawn as a frame.
SIGNS = {
    " ": "0000000000", ",": "0050300000", "-": "0808080808", ".": "0060600000", "/": "2010080402", ":": "0036360000", "<": "0814224100", ">": "0041221408", "_": "4040404040",
    "0": "3e5149453e", "1": "00427f4000", "2": "4261514946", "3": "2141454b31", "4": "1814127f10", "5": "2745454539", "6": "3c4a494930", "7": "0171090503", "8": "3649494936", "9": "064949291e",
    "A": "7e1111117e", "B": "7f49494936", "C": "3e41414122", "D": "7f4141221c", "E": "7f49494941", "F": "7f09090901", "G": "3e4149497a", "H": "7f0808087f", "I": "00417f4100", "J": "2040413f01", "K": "7f08142241", "L": "7f40404040", "M": "7f020c027f",
    "N": "7f0408107f", "O": "3e4141413e", "P": "7f09090906", "Q": "3e4151215e", "R": "7f09192946", "S": "4649494931", "T": "01017f0101", "U": "3f4040403f", "V": "1f2040201f", "W": "3f4038403f", "X": "6314081463", "Y": "0708700807", "Z": "6151494543",
    "[": "007f414100", "]": "0041417f00", "{": "0008364100", "}": "0041360800", "x": "4428102844", "y": "0c5050503c",
}
_FRAME = "7f4141417f"


def colour(name: str) -> tuple[int, int, int]:
    """``#rrggbb`` as numbers."""
    return tuple(bytes.fromhex(name[1:]))


class Picture:
    """A picture of whole pixels; what lies outside it isn't drawn."""

    def __init__(self, width: float, height: float):
        self.dots = np.full((max(1, round(height)), max(1, round(width)), 3), 255, dtype=np.uint8)

    def fill(self, x0: float, y0: float, x1: float, y1: float, rgb: tuple[int, int, int]) -> None:
        a, b, c, d = (max(0, round(v)) for v in (x0, y0, x1, y1))
        self.dots[b:d, a:c] = rgb

    def frame(self, x0: float, y0: float, x1: float, y1: float, rgb: tuple[int, int, int], width: int) -> None:
        for box in ((x0, y0, x1, y0 + width), (x0, y1 - width, x1, y1), (x0, y0, x0 + width, y1), (x1 - width, y0, x1, y1)):
            self.fill(*box, rgb)

    def line(self, x0: float, y0: float, x1: float, y1: float, rgb: tuple[int, int, int]) -> None:
        n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
        xs, ys = np.linspace(x0, x1, n).round().astype(int), np.linspace(y0, y1, n).round().astype(int)
        inside = (xs >= 0) & (ys >= 0) & (xs < self.dots.shape[1]) & (ys < self.dots.shape[0])
        self.dots[ys[inside], xs[inside]] = rgb

    def write(self, x: float, y: float, text: str, rgb: tuple[int, int, int]) -> None:
        """``text`` with its left upper corner at x, y; signs are 5 by 7, seven apart."""
        for k, sign in enumerate(text):
            columns = np.frombuffer(bytes.fromhex(SIGNS.get(sign, _FRAME)), dtype=np.uint8)
            ys, xs = np.nonzero(columns[None, :] >> np.arange(7)[:, None] & 1)
            ys, xs = ys + round(y), xs + round(x) + 7 * k
            inside = (xs >= 0) & (ys >= 0) & (xs < self.dots.shape[1]) & (ys < self.dots.shape[0])
            self.dots[ys[inside], xs[inside]] = rgb

    def png(self) -> bytes:
        """The picture as a PNG file of 8-bit colours."""
        height, width, _ = self.dots.shape
        rows = np.zeros((height, 1 + 3 * width), dtype=np.uint8)  # each row begins with 0: no filter
        rows[:, 1:] = self.dots.reshape(height, -1)
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")
