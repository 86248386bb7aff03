"""Grey values of baseline JPEG frames with any tables and sampling factors: what ``mjpeg`` needs for files of other makers."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# --- Fixed values of the standard: the Huffman tables of frames that bring none, as motion JPEG allows.
# How many codes there are of 1, 2, ... 16 bits, and the first symbols; the other (run, size) symbols follow in order.
_DC = {0: bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), 1: bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0])}
_AC = {
    0: (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    1: (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


def standard_tables() -> dict[tuple[int, int], tuple[bytes, bytes]]:
    """(class, number) -> counts of codes by length, symbols."""
    out = {(0, i): (counts, bytes(range(12))) for i, counts in _DC.items()}
    for i, (counts, text) in _AC.items():
        first = bytes.fromhex(text)
        out[1, i] = counts, first + bytes(s for s in range(256) if 1 <= s % 16 <= 10 and s not in first)
    return out


ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else -(i // 8)))
_COSINES = np.array([[(0.5 if u else 0.5 / np.sqrt(2)) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


@lru_cache(maxsize=64)
def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """For the next 16 bits: length and symbol of the code that they begin with (length << 8 | symbol), or 0."""
    table, code, at = np.zeros(1 << 16, dtype=np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table.tolist()


def _segments(frame: bytes) -> tuple[list[tuple[int, bytes]], int]:
    """(marker, data) up to the start of scan, which is the last, and where the scan's bytes begin."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, out = 2, []
    while True:
        if frame[at] != 0xFF:
            raise ValueError("no marker where one has to be")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        out.append((marker, frame[at + 4 : at + 2 + size]))
        at += 2 + size
        if marker == 0xDA:
            return out, at


def _blocks(data: bytes, mcus: int, units: list[tuple[int, list[int], list[int]]]) -> list[list[int]]:
    """The coefficients, in zigzag order, of the first component's blocks in a run of MCUs; units: (component, DC codes, AC codes)."""
    acc = held = at = 0
    size, before, out = len(data), [0] * 4, []

    def fill(n: int) -> None:
        nonlocal acc, held, at
        while held < n:
            acc = (acc & ((1 << held) - 1)) << 8 | (data[at] if at < size else 0xFF)
            at, held = at + 1, held + 8
        if at > size + 8:
            raise ValueError("a scan that ends early")

    def symbol(codes: list[int]) -> int:
        nonlocal held
        fill(16)
        found = codes[acc >> (held - 16) & 0xFFFF]
        if not found:
            raise ValueError("a code that no table has")
        held -= found >> 8
        return found & 255

    def number(bits: int) -> int:
        nonlocal held
        if not bits:
            return 0
        fill(bits)
        held -= bits
        value = acc >> held & ((1 << bits) - 1)
        return value if value >> (bits - 1) else value - (1 << bits) + 1

    for _ in range(mcus):
        for component, dc, ac in units:
            before[component] += number(symbol(dc))
            block, k = [0] * 64, 1
            block[0] = before[component]
            while k < 64:
                run, bits = divmod(symbol(ac), 16)
                if not bits and run != 15:
                    break
                k += run
                if k > 63:
                    raise ValueError("a block of more than 64 coefficients")
                block[k] = number(bits)
                k += 1
            if component == 0:
                out.append(block)
    return out


def grey_values(frame: bytes) -> np.ndarray:
    """The first component (height x width, 8 bits) of a baseline frame."""
    segments, at = _segments(frame)
    quantisers, tables, shape, interval, scan = {}, standard_tables(), None, 0, b""
    for marker, data in segments:
        if marker == 0xDB:
            while data:
                wide = data[0] >> 4
                quantisers[data[0] & 15] = np.frombuffer(data[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int64)
                data = data[65 + 64 * wide :]
        elif marker == 0xC4:
            while data:
                n = sum(data[1:17])
                tables[data[0] >> 4, data[0] & 15] = data[1:17], data[17 : 17 + n]
                data = data[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", data)[0]
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", data)
            shape = [(data[6 + 3 * i], data[7 + 3 * i] >> 4, data[7 + 3 * i] & 15, data[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            scan = data
    if not shape or depth != 8 or not height or not width or scan[0] != len(shape):
        raise ValueError("frames without a size, of another depth or of several scans")
    used = {scan[1 + 2 * i]: scan[2 + 2 * i] for i in range(scan[0])}
    if not all(1 <= h <= 4 and 1 <= v <= 4 for _, h, v, _ in shape):
        raise ValueError("sampling factors beyond 1 to 4")
    if len(shape) == 1:
        shape = [(shape[0][0], 1, 1, shape[0][3])]  # a scan of one component isn't interleaved
    wide, high = max(h for _, h, _, _ in shape), max(v for _, _, v, _ in shape)
    _, h, v, q = shape[0]
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    if (h, v) != (wide, high) or across * down > 8 * len(frame):
        raise ValueError("a first component of less than full size, or more blocks than bits")
    units = [(i, _codes(*tables[0, used[c] >> 4]), _codes(*tables[1, used[c] & 15])) for i, (c, hi, vi, _) in enumerate(shape) for _ in range(hi * vi)]
    end = frame.rfind(b"\xff\xd9")
    if end < at:
        raise ValueError("no end of image")
    parts, n, blocks = [frame[at:end]], across * down, []
    if interval:
        parts = _at_restarts(frame[at:end])
    for part in parts:
        own = min(interval or n, n)
        blocks += _blocks(part.replace(b"\xff\x00", b"\xff"), own, units)
        n -= own
    if n:
        raise ValueError("restart intervals are missing")
    natural = np.zeros((len(blocks), 64))
    natural[:, ZIGZAG] = np.array(blocks).reshape(-1, 64) * quantisers[q]
    pixels = _COSINES.T @ natural.reshape(-1, 8, 8) @ _COSINES + 128
    grid = np.clip(np.rint(pixels), 0, 255).astype(np.uint8).reshape(down, across, v, h, 8, 8)
    return grid.transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)[:height, :width]


def _at_restarts(scan: bytes) -> list[bytes]:
    """The scan between its restart markers."""
    out, first, at = [], 0, scan.find(b"\xff")
    while at >= 0:
        if 0xD0 <= (scan[at + 1] if at + 1 < len(scan) else 0) <= 0xD7:
            out.append(scan[first:at])
            first = at + 2
        at = scan.find(b"\xff", at + 2)
    return [*out, scan[first:]]
