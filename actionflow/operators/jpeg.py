"""JPEG in numpy: a baseline encoder with Huffman codes fitted to the image, and a decoder of baseline and progressive files."""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

from actionflow.operators.images import Unsupported

# The example quantisation tables of the standard, row by row.
LUMA_STEPS = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMA_STEPS = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *[99] * 32]

ZIGZAG = np.array([i * 8 + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
_k = np.arange(8)
DCT = np.sqrt(2 / 8) * np.cos((2 * _k[None] + 1) * _k[:, None] * np.pi / 16)
DCT[0] /= np.sqrt(2)


def quantisers(quality: int) -> list[np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA_STEPS, CHROMA_STEPS)]


def code_lengths(counts: dict[int, int]) -> list[tuple[int, list[int]]]:
    """(length, symbols) of a Huffman code of at most 16 bits that leaves the code of all ones unused."""
    heap = [(n, s, (s,)) for s, n in counts.items()] + [(0, 256, (256,))]
    heapq.heapify(heap)
    depth = dict.fromkeys([*counts, 256], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    bits = [0] * 300
    for d in depth.values():
        bits[max(d, 1)] += 1
    for n in range(299, 16, -1):  # move pairs up until nothing is longer than 16
        while bits[n]:
            m = n - 2
            while not bits[m]:
                m -= 1
            bits[n] -= 2
            bits[n - 1] += 1
            bits[m + 1] += 2
            bits[m] -= 1
    longest = max(i for i in range(17) if bits[i])
    bits[longest] -= 1  # the spare symbol's
    order = sorted(counts, key=lambda s: (depth[s], s))
    out, at = [], 0
    for n in range(1, 17):
        out.append((n, order[at : at + bits[n]]))
        at += bits[n]
    return out


def codes(table: list[tuple[int, list[int]]]) -> dict[int, tuple[int, int]]:
    code, out = 0, {}
    for n, symbols in table:
        for s in symbols:
            out[s] = (code, n)
            code += 1
        code <<= 1
    return out


def _size(v: int) -> int:
    return int(abs(v)).bit_length()


def _tokens(blocks: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(0 for DC or 1 for AC, symbol, extra value, its bits) of zigzag-ordered blocks of one component, a list for each block."""
    out, before = [], 0
    for block in blocks.tolist():
        row = []
        d = block[0] - before
        before = block[0]
        n = _size(d)
        row.append((0, n, d if d >= 0 else d + (1 << n) - 1, n))
        run = 0
        last = max((i for i, v in enumerate(block) if v and i), default=0)
        for v in block[1 : last + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                row.append((1, 0xF0, 0, 0))
                run -= 16
            n = _size(v)
            row.append((1, run << 4 | n, v if v >= 0 else v + (1 << n) - 1, n))
            run = 0
        if last < 63:
            row.append((1, 0, 0, 0))
        out.append(row)
    return out


def encode(pixels: np.ndarray, quality: int) -> bytes:
    """pixels: (height, width, 3 or more), 8 bit; no subsampling."""
    height, width = pixels.shape[:2]
    rgb = np.pad(pixels[:, :, :3].astype(float), ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge")
    r, g, b = np.moveaxis(rgb, 2, 0)
    planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    steps = quantisers(quality)
    parts = []
    for k, p in enumerate(planes):
        blocks = p.reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        parts.append(_tokens(np.rint((DCT @ blocks @ DCT.T).reshape(-1, 64) / steps[min(k, 1)]).astype(int)[:, ZIGZAG]))
    counts = [[Counter(), Counter()], [Counter(), Counter()]]
    for k, part in enumerate(parts):
        for row in part:
            for kind, symbol, _, _ in row:
                counts[min(k, 1)][kind][symbol] += 1
    tables = [[code_lengths(c) for c in pair] for pair in counts]
    maps = [[codes(t) for t in pair] for pair in tables]
    bits: list[str] = []
    for rows in zip(*parts, strict=True):
        for k, row in enumerate(rows):
            for kind, symbol, value, n in row:
                code, m = maps[min(k, 1)][kind][symbol]
                bits.append(format(code, f"0{m}b"))
                if n:
                    bits.append(format(value, f"0{n}b"))
    line = "".join(bits)
    line += "1" * (-len(line) % 8)
    body = int(line, 2).to_bytes(len(line) // 8, "big").replace(b"\xff", b"\xff\x00")
    part = lambda mark, data: b"\xff" + bytes([mark]) + struct.pack(">H", len(data) + 2) + data
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for i, q in enumerate(steps):
        out += part(0xDB, bytes([i, *q[ZIGZAG].tolist()]))
    out += part(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    for i in (0, 1):
        for kind in (0, 1):
            t = tables[i][kind]
            out += part(0xC4, bytes([kind << 4 | i, *(len(s) for _, s in t), *(x for _, s in t for x in s)]))
    return out + part(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + body + b"\xff\xd9"


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def one(self) -> int:
        if not self.n:
            if self.at >= len(self.data):
                raise Unsupported("the JPEG data end early")
            self.held, self.n = self.data[self.at], 8
            self.at += 2 if self.held == 0xFF and self.data[self.at + 1 : self.at + 2] == b"\0" else 1
        self.n -= 1
        return self.held >> self.n & 1

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.one()
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.one()
            if (found := table.get((code, n))) is not None:
                return found
        raise Unsupported("a JPEG code that isn't in its table")

    def value(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _scan_end(data: bytes, at: int) -> int:
    """Where the next marker is that isn't a restart."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7 and data[at + 1] != 0xFF:
            return at
        at += 1


class _Scan:
    """One scan: which coefficients of which components it has, and how they are coded.

    band: first and last coefficient; bit: the lowest bit it gives; again: if it only
    adds that bit to what earlier scans gave.
    """

    def __init__(self, body: bytes, tables: dict, progressive: bool, band: tuple[int, int], bit: int, again: bool) -> None:
        self.bits, self.tables, self.progressive, self.band, self.bit, self.again = _Bits(body), tables, progressive, band, bit, again
        self.before: dict[int, int] = {}
        self.empty = 0  # blocks to come without new coefficients

    def restart(self) -> None:
        bits = self.bits
        bits.n = 0
        while bits.data[bits.at] != 0xFF or not 0xD0 <= bits.data[bits.at + 1] <= 0xD7:
            bits.at += 1
        bits.at += 2
        self.before, self.empty = {}, 0

    def block(self, block: np.ndarray, k: int, use: int) -> None:
        """Adds to the coefficients of a block of component k."""
        first, last = self.band
        if first == 0:
            if self.again:
                block[0] |= self.bits.one() << self.bit
            else:
                self.before[k] = self.before.get(k, 0) + self.bits.value(self.bits.symbol(self.tables[use >> 4]))
                block[0] = self.before[k] << self.bit
            if not self.progressive:
                self._new(block, 1, 63, self.tables[0x10 | use & 15])
        elif self.again:
            self._refined(block, first, last, self.tables[0x10 | use & 15])
        elif self.empty:
            self.empty -= 1
        else:
            self._new(block, first, last, self.tables[0x10 | use & 15])

    def _new(self, block: np.ndarray, at: int, last: int, table: dict) -> None:
        bits = self.bits
        while at <= last:
            zeros, size = divmod(bits.symbol(table), 16)
            if size:
                at += zeros
                block[min(at, 63)] = bits.value(size) * (1 << self.bit)
            elif zeros < 15:
                self.empty = (1 << zeros) - 1 + bits.take(zeros)
                return
            else:
                at += 15
            at += 1

    def _refined(self, block: np.ndarray, at: int, last: int, table: dict) -> None:
        bits, step = self.bits, 1 << self.bit

        def corrected(at: int, zeros: int) -> int:
            """Gives known coefficients their next bit, up to where so many zeros have been passed."""
            while at <= last:
                if block[at]:
                    if bits.one():
                        block[at] += step if block[at] > 0 else -step
                elif zeros == 0:
                    break
                else:
                    zeros -= 1
                at += 1
            return at

        while not self.empty and at <= last:
            zeros, size = divmod(bits.symbol(table), 16)
            if not size and zeros < 15:
                self.empty = (1 << zeros) + bits.take(zeros)
                break
            new = (step if bits.one() else -step) if size else 0
            at = corrected(at, zeros)
            if new and at <= last:
                block[at] = new
            at += 1
        if self.empty:
            corrected(at, 64)
            self.empty -= 1


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) of a baseline or progressive JPEG of one or three components."""
    if data[:2] != b"\xff\xd8":
        raise Unsupported("not a JPEG")
    at, steps, tables, restart, planes = 2, {}, {}, 0, None
    while at < len(data):
        if data[at] != 0xFF:
            raise Unsupported("a JPEG marker is missing")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        part = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while part:
                wide = part[0] >> 4
                n = 64 * (1 + wide)
                steps[part[0] & 15] = np.frombuffer(part[1 : 1 + n], ">u2" if wide else np.uint8).astype(int)
                part = part[1 + n :]
        elif mark == 0xC4:
            while part:
                lengths = part[1:17]
                symbols = part[17 : 17 + sum(lengths)]
                k, table = 0, []
                for n, many in enumerate(lengths, 1):
                    table.append((n, list(symbols[k : k + many])))
                    k += many
                tables[part[0]] = {c: s for s, c in codes(table).items()}
                part = part[17 + k :]
        elif mark in (0xC0, 0xC1, 0xC2):
            depth, height, width, many = struct.unpack(">BHHB", part[:6])
            parts = [tuple(part[6 + 3 * i : 9 + 3 * i]) for i in range(many)]
            if depth != 8 or many not in (1, 3) or not height or not width:
                raise Unsupported("a JPEG of another kind")
            if many == 1:
                parts = [(parts[0][0], 0x11, parts[0][2])]
            progressive = mark == 0xC2
            across, down = max(p[1] >> 4 for p in parts), max(p[1] & 15 for p in parts)
            columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
            planes = [np.zeros((rows * (p[1] & 15), columns * (p[1] >> 4), 64), int) for p in parts]
        elif 0xC3 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise Unsupported("a JPEG that is neither baseline nor progressive")
        elif mark == 0xDD:
            restart = struct.unpack(">H", part)[0]
        elif mark == 0xDA:
            if planes is None:
                raise Unsupported("a JPEG scan without a frame")
            end = _scan_end(data, at)
            use = {part[1 + 2 * i]: part[2 + 2 * i] for i in range(part[0])}
            first, last, bit = part[1 + 2 * part[0] :][:3]
            scan = _Scan(data[at:end], tables, progressive, (first, last) if progressive else (0, 63), bit & 15 if progressive else 0, progressive and bit >> 4 > 0)
            mine = [(k, p) for k, p in enumerate(parts) if p[0] in use]
            if len(mine) == 1:  # its blocks one by one, without those that only fill up the others'
                k, (name, shape, _) = mine[0]
                wide = -(-(-(-width * (shape >> 4) // across)) // 8)
                high = -(-(-(-height * (shape & 15) // down)) // 8)
                units = [[(k, use[name], y, x)] for y in range(high) for x in range(wide)]
            else:
                units = [[(k, use[name], y * (shape & 15) + i, x * (shape >> 4) + j) for k, (name, shape, _) in mine for i in range(shape & 15) for j in range(shape >> 4)] for y in range(rows) for x in range(columns)]
            for n, unit in enumerate(units):
                if restart and n and n % restart == 0:
                    scan.restart()
                for k, tabled, y, x in unit:
                    scan.block(planes[k][y, x], k, tabled)
            at = end
    if planes is None:
        raise Unsupported("a JPEG without a picture")
    full = []
    for (_, shape, q), p in zip(parts, planes, strict=True):
        square = np.zeros(p.shape)
        square[:, :, ZIGZAG] = p * steps[q]
        spatial = DCT.T @ square.reshape(*p.shape[:2], 8, 8) @ DCT
        flat = spatial.transpose(0, 2, 1, 3).reshape(p.shape[0] * 8, p.shape[1] * 8)
        full.append(np.repeat(np.repeat(flat, down // (shape & 15), 0), across // (shape >> 4), 1)[:height, :width])
    out = np.full((height, width, 4), 255, np.uint8)
    luma = full[0] + 128
    if len(full) == 1:
        rgb = np.stack([luma] * 3, 2)
    else:
        cb, cr = full[1:]
        rgb = np.stack([luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb], 2)
    out[:, :, :3] = np.clip(np.rint(rgb), 0, 255)
    return out
