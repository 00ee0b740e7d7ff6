"""BMP, GIF and TIFF in numpy. All readers give (height, width, 4) of 8 bits, of the first picture in the file."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from actionflow.operators.images import Unsupported


def _opaque(pixels: np.ndarray) -> np.ndarray:
    """Any raster as (height, width, 4)."""
    if pixels.ndim == 2:
        pixels = np.repeat(pixels[:, :, None], 3, 2)
    if pixels.shape[2] == 3:
        pixels = np.concatenate([pixels, np.full((*pixels.shape[:2], 1), 255, np.uint8)], 2)
    return np.ascontiguousarray(pixels, np.uint8)


def _unpacked(rows: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Samples of 1, 2, 4 or 8 bits, the first in the high bits of a byte."""
    if bits == 8:
        return rows[:, :width]
    each = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)
    return (each @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)[:, :width]


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM":
        raise Unsupported("not a BMP")
    start, head, width, height, _, bits, packing = struct.unpack("<IIiiHHI", data[10:34])
    colours = struct.unpack("<I", data[46:50])[0] or (1 << bits if bits <= 8 else 0)
    stride = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows if height < 0 else rows[::-1]
    if bits <= 8 and packing == 0:
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
        return _opaque(palette[_unpacked(rows, width, bits)])
    if bits == 24 and packing == 0:
        return _opaque(rows[:, : width * 3].reshape(-1, width, 3)[:, :, ::-1])
    if bits == 32 and packing in (0, 3):
        masks = struct.unpack("<III", data[54:66]) if packing else (0xFF0000, 0xFF00, 0xFF)
        alpha = struct.unpack("<I", data[66:70])[0] if packing and head >= 56 else 0
        words = np.ascontiguousarray(rows[:, : width * 4]).view("<u4")
        part = lambda mask: ((words & mask) >> ((mask & -mask).bit_length() - 1)).astype(np.uint8) if mask else np.full(words.shape, 255, np.uint8)
        return np.stack([part(m) for m in (*masks, alpha)], 2)
    raise Unsupported(f"a BMP of {bits} bits, packed by {packing}")


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24 bits where nothing is transparent, else 32 with an alpha mask."""
    p = _opaque(pixels)
    height, width = p.shape[:2]
    if (p[:, :, 3] == 255).all():
        stride = (width * 3 + 3) // 4 * 4
        body = np.zeros((height, stride), np.uint8)
        body[:, : width * 3] = p[::-1, :, 2::-1].reshape(height, -1)
        head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0)
    else:
        body = p[::-1][:, :, [2, 1, 0, 3]]
        head = struct.pack("<IiiHHIIiiII", 108, width, height, 1, 32, 3, body.size, 2835, 2835, 0, 0) + struct.pack("<IIII", 0xFF0000, 0xFF00, 0xFF, 0xFF000000) + b"BGRs" + bytes(48)
    return b"BM" + struct.pack("<IHHI", 14 + len(head) + body.size, 0, 0, 14 + len(head)) + head + body.tobytes()


def _unlzw(data: bytes, start_bits: int, high_first: bool) -> bytes:
    """GIF packs codes from the low bits on; TIFF from the high ones, and widens a code earlier."""
    clear, end = 1 << start_bits, (1 << start_bits) + 1
    early = int(high_first)
    table: list[bytes] = []
    out, held, many, width, before = [], 0, 0, start_bits + 1, b""
    for byte in data:
        held, many = ((held << 8) | byte, many + 8) if high_first else (held | (byte << many), many + 8)
        while many >= width:
            if high_first:
                code = held >> (many - width)
                held &= (1 << (many - width)) - 1
            else:
                code = held & ((1 << width) - 1)
                held >>= width
            many -= width
            if code == clear:
                table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], start_bits + 1, b""
                continue
            if code == end:
                return b"".join(out)
            if not table:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
            now = table[code] if code < len(table) else before + before[:1]
            if before and len(table) < 4096:
                table.append(before + now[:1])
            out.append(now)
            before = now
            if len(table) + early >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def _lzw(data: bytes, start_bits: int) -> bytes:
    """As GIF has it."""
    clear, end = 1 << start_bits, (1 << start_bits) + 1
    out, held, many, width = bytearray(), 0, 0, start_bits + 1

    def put(code: int) -> None:
        nonlocal held, many
        held |= code << many
        many += width
        while many >= 8:
            out.append(held & 255)
            held >>= 8
            many -= 8

    put(clear)
    table = {bytes([i]): i for i in range(clear)}
    here = b""
    for byte in data:
        more = here + bytes([byte])
        if more in table:
            here = more
            continue
        put(table[here])
        if len(table) + 2 < 4096:
            table[more] = len(table) + 2
            if table[more] == 1 << width:
                width += 1
        else:
            put(clear)
            table, width = {bytes([i]): i for i in range(clear)}, start_bits + 1
        here = bytes([byte])
    if here:
        put(table[here])
    put(end)
    if many:
        out.append(held & 255)
    return bytes(out)


def decode_gif(data: bytes) -> np.ndarray:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise Unsupported("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at = 13
    colours = lambda flags, at: np.frombuffer(data, np.uint8, 3 << ((flags & 7) + 1), at).reshape(-1, 3)
    palette = None
    if flags & 0x80:
        palette = colours(flags, at)
        at += palette.size
    clear = -1
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            if data[at + 1] == 0xF9 and data[at + 3] & 1:
                clear = data[at + 6]
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        if flags & 0x80:
            palette = colours(flags, at)
            at += palette.size
        bits, packed = data[at], bytearray()
        at += 1
        while data[at]:
            packed += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        index = np.frombuffer(_unlzw(bytes(packed), bits, False)[: w * h].ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(first, h, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        part = _opaque(palette[np.minimum(index, len(palette) - 1)])
        part[index == clear, 3] = 0
        whole = np.zeros((max(height, top + h), max(width, left + w), 4), np.uint8)
        whole[top : top + h, left : left + w] = part
        return whole
    raise Unsupported("a GIF without a picture")


def encode_gif(pixels: np.ndarray) -> bytes:
    """Up to 255 colours as they are; of more the nearest in a cube of 6 by 7 by 6. Half transparent is transparent."""
    p = _opaque(pixels)
    height, width = p.shape[:2]
    see = p[:, :, 3] >= 128
    rgb = p[:, :, :3].astype(np.int64)
    key = (rgb[:, :, 0] << 16) | (rgb[:, :, 1] << 8) | rgb[:, :, 2]
    found, index = np.unique(key, return_inverse=True)
    index = index.reshape(height, width)
    if len(found) > 255:
        steps = np.array([6, 7, 6])
        level = np.rint(rgb * (steps - 1) / 255).astype(np.int64)
        index = (level[:, :, 0] * 7 + level[:, :, 1]) * 6 + level[:, :, 2]
        a, b, c = np.meshgrid(*[np.rint(np.arange(n) * 255 / (n - 1)).astype(np.int64) for n in steps], indexing="ij")
        found = ((a << 16) | (b << 8) | c).ravel()
    palette = np.zeros((256, 3), np.uint8)
    palette[: len(found)] = np.stack([found >> 16, found >> 8 & 255, found & 255], 1)
    index = np.where(see, index, 255).astype(np.uint8)
    body = _lzw(index.tobytes(), 8)
    parts = b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255))
    mark = b"" if see.all() else b"\x21\xf9\x04\x01\0\0\xff\0"
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 0, 0) + palette.tobytes() + mark + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08" + parts + b"\0;"


def _unpackbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        else:
            out.append(data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
            at += 2 if n > 128 else 1
    return b"".join(out)


SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4}
LETTERS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}


def decode_tiff(data: bytes) -> np.ndarray:
    """In strips, grey, palette or RGB, of 1, 2, 4, 8 or 16 bits; not packed, by LZW, PackBits or deflate."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise Unsupported("not a TIFF")
    end = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(end + "I", data[4:8])[0]
    tags: dict[int, list[int]] = {}
    for k in range(struct.unpack(end + "H", data[at : at + 2])[0]):
        tag, kind, many = struct.unpack(end + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        size, place = SIZES.get(kind, 0) * many, at + 10 + 12 * k
        if kind not in LETTERS:
            continue
        place = place if size <= 4 else struct.unpack(end + "I", data[place : place + 4])[0]
        tags[tag] = list(struct.unpack(f"{end}{many}{LETTERS[kind]}", data[place : place + size]))
    one = lambda tag, fallback: tags.get(tag, [fallback])[0]
    width, height, packing, look, n = one(256, 0), one(257, 0), one(259, 1), one(262, 1), one(277, 1)
    bits = one(258, 1)
    if 273 not in tags or one(284, 1) != 1 or bits not in (1, 2, 4, 8, 16) or look > 3 or (bits < 8 and n > 1):
        raise Unsupported("a TIFF in tiles, planes, or of another kind of sample")
    unpack = {1: bytes, 5: lambda x: _unlzw(x, 8, True), 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpackbits}.get(packing)
    if unpack is None:
        raise Unsupported(f"a TIFF packed by {packing}")
    sizes = tags.get(279) or [len(data) - tags[273][0]]
    stride = (width * n * bits + 7) // 8
    whole = b"".join(unpack(data[a : a + size]) for a, size in zip(tags[273], sizes, strict=True))
    rows = np.frombuffer(whole[: stride * height].ljust(stride * height, b"\0"), np.uint8).reshape(height, stride)
    if bits == 16:
        wide = np.ascontiguousarray(rows).view(end + "u2").reshape(height, width, n)
        samples = (np.cumsum(wide, axis=1, dtype=np.uint16) if one(317, 1) == 2 else wide) >> 8
    else:
        samples = _unpacked(rows, width * n, bits).reshape(height, width, n)
        if one(317, 1) == 2:
            samples = np.cumsum(samples, axis=1, dtype=np.uint8)
    samples = samples.astype(np.uint8)
    if look == 3:
        palette = (np.array(tags[320]).reshape(3, -1).T >> 8).astype(np.uint8)
        return _opaque(palette[samples[:, :, 0]])
    if bits < 8:
        samples = (samples * (255 // ((1 << bits) - 1))).astype(np.uint8)
    if look == 0:
        samples = np.concatenate([255 - samples[:, :, :1], samples[:, :, 1:]], 2)
    if look == 2:
        return _opaque(samples[:, :, : (4 if n >= 4 and 338 in tags else 3)])
    grey = _opaque(samples[:, :, 0])
    if n >= 2 and 338 in tags:
        grey[:, :, 3] = samples[:, :, 1]
    return grey


def encode_tiff(pixels: np.ndarray) -> bytes:
    """One deflated strip of RGB, with alpha where something is transparent."""
    p = _opaque(pixels)
    height, width = p.shape[:2]
    n = 3 if (p[:, :, 3] == 255).all() else 4
    body = zlib.compress(np.ascontiguousarray(p[:, :, :n]).tobytes(), 6)
    body += b"\0" * (len(body) % 2)
    depths = 8 + len(body)
    entries = [(256, 4, width), (257, 4, height), (258, 3, depths), (259, 3, 8), (262, 3, 2), (273, 4, 8), (277, 3, n), (278, 4, height), (279, 4, len(body)), *([(338, 3, 2)] if n == 4 else [])]
    table = b"".join(struct.pack("<HHI", tag, kind, n if tag == 258 else 1) + struct.pack("<I", value) for tag, kind, value in entries)
    return b"II*\0" + struct.pack("<I", depths + 2 * n) + body + struct.pack(f"<{n}H", *[8] * n) + struct.pack("<H", len(entries)) + table + bytes(4)
