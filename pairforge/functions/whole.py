"""Whether the bytes of an image file are whole: its parts are walked to the end, and checksums held."""

from __future__ import annotations

import struct
import zlib

#: Channels of each colour type of a PNG.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def intact(data: bytes | None) -> bool:
    """True if a PNG, JPEG, GIF or BMP file is there to its end; other bytes are no image that is known."""
    if not data:
        return False
    for start, check in ((b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8", _jpeg), (b"GIF8", _gif), (b"BM", _bmp)):
        if data.startswith(start):
            try:
                return check(data)
            except (IndexError, struct.error, zlib.error):
                return False
    return False


def _png(data: bytes) -> bool:
    """All chunks with their checksums, the header first and the end last, and pixels for every row."""
    at, kinds, body, head = 8, [], zlib.decompressobj(), b""
    left = None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if len(part) != size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(data[at + 4 : at + 8 + size]):
            return False
        kinds.append(kind)
        if kind == b"IHDR":
            head = part
            wide, high, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", head)
            left = None if laced else high * (1 + (wide * depth * CHANNELS.get(colour, 1) + 7) // 8)
        elif kind == b"IDAT":
            made = len(body.decompress(part))
            left = left - made if left is not None else None
        at += 12 + size
        if kind == b"IEND":
            break
    return bool(kinds) and kinds[0] == b"IHDR" and kinds[-1] == b"IEND" and body.eof and left in (None, 0)


def _jpeg(data: bytes) -> bool:
    """Segments to the first scan; then, of each scan, all up to a marker that is none of its own; to the end marker."""
    at, framed, scanned = 2, False, False
    while True:
        if data[at] != 0xFF:
            return False
        while data[at] == 0xFF:
            at += 1
        kind = data[at]
        at += 1
        if kind == 0xD9:
            return framed and scanned
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            continue
        size = struct.unpack_from(">H", data, at)[0]
        if at + size > len(data):
            return False
        framed = framed or (0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC))
        at += size
        if kind == 0xDA:
            scanned = True
            while True:
                at = data.find(b"\xff", at)
                if at < 0:
                    return False
                if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                    at += 2
                elif data[at + 1] == 0xFF:
                    at += 1
                else:
                    break


def _gif(data: bytes) -> bool:
    """All blocks to the trailer."""

    def blocks(at: int) -> int:
        while data[at]:
            at += data[at] + 1
        return at + 1

    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    at = 13 + table(data[10])
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at = blocks(at + 2)
        elif data[at] == 0x2C:
            at = blocks(at + 11 + table(data[at + 9]))
        else:
            return False
    return True


def _bmp(data: bytes) -> bool:
    size, _, start = struct.unpack_from("<III", data, 2)
    return start < size <= len(data)
