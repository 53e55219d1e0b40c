"""What image files are, by their first bytes; full decoding is the model's."""

from __future__ import annotations

import struct


def _jpeg(content: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", content[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None


def image_header(content: bytes) -> tuple[str, int, int]:
    """(format, width, height) of a PNG, JPEG, GIF or WebP file; anything else, and a file cut off or of no size, is an error."""
    size = None
    if content[:8] == b"\x89PNG\r\n\x1a\n" and content[12:16] == b"IHDR" and len(content) >= 24:
        kind, size = "png", struct.unpack(">II", content[16:24])
    elif content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        kind, size = "gif", struct.unpack("<HH", content[6:10])
    elif content[:2] == b"\xff\xd8":
        kind, size = "jpeg", _jpeg(content)
    elif content[:4] == b"RIFF" and content[8:15] == b"WEBPVP8" and len(content) >= 30:
        kind = "webp"
        if content[15:16] == b"X":
            size = tuple(int.from_bytes(content[a : a + 3], "little") + 1 for a in (24, 27))
        elif content[15:16] == b"L":
            bits = int.from_bytes(content[21:25], "little")
            size = ((bits & 0x3FFF) + 1, ((bits >> 14) & 0x3FFF) + 1)
        else:
            size = tuple(x & 0x3FFF for x in struct.unpack("<HH", content[26:30]))
    if not size or not all(size):
        raise ValueError("unreadable image")
    return kind, *size
