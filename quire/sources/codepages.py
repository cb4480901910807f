"""EBCDIC code pages as code units, built from Python's own codecs and a few fixed values."""

from __future__ import annotations

UNMAPPED = 0xFFFF

# The glyphs that code pages 351 and 500 draw below 0x40, where the standard has control codes.
GLYPHS = {
    0x04: 0x2666, 0x09: 0x25CB, 0x10: 0x25BA, 0x14: 0x2191, 0x15: 0x2193, 0x1B: 0x2510, 0x1C: 0x250C, 0x1E: 0x2514, 0x1F: 0x2518,
    0x20: 0x00D7, 0x21: 0x2551, 0x22: 0x2550, 0x23: 0x2554, 0x24: 0x2566, 0x26: 0x2557, 0x28: 0x2584, 0x29: 0x2580, 0x2A: 0x2192, 0x2B: 0x2190,
    0x2C: 0x253C, 0x2D: 0x2500, 0x2E: 0x2265, 0x2F: 0x2264, 0x30: 0x2560, 0x31: 0x256C, 0x32: 0x2563, 0x33: 0x255A, 0x34: 0x2569, 0x35: 0x255D,
    0x37: 0x258C, 0x38: 0x2588, 0x39: 0x2590, 0x3A: 0x25A0, 0x3B: 0x252C, 0x3D: 0x251C, 0x3E: 0x2534, 0x3F: 0x2524,
}
# Where page 351 has brackets, beside page 037's letters and signs.
PAGE_351 = {0xAD: 0x005B, 0xBD: 0x005D}


def table(page: int) -> list[int]:
    """The 256 code units of page 37, 351 or 500; 0 to 3 stay spacing controls."""
    base = "cp500" if page == 500 else "cp037"
    out = [ord(bytes([b]).decode(base)) if b >= 0x40 else UNMAPPED for b in range(256)]
    if page != 37:
        for b, unit in GLYPHS.items():
            out[b] = unit
    if page == 351:
        for b, unit in PAGE_351.items():
            out[b] = unit
    for b in range(4):
        out[b] = b
    return out


TABLES = {p: table(p) for p in (37, 351, 500)}


def text(raw: bytes, page: int = 37) -> str:
    """Bytes as ASCII: no-break spaces are spaces, the copyright sign is "c", what has no ASCII form is "?"."""
    out = []
    for b in raw:
        u = TABLES[page][b]
        out.append(" " if u == 0xA0 else "c" if u == 0xA9 else chr(u) if 0x20 <= u <= 0x7E else "?")
    return "".join(out)


def dictionary_page(version: str, parameter: int) -> int:
    """The code page of a book's dictionary; an error where no book is known to say."""
    chosen = {" 1.0": 351, " 1.1": parameter or 351, " 1.2": parameter}.get(version)
    if chosen not in (351, 500):
        raise ValueError(f"unsupported dictionary text: version {version!r} with parameter {parameter}")
    return chosen
