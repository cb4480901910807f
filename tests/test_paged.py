import struct

import pytest

from quire.sources import paged
from quire.sources.codepages import TABLES, dictionary_page, text


def page(cls, body):
    return struct.pack(">HH", cls, 4 + len(body)) + body + bytes(paged.PAGE - 4 - len(body))


def ebcdic(s):
    return s.encode("cp500")


def block(b):
    return bytes([len(b)]) + b if len(b) <= 0xEF else struct.pack(">H", 0xF000 + len(b)) + b


def book(version=" 1.2", parameter=500, words=(), records=(), starts=(), topics=(), chained=False):
    """Pages: 0 header, 1 directory, 2 dictionary, 3 content, 4 continuation of the topic table."""
    d = bytearray(paged.PAGE)
    put = lambda at, v: d.__setitem__(slice(at, at + 2), struct.pack(">H", v))
    d[0x10:0x14] = ebcdic(version)
    d[0x14], d[0x15] = 0xDC, 0xF0
    for at, v in ((0x16, 4), (0x28, 2), (0x2E, 1), (0x36, len(records)), (0x38, 1), (0x3A, 3), (0x34, 0x100), (0x3C, 0x200), (0x3E, len(topics)), (0x4C, parameter), (0x22, 0x400)):
        put(at, v)
    put(0x100, 1), put(0x102, 0), put(0x104, 1), put(0x106, len(records))
    first = topics[:1] if chained else topics
    put(0x200, len(first)), put(0x202, 4 if chained else 0)
    for k, t in enumerate(first):
        put(0x204 + 2 * k, t)
    for token, key in starts:
        put(0x400 + 2 * token, key)
    more = topics[1:] if chained else ()
    tail = struct.pack(">HH", len(more), 0) + b"".join(struct.pack(">H", t) for t in more)
    nested = b"".join(block(struct.pack(">H", key) + body) for key, body in words)
    dictionary = page(0x0100, block(b"\0\0\0" + nested)) if nested else page(0x0100, b"")
    return (
        struct.pack(">H", 1) + bytes(10) + ebcdic("Header").ljust(128, ebcdic(" ")) + bytes(paged.PAGE - 140)
        + bytes(d) + dictionary + page(0, b"".join(block(r) for r in records)) + tail + bytes(paged.PAGE - len(tail))
    )


def literal(s):
    return bytes([len(s)]) + ebcdic(s)


@pytest.mark.parametrize("version, parameter, byte, wanted", [(" 1.0", 0, 0x4F, "|"), (" 1.1", 0, 0x4F, "|"), (" 1.1", 500, 0x4F, "!"), (" 1.2", 500, 0x4F, "!"), (" 1.0", 0, 0xAD, "["), (" 1.0", 0, 0x4A, "¢"), (" 1.2", 500, 0x4A, "[")])
def test_code_pages(version, parameter, byte, wanted):
    assert chr(TABLES[dictionary_page(version, parameter)][byte]) == wanted


@pytest.mark.parametrize("version, parameter", [(" 1.2", 0), (" 1.3", 1), (" 1.3", 500)])
def test_unknown_code_pages(version, parameter):
    with pytest.raises(ValueError):
        dictionary_page(version, parameter)


def test_delta_modes():
    t = TABLES[500]
    part = literal("abc") + bytes([0x00 | 1, 1]) + bytes([0x80 | 1, 0]) + bytes([0x40 | 2, 2]) + ebcdic("xy") + bytes([0xC0 | 1]) + ebcdic("z")
    out = {k: paged.spelled(v) for k, v in paged.deltas(part, 0xDC00, t).items()}
    assert out == {0xDC00: "abc", 0xDC01: "AbC", 0xDC02: "Abc", 0xDC03: "abxy", 0xDC04: "abxyz"}


def test_paged_index():
    b = paged.Book(book(topics=(1, 3, 5), records=[b"\x01"] * 6, chained=True))
    assert b.topic_starts() == [1, 3, 5, 7] and b.content_starts() == [1, 7]
    raw = bytearray(book(topics=(1, 3), records=[b"\x01"], chained=True))
    raw[4 * paged.PAGE : 4 * paged.PAGE + 4] = struct.pack(">HH", 0, 4)
    assert paged.Book(bytes(raw)).topic_starts() == []


def test_assembly():
    w = lambda s: [ord(c) for c in s]
    words, spans = paged.assemble([w("cfont"), w("3"), [2, *w("(")], w("a"), [1, *w(")")], [0, *w("-")]])
    assert paged.spelled(words) == "CFONT 3 (a)-"
    assert [s[0] for s in spans] == sorted(s[0] for s in spans) and spans[-1][1] == len(words)
    assert paged.assemble([]) == ([], []) and paged.spelled(paged.assemble([w("Sx"), w("y")])[0]) == "Sx y"


def test_relations(spark, tmp_path):
    words = [(0xDC00, literal("CTITLE=My")), (0xDC01, literal("book"))]
    records = [b"\xdc\x00\xdc\x01", b"\xdc\x01", b"\x05\xdc\x00"]
    (tmp_path / "one.BOO").write_bytes(book(words=words, records=records, topics=(1, 3), starts=[(5, 0xDC01)]))
    (tmp_path / "bad.boo").write_bytes(b"\0" * paged.PAGE)
    (tmp_path / "short.boo").write_bytes(b"\0")
    df = paged.books(spark, str(tmp_path))
    p = {r.book_id: r for r in paged.prologue(df).collect()}
    assert p["one.BOO"].error is None and p["one.BOO"].record_count == 3 and p["bad.boo"].error and p["short.boo"].error
    assert paged.pages(df).where("book_id = 'one.BOO'").count() == 5
    recs = paged.records(df)
    got = [(r.record, r.text) for r in recs.where("error is null").orderBy("record").collect()]
    assert got == [(1, "CTITLE=My book"), (2, "BOOK"), (3, "BOOK CTITLE=My")]
    assert recs.where("error is not null").count() == 2
    assert {(r.record, r.key, r.value) for r in paged.record_controls(recs).collect()} == {(1, "CTITLE", "My book"), (3, "CTITLE", "My")}
    assert [(r.start, r.end) for r in paged.topic_records(df).where("error is null").orderBy("topic_no").collect()] == [(1, 3), (3, 4)]
    assert {r.token_key for r in paged.dictionary(df).where("error is null").collect()} == {0xDC00, 0xDC01}
    assert paged.page_runs(df).where("book_id = 'one.BOO'").count() == 4


def test_lines_tile_or_not():
    b = paged.Book(book(records=[b"\x02\x01\x01\x01\x02", b"\x05\x01", b"\xdc\x01"]))
    spans = {n: (lo, hi) for n, lo, hi in b.records()}
    assert len(b.lines(*spans[1])) == 2 and b.lines(*spans[2]) is None and b.lines(*spans[3]) is None


def test_projection():
    assert text(bytes([0xC1, 0x41, 0xB4, 0xFF])) == "A c?" 
