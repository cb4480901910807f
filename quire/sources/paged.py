"""Paged binary books as relations: prologue, pages, dictionary, records, controls, topics, resources.

A book is read by Spark's binaryFile source, so any store that Spark reads will do.
Fields at fixed places are Column expressions; what has to be walked byte by byte
is decoded in Arrow batches, one book at a time and no further than it is asked.
Books that cannot be decoded give rows with an error and fail nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions.text import be_int
from quire.operators import intervals
from quire.sources.codepages import TABLES, dictionary_page, text

PAGE = 4096

# Name, offset in the directory page and size of its big-endian fields.
DIRECTORY = (
    ("token_threshold", 0x14, 1), ("token_prefix", 0x15, 1), ("last_logical_page", 0x16, 2), ("token_map_offset", 0x22, 2),
    ("dictionary_start", 0x28, 2), ("dictionary_pages", 0x2E, 2), ("content_index_offset", 0x34, 2), ("record_count", 0x36, 2),
    ("content_pages", 0x38, 2), ("content_start", 0x3A, 2), ("topic_table_offset", 0x3C, 2), ("topic_count", 0x3E, 2),
    ("stem_table_offset", 0x40, 2), ("dictionary_parameter", 0x4C, 2),
)
# The controls whose values a record may carry, in the order in which they are told.
CONTROLS = ("CTITLE", "CSTITLE", "CDOCNUM", "CAUTHOR", "CDATE", "CCOPYRIGHT", "CREFLOW", "CVERSION", "CBUILD", "CLANGUAGE", "CSECURITY")


def books(spark: SparkSession, path: str, suffix: str = ".boo", recursive: bool = False) -> DataFrame:
    """(book_id, content) of a folder's books; the suffix counts in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.endswith(F.lower(name), F.lit(suffix)) & ~F.startswith(name, F.lit("."))).select(name.alias("book_id"), "content")


def prologue(df: DataFrame) -> DataFrame:
    """(book_id, n_pages, directory_page, directory fields..., error): only fixed slices of the content are looked at."""
    n = F.floor(F.length("content") / PAGE)
    d = be_int("content", 0, 2)
    at = lambda off: d * PAGE + off
    out = df.select("book_id", n.alias("n_pages"), d.alias("directory_page"), *(be_int("content", at(o), s).alias(c) for c, o, s in DIRECTORY))
    last = F.col("directory_page") + F.col("last_logical_page") - 1
    error = (
        F.when(F.coalesce("directory_page", F.lit(0)) == 0, "directory page 0")
        .when(F.col("directory_page") >= F.col("n_pages"), "directory outside the file")
        .when(last >= F.col("n_pages"), "last page outside the file")
    )
    return out.withColumn("error", error)


def pages(df: DataFrame) -> DataFrame:
    """(book_id, page_no, page_class, used, body): a row for each whole page."""
    n = F.floor(F.length("content") / PAGE).cast("int")
    each = df.where(n > 0).select("book_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("page_no"), "content")
    body = F.substring("content", F.col("page_no") * PAGE + 1, PAGE)
    own = each.select("book_id", "page_no", body.alias("body"))
    return own.select("book_id", "page_no", be_int("body", 0, 2).alias("page_class"), be_int("body", 2, 2).alias("used"), "body")


def page_runs(df: DataFrame) -> DataFrame:
    """(book_id, run, page_class, first, last, n): runs of pages of one class."""
    return intervals.page_runs(pages(df).drop("body"))


def _u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "big")


def compact(b: bytes, at: int, end: int) -> tuple[int, int] | None:
    """(length, place behind it): one byte up to EF, else two."""
    if at >= end:
        return None
    if b[at] <= 0xEF:
        return b[at], at + 1
    return ((b[at] - 0xF0 << 8) + b[at + 1], at + 2) if at + 1 < end else None


def blocks(b: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive blocks, each behind its compact length; ends at the first that is empty or too long."""
    while (head := compact(b, at, end)) and head[0] and head[1] + head[0] <= end:
        yield head[1], head[1] + head[0]
        at = head[1] + head[0]


class Book:
    """One book's bytes and directory."""

    def __init__(self, raw: bytes) -> None:
        self.raw, n = raw, len(raw) // PAGE
        self.page = _u16(raw, 0) if len(raw) >= 2 else 0
        if not 0 < self.page < n:
            raise ValueError("directory page 0" if not self.page else "directory outside the file")
        self.base = self.page * PAGE
        self.d = {c: int.from_bytes(raw[self.base + o : self.base + o + s], "big") for c, o, s in DIRECTORY}
        if self.page + self.d["last_logical_page"] - 1 >= n:
            raise ValueError("last page outside the file")
        self.version = text(raw[self.base + 0x10 : self.base + 0x14])
        self.header = text(raw[0x0C : 0x0C + 128]).rstrip(" ")

    def physical(self, logical: int) -> int:
        if not logical:
            raise ValueError("logical page 0")
        return self.page + logical - 1

    def paged_index(self, root: int, expected: int, terminal: bool) -> list[int]:
        """A chained table of 16-bit values; empty on a cycle, an overrun or too few values."""
        out, seen, at, raw = [], set(), root, self.raw
        while at + 4 <= len(raw) and at not in seen:
            seen.add(at)
            n, following = _u16(raw, at), _u16(raw, at + 2)
            if len(out) + n > expected or at + 4 + 2 * n > len(raw):
                break
            out += [_u16(raw, at + 4 + 2 * k) for k in range(n)]
            if len(out) == expected:
                end = at + 4 + 2 * n
                if not terminal:
                    return out
                return [*out, _u16(raw, end)] if end + 2 <= len(raw) else []
            if not following:
                break
            at = self.physical(following) * PAGE
        return []

    def content_starts(self) -> list[int]:
        out = self.paged_index(self.base + self.d["content_index_offset"], self.d["content_pages"], True)
        return [*out[:-1], out[-1] + 1] if out else []

    def topic_starts(self) -> list[int]:
        out = self.paged_index(self.base + self.d["topic_table_offset"], self.d["topic_count"], False)
        return [*out, self.d["record_count"] + 1] if out else []

    def dictionary(self) -> dict[int, list[int]]:
        """Token keys and the code units that they stand for."""
        table = TABLES[dictionary_page(self.version, self.d["dictionary_parameter"])]
        out: dict[int, list[int]] = {}
        first = self.physical(self.d["dictionary_start"]) if self.d["dictionary_pages"] else 0
        for p in range(first, first + self.d["dictionary_pages"]):
            at = p * PAGE
            if at + PAGE > len(self.raw) or _u16(self.raw, at) != 0x0100:
                continue
            for lo, hi in blocks(self.raw, at + 4, at + min(_u16(self.raw, at + 2), PAGE)):
                if lo + 3 <= hi:
                    for begin, end in blocks(self.raw, lo + 3 + self.raw[lo + 2], hi):
                        if begin + 2 < end:
                            out |= deltas(self.raw[begin + 2 : end], _u16(self.raw, begin), table)
        return out

    def records(self) -> Iterator[tuple[int, int, int]]:
        """(record from 1, payload begin, payload end) of each record of the content pages."""
        n, start = 0, self.d["content_start"]
        for p in range(self.physical(start), self.physical(start) + self.d["content_pages"]) if start else ():
            at = p * PAGE
            if at + PAGE <= len(self.raw) and _u16(self.raw, at) in (0, 1):
                for lo, hi in blocks(self.raw, at + 4, at + min(_u16(self.raw, at + 2), PAGE)):
                    n += 1
                    yield n, lo, hi

    def tokens(self, lo: int, hi: int, dictionary: dict[int, list[int]]) -> list[tuple[int, int, list[int]]]:
        """(value, bytes, words) of each token of a payload; a key that the dictionary lacks has no words."""
        out, at, threshold, table = [], lo, self.d["token_threshold"], self.base + self.d["token_map_offset"]
        while at < hi:
            wide = self.raw[at] >= threshold and at + 1 < hi
            value = _u16(self.raw, at) if wide else self.raw[at]
            key = value if wide else _u16(self.raw, table + 2 * value)
            out.append((value, 2 if wide else 1, dictionary.get(key, [])))
            at += 2 if wide else 1
        return out

    def lines(self, lo: int, hi: int) -> list[tuple[int, int]] | None:
        """The display lines that tile a payload, each behind its length; None if they do not, or a length could be a wide token."""
        out, at = [], lo
        while at < hi:
            n = self.raw[at]
            if n >= self.d["token_threshold"] or at + 1 + n > hi:
                return None
            out.append((at + 1, at + 1 + n))
            at += 1 + n
        return out

    def resources(self) -> Iterator[tuple[str, str, int, int]]:
        """(resource_id, layout, offset, size) of the stored media; entries that reach outside are left out."""
        raw, n = self.raw, int.from_bytes(self.raw[4:8], "big")
        layout = {(1, 0): "converted", (1, 3): "v13"}.get((raw[self.base + 9], raw[self.base + 10]), "v12")
        begin = 0x118 + (0 if layout == "v12" else 16 * n)
        if not n or begin + 16 * n > self.base or (layout == "converted" and 0x118 + 48 * n > len(raw)):
            return
        for k in range(n):
            e = raw[begin + 16 * k : begin + 16 * k + 16]
            name = text(e[:8]).strip()
            offset = int.from_bytes(e[12:16], "big")
            if layout == "converted":
                other = 0x118 + 32 * n + 16 * k
                name, size = name or text(raw[other : other + 8]).strip(), int.from_bytes(e[8:12], "big")
            else:
                size = int.from_bytes(e[9:12], "big")
            if name and size and offset + size <= (len(raw) if layout == "converted" else self.base):
                yield name, layout, offset, size


def _upper(w: int) -> int:
    return 0x53 if w == 0xDF else w - 0x20 if 0x61 <= w <= 0x7A or (0xE0 <= w <= 0xFE and w != 0xF7) else w


def _lower(w: int) -> int:
    return w + 0x20 if 0x41 <= w <= 0x5A or (0xC0 <= w <= 0xDE and w != 0xD7) else w


def deltas(part: bytes, key: int, table: list[int]) -> dict[int, list[int]]:
    """Consecutive keys: a first word, then for each the changes that make it of the one before."""
    n = part[0]
    if 1 + n > len(part):
        return {}
    word, at = [table[b] for b in part[1 : 1 + n]], 1 + n
    out = {key: word}
    while at < len(part):
        mode, n = divmod(part[at], 64)
        at += 1
        keep = len(word)
        if mode == 1:
            if at >= len(part):
                break
            keep, n = n, part[at] & 0x3F
            at += 1
        if at + n > len(part):
            break
        arg, at = part[at : at + n], at + n
        if mode in (0, 2):
            whole, single = (_upper, _lower) if mode == 0 else (_lower, _upper)
            places = set(arg)
            word = [single(whole(w)) if k in places else whole(w) for k, w in enumerate(word)]
        else:
            word = [*map(_lower, word[:keep]), *(table[b] for b in arg)]
        key = key + 1 & 0xFFFF
        out[key] = word
    return out


def assemble(tokens: list[list[int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """The words of a record and each token's range in them.

    A token's first word below 4 controls its spacing: 0 and 1 take back a space
    before it, 2 wants none after it, 3 and no control want one.  The opcode at a
    record's start is in upper case.
    """
    words: list[int] = []
    spans: list[list[int]] = []
    spacing = 2
    for token in tokens:
        body = token
        spacing = token[0] if token else 3
        if token and token[0] < 4:
            body = token[1:]
            if words and spacing in (0, 1):
                if words[-1] == 0x20:
                    words.pop()
                    for s in reversed(spans):  # the token that the space was of ends before it
                        if s[1] > len(words):
                            s[1] = len(words)
                            break
                if spacing == 0 or not body:
                    spacing = 2
        begin = len(words)
        words += body
        if body and body[-1] == 0x20:
            spacing = 2
        if spacing != 2:
            words.append(0x20)
        spans.append([begin, len(words)])
    if len(words) > 1 and spacing != 2:
        words.pop()
        spans[-1][1] = len(words)
    if words and words[0] not in (0x20, 0x53):
        for k, w in enumerate(words):
            if w in (0x20, 0x3D, 0):
                break
            words[k] = _upper(w) if w < 0x80 else w
    return words, [tuple(s) for s in spans]


def spelled(words: list[int]) -> str:
    return "".join(chr(w) if w <= 0x7E else " " if w == 0xA0 else chr(w) if 0xA1 <= w <= 0xFF else "?" for w in words)


def controls(record: str) -> list[tuple[str, str]]:
    """(key, value) of the known controls of a record's text: the first of each key, up to the next control."""
    import re

    opens = [(m.start(), m.end(), m[1].upper()) for m in re.finditer(r"(?:(?<=\s)|^)(c[a-z]+)=", record, re.IGNORECASE)]
    found: dict[str, str] = {}
    for k, (_, end, key) in enumerate(opens):
        if key in CONTROLS and key not in found:
            found[key] = record[end : opens[k + 1][0] if k + 1 < len(opens) else len(record)].strip()
    return [(k, found[k]) for k in CONTROLS if k in found]


def _decoded(df: DataFrame, schema: str, rows) -> DataFrame:
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, raw = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""
                try:
                    out = list(rows(Book(raw)))
                    error = None
                except (ValueError, IndexError) as e:
                    out, error = [()], str(e)
                full = [(name, *r, *[None] * (len(arrow) - 2 - len(r)), error) for r in out]
                for i in range(0, len(full), 5000):
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in full[i : i + 5000]], schema=arrow)

    return df.select("book_id", "content").mapInArrow(run, struct)


def dictionary(df: DataFrame) -> DataFrame:
    """(book_id, token_key, words, error)."""
    return _decoded(df, "book_id string, token_key int, words array<int>, error string", lambda b: b.dictionary().items())


def records(df: DataFrame) -> DataFrame:
    """(book_id, record, payload_begin, payload_end, n_lines, tokens, text, error); n_lines is null where lines do not tile."""

    def rows(b: Book):
        known = b.dictionary()
        for n, lo, hi in b.records():
            lines = b.lines(lo, hi)
            parts = lines if lines is not None else [(lo, hi)]
            tokens = [t for x, y in parts for t in b.tokens(x, y, known)]
            words, _ = assemble([t[2] for t in tokens])
            yield n, lo, hi, None if lines is None else len(lines), [dict(value=v, width=w, words=x) for v, w, x in tokens], spelled(words)

    return _decoded(df, "book_id string, record int, payload_begin long, payload_end long, n_lines int, tokens array<struct<value:int,width:int,words:array<int>>>, text string, error string", rows)


def topic_records(df: DataFrame) -> DataFrame:
    """(book_id, topic_no, start, end, error): half-open ranges of records, from the book's own table."""
    return _decoded(df, "book_id string, topic_no int, start int, end int, error string", lambda b: [(k, x, y) for k, (x, y) in enumerate(zip(b.topic_starts(), b.topic_starts()[1:], strict=False), 1)])


def resources(df: DataFrame) -> DataFrame:
    """(book_id, resource_id, layout, offset, size, error)."""
    return _decoded(df, "book_id string, resource_id string, layout string, offset long, size long, error string", Book.resources)


def record_controls(recs: DataFrame) -> DataFrame:
    """(book_id, record, key, value) of decoded records."""
    found = F.udf(lambda t: controls(t or ""), "array<struct<key:string,value:string>>", useArrow=True)
    return recs.select("book_id", "record", F.inline(found("text")))
