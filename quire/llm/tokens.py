"""Token ids in a binary format: one zstandard frame a document, a trailing seek table, a checksum a frame.

A file is a series of zstandard frames, each with its own content checksum and
each holding the ids of one document as little-endian unsigned integers; then a
skippable frame with the document ids; then the seek table of the public zstandard
seekable format (compressed size, content size and checksum of every frame, and a
footer), itself a skippable frame.  Any zstandard tool can decompress a file; a
reader that wants some documents reads the seek table from the end, and reads and
decompresses these documents' frames only.

Files are written by a Python data source: tasks write under names of their own,
and the commit on the driver lists the files of the tasks that count in a
manifest, so that a lost executor or a repeated task leaves no trace in what is read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from quire.llm._batches import RESIDENT, map_chunks, texts
from quire.llm.pieces import PieceCache
from quire.llm.store import opened

SKIPPABLE, SEEK_TABLE, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
MANIFEST = "_manifest.json"
#: Space that ends a piece for the tokenizer's pattern; the characters 1C to 1F are none.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: A comma or full stop that is one piece with the sign before it.
_SIGNED = regex.compile(r"(\p{L}+)([^\s\p{L}\p{N}]+)")
_JOINED = re.compile(r"[.,](?<=(?:[^\w\s]|_).)\s")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: its own, or the next one from U+0100 on."""
    out, spare = [], 0x100
    for b in range(256):
        printable = 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)
        out.append(chr(b) if printable else chr(spare))
        spare += not printable
    return out


#: The normalizer, pieces and word ends of the tokenizer file that encoding by words is for.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_MODEL = {"type": "BPE", "dropout": None, "end_of_word_suffix": "</w>", "ignore_merges": False}


def by_words(blob: bytes) -> bool:
    """Whether a tokenizer file has the normalizer and pieces that make a text's ids those of its words."""
    held = json.loads(blob)
    normalizer, pieces, model = (held.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = pieces.get("pretokenizers", [])
    return (
        normalizer.get("normalizers") == _NORMALIZER
        and len(steps) == 2
        and steps[0] == _SPLIT
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("add_prefix_space")
        and not steps[1].get("use_regex")
        and {k: model.get(k) for k in _MODEL} == _MODEL
        and not held.get("truncation")
        and all(x["content"].startswith("<|") and not x["lstrip"] and not x["rstrip"] for x in held.get("added_tokens", []))
    )


class Encoder:
    """A tokenizer of the tokenizers library over whole texts.

    A file that `by_words` knows drops white space, so a text's ids are those of its
    words, one after another, which are cached.  With any other file the library
    encodes each whole text.
    """

    def __init__(self, blob: bytes, cached: int = 250_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob.decode("utf-8"))
        self.known = by_words(blob)
        if not self.known:
            return
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        self.cache = PieceCache(self._word, cached)
        self.tails = PieceCache(self._one, 1_000)

    def _word(self, word: str) -> bytes:
        """Letters, and signs behind them, are pieces of their own, and case is dropped."""
        core, tail = word, ""
        if not word.isalpha():
            found = _SIGNED.fullmatch(word)
            if found is None:
                return self._one(word)
            core, tail = found.groups()
        if not word.isascii() and (not unicodedata.is_normalized("NFC", word) or "\u0130" in core or "\u03a3" in core):
            return self._one(word)  # form or case may set marks free, or hang on the place
        ids = self._letters(core.lower())
        return ids + self.tails[tail] if tail else ids

    def _letters(self, core: str) -> bytes:
        """A piece of lower-case letters: its bytes, as the byte-level alphabet writes them, go straight to the merges."""
        if not core.isascii():
            core = "".join([self.alphabet[b] for b in core.encode("utf-8")])
        return array("I", [t.id for t in self.model.tokenize(core)]).tobytes()

    def _one(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _split(self, text: str) -> list[str]:
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [w for w in _SPACE.split(text) if w]
        plain = text.isascii()
        if plain and "<|" not in text:  # nor a special token, whose case counts
            text = text.lower()
        if not _JOINED.search(text) and (plain or "\u0130" not in text and unicodedata.is_normalized("NFC", text)):
            text = text.replace(", ", " , ").replace(". ", " . ")
        return text.split()

    def encode(self, text: str, end: bytes) -> bytes:
        if not self.known:
            return self._one(text) + end
        cache = self.cache
        return b"".join([cache[w] for w in self._split(text)]) + end


@lru_cache(maxsize=1)
def encoder(blob: bytes) -> Encoder:
    """One encoder a Python worker: its caches serve all tasks that the worker runs."""
    return Encoder(blob)


RESIDENT["tokens"] = encoder.cache_clear


def encode_documents(docs: DataFrame, tokenizer: bytes, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, the end id last) of each whole text; a null text has the end id only."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer)
    end = struct.pack("<I", end_id)

    def make():
        own = encoder(held.value)
        return lambda ids, blobs: {"doc_id": ids, "ids": [own.encode(b.decode("utf-8", "replace"), end) for b in blobs]}

    return map_chunks(texts(docs, id_col, text_col), "doc_id long, ids binary", make, owner="tokens")


@dataclass
class Wrote(WriterCommitMessage):
    file: str
    order: int
    docs: int
    tokens: int


class FrameWriter:
    """One file of frames."""

    def __init__(self, sink, width: int) -> None:
        self.sink, self.width, self.table, self.ids, self.tokens = sink, width, [], [], 0
        self.press = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        values = np.frombuffer(ids, "<u4")
        if self.width < 4 and len(values) and values.max() >= 1 << (8 * self.width):
            raise ValueError(f"an id does not fit into {self.width} bytes")
        body = values.astype(f"<u{self.width}").tobytes()
        frame = self.press.compress(body)
        self.sink.write(frame)
        self.table.append((len(frame), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.tokens += len(values)

    def close(self) -> None:
        known = np.array([x is not None for x in self.ids], bool)
        body = zlib.compress(struct.pack("<BI", self.width, len(self.ids)) + np.packbits(known).tobytes() + np.array([x or 0 for x in self.ids], "<i8").tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.table.append((len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        rows = np.array(self.table, "<u4").tobytes()
        self.sink.write(struct.pack("<II", SEEK_TABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), 0x80, SEEK_FOOTER))
        self.sink.close()


class FrameReader:
    """One file of frames: its seek table and document ids; frames are decompressed when asked for."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_FOOTER or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        source.seek(int(self.at[n - 1]) + 8)
        body = zlib.decompress(source.read(int(self.table[n - 1, 0]) - 8))
        self.width, n = struct.unpack_from("<BI", body)
        bits = (n + 7) // 8
        self.known = np.unpackbits(np.frombuffer(body, np.uint8, bits, 5), count=n).astype(bool)
        self.ids = np.frombuffer(body, "<i8", n, 5 + bits)
        self.counts = self.table[:n, 1].astype(np.int64) // self.width
        self.press = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        """The ids of document k as little-endian unsigned 32-bit integers."""
        self.source.seek(int(self.at[k]))
        body = self.press.decompress(self.source.read(int(self.table[k, 0])))
        if len(body) != self.table[k, 1] or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(body, f"<u{self.width}").astype("<u4").tobytes()


@dataclass
class FilePart(InputPartition):
    file: str
    base: int


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.width = options["path"].rstrip("/"), int(options.get("width", 4))
        files, path = opened(self.path)
        if files.get_file_info(f"{path}/{MANIFEST}").size is not None:
            raise ValueError(f"{self.path} holds token files already")
        files.create_dir(path, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        files, path = opened(self.path)
        context = TaskContext.get()
        order = context.partitionId() if context else 0
        name = f"part-{order:06d}-{uuid.uuid4().hex[:12]}.tok.zst"
        out = None
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                out = out or FrameWriter(files.open_output_stream(f"{path}/{name}", compression=None), self.width)
                out.add(doc_id, ids)
        if out is None:
            return Wrote("", order, 0, 0)
        out.close()
        return Wrote(name, order, len(out.ids), out.tokens)

    def commit(self, messages: list) -> None:
        files, path = opened(self.path)
        parts = sorted((m for m in messages if m is not None and m.docs), key=lambda m: m.order)
        with files.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps([[m.file, m.docs, m.tokens] for m in parts]).encode())

    def abort(self, messages: list) -> None:
        files, path = opened(self.path)
        for m in messages:
            if m is not None and m.file:
                files.delete_file(f"{path}/{m.file}")


class TokenReader(DataSourceReader):
    """Rows doc_id, start (ids of all documents before), n_tokens, ids; the option doc_ids chooses the frames."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.wanted = set(json.loads(options["doc_ids"])) if "doc_ids" in options else None

    def partitions(self) -> list[FilePart]:
        files, path = opened(self.path)
        with files.open_input_stream(f"{path}/{MANIFEST}") as f:
            parts = json.loads(f.read())
        out, base = [], 0
        for file, _, tokens in parts:
            out.append(FilePart(file, base))
            base += tokens
        return out

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if part is None or not getattr(part, "file", None):
            return
        files, path = opened(self.path)
        name = f"{path}/{part.file}"
        with files.open_input_file(name) as source:
            reader = FrameReader(source, files.get_file_info(name).size)
            starts = part.base + np.concatenate([[0], np.cumsum(reader.counts)])
            keep = np.arange(len(reader.ids)) if self.wanted is None else np.nonzero(reader.known & np.isin(reader.ids, list(self.wanted)))[0]
            for i in range(0, len(keep), 256):
                k = keep[i : i + 256]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(reader.ids[k], pa.int64(), mask=~reader.known[k]),
                        "start": pa.array(starts[k], pa.int64()),
                        "n_tokens": pa.array(reader.counts[k], pa.int64()),
                        "ids": pa.array([reader.frame(int(j)) for j in k], pa.binary()),
                    }
                )


class TokenSource(DataSource):
    """format("quire_tokens"): options path; to read, doc_ids (a JSON list); to write, width (bytes an id, 2 or 4)."""

    @classmethod
    def name(cls) -> str:
        return "quire_tokens"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options, overwrite)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents in token files; of `doc_ids` only these frames are read and decompressed.

    The ids are an option, not a pushed filter: Spark 4.1 keeps a Python source's
    pushed filters with the frame, so that a later scan of it without them, or with
    others, would lack rows.
    """
    spark.dataSource.register(TokenSource)
    read = spark.read.format("quire_tokens")
    return (read if doc_ids is None else read.option("doc_ids", json.dumps(sorted(doc_ids)))).load(path)


def write_tokens(docs: DataFrame, tokenizer: bytes, path: str, end_id: int = 2, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the ids in ascending document order.

    Texts are dealt by ranges of doc_id (null first) and sorted in each range, so
    that the files follow one another; rows with the same doc_id meet in one file,
    ordered by text.  The token count before each file is in the manifest, of one
    short line a file.  An empty table writes an empty manifest.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenSource)
    read = texts(docs, id_col, text_col)
    dealt = read.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encode_documents(dealt, tokenizer, end_id).write.format("quire_tokens").option("width", width).mode("append").save(path)


def positions(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what `read_tokens` gives."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
