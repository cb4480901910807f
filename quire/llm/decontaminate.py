"""Benchmark decontamination with training suffix arrays.

Each chunk of training documents is a shard.  Its words become numbers (a word
that no benchmark item holds becomes 0, which also ends each document), and the
shard's suffix array lists, in order, the suffixes that can match: those whose
first words begin some test suffix.  Every test suffix is then binary-searched
in every shard (equal windows once): the run of training suffixes that share its
first `window` words are places of verbatim matches, each of which is followed,
from where it begins, as far as it goes.  These longest matches are what a document
is removed for: their words are hit, their items found, and the longest is reported.

The benchmark is broadcast in blocks of bounded bytes; a benchmark of any size
works, with one pass over the documents for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._batches import kept_rows, map_chunks, settle, texts

#: UTF-8 form of the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased: other bytes become spaces.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Bytes of benchmark text broadcast at once.
BLOCK_BYTES = 8 << 20
#: A longest match is followed for so many words past the window at a time.
STRIDE = 64
#: Places whose matches are followed at once; bounds memory.
AT_ONCE = 1 << 14


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Benchmark:
    """The test suffixes of one block of items."""

    def __init__(self, rows: list[tuple], window: int) -> None:
        self.window, self.ids = window, [r[0] for r in rows]
        self.number: dict[bytes, int] = {}
        self.items = [
            np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(r[1])], np.int64) for r in rows
        ]
        short = [len(x) for x in self.items if 0 < len(x) < window]
        self.depth = min([window, 3, *short])  # words of a test suffix that a training suffix must begin with
        by_length: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for k, x in enumerate(self.items):
            n = min(window, len(x))
            for i in range(len(x) - n + 1) if n else ():
                by_length.setdefault(n, {}).setdefault(x[i : i + n].astype(">u4").tobytes(), []).append((k, i))
        #: Words in a window, the different windows, and the test suffixes (item, position) that begin with each.
        self.windows = [(n, np.array(list(found), f"S{4 * n}"), list(found.values())) for n, found in sorted(by_length.items())]
        starts = [w.view("S1").reshape(len(w), -1)[:, : 4 * self.depth] for _, w, _ in self.windows]
        heads = np.concatenate([np.ascontiguousarray(s).view(f"S{4 * self.depth}").ravel() for s in starts]) if starts else np.array([], "S4")
        self.heads = np.unique(self._code([np.frombuffer(heads.tobytes(), ">u4").reshape(-1, self.depth)[:, d] for d in range(self.depth)])) if len(heads) else np.array([], np.uint64)

    @staticmethod
    def _code(columns: list[np.ndarray]) -> np.ndarray:
        """One number for a few words; two heads may share one, which only costs time."""
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = out * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64)
        return out


class Shard:
    """The suffix array of one chunk of documents, over the suffixes that can match."""

    def __init__(self, blobs: list[bytes], bench: Benchmark) -> None:
        self.bench, get = bench, bench.number.get
        counts, parts = [], []
        for blob in blobs:
            found = words(blob)
            counts.append(len(found))
            parts.append(np.fromiter((get(w, 0) for w in found), np.uint32, len(found)))
            parts.append(np.zeros(1, np.uint32))
        width = max(bench.window, bench.depth)
        self.counts = np.array(counts, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts + 1)])[: len(blobs)]
        self.words = np.concatenate([*parts, np.zeros(width, np.uint32)])
        n = len(self.words) - width
        at = np.nonzero(self.words[:n])[0]
        for d in range(1, bench.depth):
            at = at[self.words[at + d] != 0]
        if len(at):
            at = at[np.isin(Benchmark._code([self.words[at + d] for d in range(bench.depth)]), bench.heads)]
        keys = self.words[at[:, None] + np.arange(bench.window)[None, :]].astype(">u4")
        keys = np.ascontiguousarray(keys).view(f"S{4 * bench.window}").ravel()
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = at[order], keys[order]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def occurrences(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """(words in the window, low, high, test suffixes of each window): each window's run in the suffix array."""
        for n, windows, suffixes in self.bench.windows:
            low = np.searchsorted(self.keys, windows, side="left")
            top = np.frombuffer(
                b"".join(w.ljust(4 * n, b"\0") + b"\xff" * (4 * (self.bench.window - n)) for w in windows.tolist()),
                f"S{4 * self.bench.window}",
            )
            high = np.searchsorted(self.keys, top, side="right")
            yield n, low, high, suffixes

    def matches(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, places, words): the verbatim matches of a window or more that cannot be made longer at either end."""
        for n, low, high, suffixes in self.occurrences():
            for w in np.nonzero(high > low)[0].tolist():
                places = self.suffixes[low[w] : high[w]]
                before = np.where(places > 0, self.words[places - 1], 0)
                for k, i in suffixes[w]:
                    item = self.bench.items[k]
                    # A match that the words before prolong was followed from there.
                    begins = places if i == 0 else places[before != item[i - 1]]
                    for lo in range(0, len(begins), AT_ONCE):
                        at = begins[lo : lo + AT_ONCE]
                        yield k, at, self._length(item[i:], at, n)

    def _length(self, item: np.ndarray, at: np.ndarray, known: int) -> np.ndarray:
        """How many words of `item` stand at each place, of which the first are known."""
        size = np.full(len(at), known, np.int64)
        going, end = np.arange(len(at)), len(self.words) - 1
        while len(going) and known < len(item):
            step = min(STRIDE, len(item) - known)
            took = self.words[np.minimum(at[going, None] + known + np.arange(step)[None, :], end)]
            same = np.cumprod(took == item[None, known : known + step], axis=1).sum(1)
            size[going] += same
            going, known = going[same == step], known + step
        return size

    def longest(self) -> Iterator[tuple[int, int, int, int]]:
        """(item, position, words, place) of each test suffix's longest verbatim match of a window or more."""
        for k, item in enumerate(self.bench.items):
            n = min(self.bench.window, len(item))
            for i in range(len(item) - n + 1) if n else ():
                key = item[i : i + n].astype(">u4").tobytes()
                lo = np.searchsorted(self.keys, np.array(key, self.keys.dtype), side="left")
                hi = np.searchsorted(self.keys, np.array(key + b"\xff" * (4 * (self.bench.window - n)), self.keys.dtype), side="right")
                places, size, m = self.suffixes[lo:hi], n, len(item) - i
                while len(places) and size < m:
                    step = min(STRIDE, m - size)
                    end = len(self.words)
                    took = self.words[np.minimum(places[:, None] + size + np.arange(step)[None, :], end - 1)]
                    same = np.cumprod(took == item[i + size : i + size + step][None, :], axis=1).sum(1)
                    best = same.max()
                    places, size = places[same == best], size + int(best)
                    if best < step:
                        break
                if len(places):
                    yield k, i, size, int(places.min())


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """Items in blocks of at most `limit` bytes (or one item), read one partition at a time."""
    held, size = [], 0
    for row in texts(benchmark, id_col, text_col).distinct().orderBy("doc_id", "text").toLocalIterator():
        if held and size + len(row[1]) > limit:
            yield held
            held, size = [], 0
        held.append((row[0], bytes(row[1])))
        size += len(row[1])
    yield held


def _id_of(benchmark: DataFrame) -> str:
    if "item_id" not in benchmark.columns:
        raise ValueError("a benchmark needs the column item_id")
    return "item_id"


def _hits(docs: DataFrame, rows: list[tuple], window: int) -> DataFrame:
    """doc_id, n_words, hit (word ranges [begin, end) as a flat array), items, best (the longest match: minus its words, its place, its item): of one block."""
    held = docs.sparkSession.sparkContext.broadcast((rows, window))

    def make():
        bench = Benchmark(*held.value)

        def step(ids, blobs):
            shard = Shard(blobs, bench)
            edge = np.zeros(len(shard.words) + 1, np.int64)
            found = [(k, at, size) for k, at, size in shard.matches()]
            which = np.concatenate([np.full(len(at), k) for k, at, _ in found]) if found else np.array([], np.int64)
            at, size = (np.concatenate([x[c] for x in found]) if found else np.array([], np.int64) for c in (1, 2))
            np.add.at(edge, at, 1)
            np.subtract.at(edge, at + size, 1)
            hit = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]]))
            begins, ends = np.nonzero(hit == 1)[0], np.nonzero(hit == -1)[0]
            out = {"doc_id": ids, "n_words": shard.counts, "hit": [[] for _ in ids], "items": [[] for _ in ids], "best": [None] * len(ids)}
            out["text_key"] = [hashlib.blake2b(t, digest_size=16).digest() for t in blobs]
            for d, b, e in zip(shard.doc_of(begins).tolist(), begins.tolist(), ends.tolist(), strict=True):
                s = int(shard.starts[d])
                out["hit"][d] += [b - s, e - s]
            if len(at):
                owner = shard.doc_of(at)
                pairs, longest = np.unique(np.stack([owner, which]), axis=1), np.lexsort((at, -size, owner))
                for d, k in pairs.T.tolist():
                    out["items"][d].append(bench.ids[k])
                firsts = longest[np.unique(owner[longest], return_index=True)[1]]
                for d, p, n in zip(owner[firsts].tolist(), at[firsts].tolist(), size[firsts].tolist(), strict=True):
                    same = which[(at == p) & (size == n)]
                    named = [x for x in (bench.ids[k] for k in same.tolist()) if x is not None]
                    out["best"][d] = {"less": -n, "at": p - int(shard.starts[d]), "item": min(named, default=None)}
            return out

        return step

    return map_chunks(docs, "doc_id long, n_words long, hit array<int>, items array<long>, best struct<less:int,at:int,item:long>, text_key binary", make)


def _merge(arrays: list[list[int]]) -> int:
    """Words covered by any of some ranges."""
    spans = sorted(zip(arrays[::2], arrays[1::2], strict=True))
    total, end = 0, 0
    for b, e in spans:
        total += max(0, e - max(b, end))
        end = max(end, e)
    return total


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 8,
    least_items: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at, longest_item.

    A window is `window` consecutive words of an item, or all words of a shorter
    one.  n_hit: document words inside an occurrence of any window; n_items: items
    with such an occurrence; contaminated: `least_items` of them or more; longest:
    words of the longest verbatim match of a window or more (0 without any), the
    place of its first word (from 0; of several, the first) and its item (the least).

    A null or empty text, or one without words, has n_words 0 and no items; an
    item without words matches nothing; item rows that repeat count once; items
    with a null id match as any, count as one in n_items, and are left out of
    items_sha256, having no name to report.  An empty benchmark leaves every
    document clean.  Document rows that repeat are each reported.
    Nothing is shuffled unless the benchmark needs more than one block.
    """
    read = texts(docs, id_col, text_col)
    blocks = [_hits(read, rows, window) for rows in _blocks(benchmark, _id_of(benchmark), "text", block_bytes)]
    if len(blocks) == 1:
        return _report(blocks[0].drop("text_key"), least_items)
    whole = blocks[0].withColumn("block", F.lit(0))
    for k, b in enumerate(blocks[1:], 1):
        whole = whole.unionByName(b.withColumn("block", F.lit(k)))
    merged = (
        whole.groupBy("doc_id", "text_key")  # rows that repeat are alike: they meet here and are dealt out again
        .agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_set("hit")).alias("hit"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
            F.min("best").alias("best"),
            F.sum(F.when(F.col("block") == 0, 1).otherwise(0)).alias("copies"),
        )
        .select("doc_id", "n_words", "hit", "items", "best", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .drop("col")
    )
    return _report(merged, least_items)


def _report(hits: DataFrame, least_items: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        settle(None)
        for b in batches:
            ids, n, hit, items, best = (b.column(k).to_pylist() for k in range(5))
            items = [set(x) for x in items]
            names = [sorted(str(k) for k in x if k is not None) for x in items]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "n_words": pa.array(n, pa.int64()),
                    "n_hit": pa.array(map(_merge, hit), pa.int64()),
                    "n_items": pa.array(map(len, items), pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                    "contaminated": pa.array([len(x) >= least_items for x in items], pa.bool_()),
                    "longest": pa.array([-x["less"] if x else 0 for x in best], pa.int32()),
                    "longest_at": pa.array([x and x["at"] for x in best], pa.int32()),
                    "longest_item": pa.array([x and x["item"] for x in best], pa.int64()),
                }
            )

    return hits.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest int, longest_at int, longest_item long")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, item_pos, n_words, doc_id, doc_pos: each test suffix's longest verbatim match over all shards.

    Positions count words from 0; ties go to the smallest (doc_id, doc_pos).  A
    test suffix without a match of a whole window has no row, nor has an item
    without an id.
    """
    read = texts(docs, id_col, text_col)
    out = None
    for rows in _blocks(benchmark.where("item_id is not null"), "item_id", "text", BLOCK_BYTES):
        held = docs.sparkSession.sparkContext.broadcast((rows, window))

        def make(held=held):
            bench = Benchmark(*held.value)

            def step(ids, blobs):
                shard = Shard(blobs, bench)
                found = list(shard.longest())
                d = shard.doc_of(np.array([x[3] for x in found], np.int64)) if found else []
                return {
                    "item_id": [bench.ids[x[0]] for x in found],
                    "item_pos": [x[1] for x in found],
                    "n_words": [x[2] for x in found],
                    "doc_id": [ids[k] for k in d],
                    "doc_pos": [x[3] - int(shard.starts[k]) for x, k in zip(found, d, strict=True)],
                }

            return step

        block = map_chunks(read, "item_id long, item_pos int, n_words int, doc_id long, doc_pos int", make)
        out = block if out is None else out.unionByName(block)
    best = F.min(F.struct((-F.col("n_words")).alias("less"), "doc_id", "doc_pos")).alias("b")
    return out.groupBy("item_id", "item_pos").agg(best).select(
        "item_id", "item_pos", (-F.col("b.less")).alias("n_words"), "b.doc_id", "b.doc_pos"
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_items: int = 2) -> DataFrame:
    """The rows of `docs`, all their columns, whose own text holds windows of fewer than `least_items` items; they are not shuffled."""
    item_id = _id_of(benchmark)
    rows = list(_blocks(benchmark, item_id, "text", BLOCK_BYTES))
    if len(rows) > 1 and least_items > 1:  # items of several blocks add up
        scanned = scan(docs.select(F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))).alias("doc_id"), "text"), benchmark, window, least_items)
        bad = scanned.where("contaminated").select(F.col("doc_id").alias("__gone_key")).distinct()
        return docs.join(bad, F.xxhash64(F.coalesce(docs["text"].cast("binary"), F.lit("").cast("binary"))) == F.col("__gone_key"), "left_anti")
    for block in rows:
        held = docs.sparkSession.sparkContext.broadcast((block, window))

        def make(held=held):
            bench = Benchmark(*held.value)

            def keep(blobs):
                shard = Shard(blobs, bench)
                found: list[set] = [set() for _ in blobs]
                for k, at, _ in shard.matches():
                    for d in np.unique(shard.doc_of(at)).tolist():
                        found[d].add(bench.ids[k])
                return [len(x) < least_items for x in found]

            return keep

        docs = kept_rows(docs, make)
    return docs
