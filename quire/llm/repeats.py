"""Substring dedup with prefix-partitioned suffix trees over words.

Only suffixes that can have a twin are put into trees.  Of the short runs of words
(grams) inside a window, the one with the least hash is its anchor; equal windows
have equal anchors, so a window whose anchor occurs once in the corpus is unique.
The windows around an anchor that repeats travel together, as one piece of text,
to the group of suffixes that meet at that gram.

The prefix that partitions is as long as a group needs: groups of more than GROUP
words are split by longer prefixes of their own suffixes, and at last by whole
windows, which partial sums decide; so no tree outgrows a task, however often or
in however many surroundings a passage stands.

Equal pieces are merged before and after the shuffle, so a group's size is that of
its different texts, not of its copies.  In each group a compressed suffix tree,
cut at the window's depth, takes the pieces in document order: a suffix that ends
in an inner node as deep as a window has an earlier twin, and runs of such suffixes
are the maximal repeats that a text has in common with what stands before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._batches import map_chunks, settle, texts
from quire.llm.store import released, written

WINDOW, GRAM = 20, 6
#: Words of different pieces in a group before its prefix is lengthened: bounds a tree to some tens of megabytes.
GROUP = 1 << 15
#: Bytes of text whose pieces are merged before they are shuffled; bounds a worker's memory.
CHUNK = 8 << 20
#: Sorts after every document: the id of one whose id is null.
LAST = (1 << 63) - 1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words(text: bytes) -> list[bytes]:
    return text.split()


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each run of `width` values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


class Anchors:
    """The anchors of one text: `at[w]` is the place of window w's, `grams` the hashes of all grams."""

    def __init__(self, found: list[bytes], window: int, gram: int) -> None:
        digest = xxhash.xxh3_64_intdigest
        each = np.fromiter(map(digest, found), np.uint64, len(found))
        n = len(found) - gram + 1
        grams = np.zeros(n, np.uint64)
        for k in range(gram):
            grams = grams * _MULTIPLIER + each[k : k + n]
        grams = (grams ^ grams >> np.uint64(32)) * _MIX
        self.grams = grams ^ grams >> np.uint64(29)
        width = window - gram + 1
        least = _slide(self.grams, width, np.minimum)
        place = np.where(self.grams == self._spread(least, width), np.arange(n), -1)  # anchors of any window
        # The leftmost anchor of a window is the first place from its start whose gram is the window's least.
        later = np.nonzero(place >= 0)[0]
        after = np.searchsorted(later, np.arange(len(least)))
        at = later[after]
        while (wrong := np.nonzero(self.grams[at] != least)[0]).size:
            after[wrong] += 1
            at = later[after]
        self.at = at

    @staticmethod
    def _spread(least: np.ndarray, width: int) -> np.ndarray:
        """The greatest least value of the windows over each place."""
        edge = np.zeros(width - 1, np.uint64)
        return _slide(np.concatenate([edge, least, edge]), width, np.maximum)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (a null id last), text, tk (the text's hash: rows that share an id may differ)."""
    read = texts(docs, id_col, text_col)
    return read.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text", F.xxhash64("text").alias("tk"))


def _anchors(read: DataFrame, window: int, gram: int) -> DataFrame:
    """gram, doc_id, place (twice the position) of each text's anchors.

    An anchor that repeats in its chunk is known to repeat: its places are odd, and
    one even row for the chunk tells others of it, so that no gram has more of
    those than there are chunks.
    """

    def make():
        def step(ids, blobs):
            grams, docs, places = [], [], []
            for i, b in zip(ids, blobs, strict=True):
                found = words(b)
                if len(found) >= window:
                    a = Anchors(found, window, gram)
                    at = np.unique(a.at)
                    grams.append(a.grams[at].view(np.int64))
                    docs.append(np.full(len(at), i, np.int64))
                    places.append(at * 2)
            if not grams:
                return None
            grams, docs, places = (np.concatenate(x) for x in (grams, docs, places))
            _, first, which, often = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
            told = first[often > 1]
            shared = docs[told], places[told]
            places = places + (often[which] > 1)
            return {"gram": np.concatenate([grams, grams[told]]), "doc_id": np.concatenate([docs, shared[0]]), "place": np.concatenate([places, shared[1]])}

        return step

    return map_chunks(read.select("doc_id", "text"), "gram long, doc_id long, place long", make, CHUNK)


def _repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, doc_id, place), sorted by gram, to doc_id, pos of the anchors that repeat."""
    settle()
    held = None
    for batch in batches:
        now = np.stack([batch.column(k).to_numpy() for k in range(3)])
        rows = now if held is None else np.concatenate([held, now], axis=1)
        if rows.shape[1] < 2:
            held = rows
            continue
        same = rows[0, 1:] == rows[0, :-1]
        often = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | (rows[2] & 1 == 1)
        # The last row waits for what comes after it; if it repeats already, that is all it has to tell the next one.
        yield _places(rows[1:, often])
        held = rows[:, -1:].copy()
    if held is not None:
        yield _places(held[1:, held[2] & 1 == 1])


def _places(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(rows[0], pa.int64()), "pos": pa.array((rows[1] >> 1).astype(np.int32), pa.int32())})


def _flagged(read: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, places: the positions of a document's anchors that repeat."""
    dealt = F.when(F.col("place").bitwiseAND(1) == 1, F.xxhash64("doc_id", "place")).otherwise(F.col("gram"))
    rows = _anchors(read, window, gram).withColumn("dealt", dealt).repartition("dealt").select("gram", "doc_id", "place").sortWithinPartitions("gram")
    return rows.mapInArrow(_repeating, "doc_id long, pos int").groupBy("doc_id").agg(F.collect_set("pos").alias("places"))  # no more than a document's words


AT = "array<struct<doc_id:long,start:int,tk:long>>"
PIECE = f"gram long, k1 long, k2 long, piece binary, n int, at {AT}"


def _pieces(read: DataFrame, flagged: DataFrame, window: int, gram: int) -> DataFrame:
    """The windows around each repeated anchor: gram, k1 and k2 (the piece's hash), piece (words joined by a space), n
    (windows), at (where it starts; equal pieces of a chunk are one row)."""
    rows = read.join(flagged, "doc_id").select("doc_id", "text", "tk", "places")
    columns = pa.schema([("gram", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("piece", pa.binary()), ("n", pa.int32())])

    def told(held: dict) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
        grams, pieces, sizes, docs, starts, tks = zip(*held.values(), strict=True)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
        flat = [np.array([y for x in column for y in x], kind) for column, kind in ((docs, np.int64), (starts, np.int32), (tks, np.int64))]
        at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["doc_id", "start", "tk"]))
        own = [pa.array(x, f.type) for x, f in zip((grams, keys[:, 0], keys[:, 1], pieces, sizes), columns, strict=True)]
        return pa.RecordBatch.from_arrays([*own, at], [*columns.names, "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, text, tks, places = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)
            held: dict[bytes, tuple] = {}
            size = 0
            for k, i in enumerate(ids):
                blob = text[k].as_py()
                found = words(blob)
                if len(found) < window:
                    continue
                a = Anchors(found, window, gram)
                edges = np.concatenate([[0], np.nonzero(np.diff(a.at))[0] + 1, [len(a.at)]])
                own = a.at[edges[:-1]]
                keep = np.nonzero(np.isin(own, places[k].values.to_numpy()))[0]
                grams = a.grams[own[keep]].view(np.int64).tolist()
                for g, lo, hi in zip(grams, edges[keep].tolist(), edges[keep + 1].tolist(), strict=True):
                    piece = b" ".join(found[lo : hi - 1 + window])
                    key = digest(piece)
                    row = held.get(key)
                    if row is None:
                        held[key] = (g, piece, hi - lo, [i], [lo], [tks[k]])
                    else:
                        row[3].append(i)
                        row[4].append(lo)
                        row[5].append(tks[k])
                size += len(blob)
                if size > CHUNK:
                    if held:
                        yield told(held)
                    held, size = {}, 0
            if held:
                yield told(held)

    return rows.mapInArrow(run, PIECE)


class SuffixTree:
    """A compressed tree of word suffixes, cut at `depth` words."""

    def __init__(self, depth: int) -> None:
        self.depth, self.root = depth, {}

    def add(self, text: list[bytes], start: int) -> bool:
        """Insert text[start : start + depth]; whether it was there already."""
        children, at, end = self.root, start, start + self.depth
        while True:
            edge = children.get(text[at])
            if edge is None:
                children[text[at]] = [text, at, end, None]
                return False
            other, lo, hi, below = edge
            size = hi - lo
            if other[lo:hi] == text[at : at + size]:
                at += size
                if at == end:
                    return True
                children = below
                continue
            same = 1
            while other[lo + same] == text[at + same]:
                same += 1
            middle = {other[lo + same]: [other, lo + same, hi, below], text[at + same]: [text, at + same, end, None]}
            edge[:] = [other, lo, lo + same, middle]
            return False


def _twins(window: int):
    """Rows (gram, k1, k2, piece, at, doc_id, start, copies), by gram and then in document order, to (k1, k2, doc_id, start,
    twins) of pieces that need a word: where each first starts, and its ranges of words in windows with earlier twins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        gram, tree = None, None
        for batch in batches:
            grams, k1, k2, pieces, ats, ids, starts, copies = (batch.column(k).to_pylist() for k in range(8))
            out: dict[str, list] = {k: [] for k in TWINS.names}
            for k, piece in enumerate(pieces):
                if grams[k] != gram:
                    gram, tree = grams[k], SuffixTree(window)
                found, off = piece.split(b" "), ats[k]
                twins: list[int] = []
                for w in range(len(found) - window + 1):
                    if tree.add(found, w):
                        if twins and twins[-1] >= off + w:
                            twins[-1] = off + w + window
                        else:
                            twins += [off + w, off + w + window]
                if twins or copies[k] > 1:
                    for name, x in zip(TWINS.names, (k1[k], k2[k], ids[k], starts[k] - off, twins), strict=True):
                        out[name].append(x)
            if out["k1"]:
                yield pa.RecordBatch.from_pydict(out, schema=TWINS)

    return run


TWINS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first_id", pa.int64()), ("first_start", pa.int32()), ("twins", pa.list_(pa.int32()))])
TWIN = "k1 long, k2 long, first_id long, first_start int, twins array<int>"
UNIT = ["gram", "k1", "k2", "piece", "at", "doc_id", "start", "copies"]


def _windows(window: int, prefix: int):
    """Units to units of one window each, whose gram is a hash of their own first `prefix` words."""
    schema = pa.schema([("gram", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("piece", pa.binary()), ("at", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int32()), ("copies", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):  # each piece becomes as many rows as it has windows
                out: dict[str, list] = {k: [] for k in UNIT}
                for r in batch.slice(lo, 2000).to_pylist():
                    found = r["piece"].split(b" ")
                    for w in range(len(found) - window + 1):
                        h = digest(b" ".join(found[w : w + prefix]))
                        own = (h - (1 << 64) if h >> 63 else h, r["k1"], r["k2"], b" ".join(found[w : w + window]), r["at"] + w, r["doc_id"], r["start"] + w, r["copies"])
                        for name, x in zip(UNIT, own, strict=True):
                            out[name].append(x)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _treed(units: DataFrame, window: int) -> DataFrame:
    ordered = units.select(UNIT).repartition("gram").sortWithinPartitions("gram", "doc_id", "start", "k1", "k2")
    return ordered.mapInArrow(_twins(window), TWIN)


def _decided(units: DataFrame, window: int, gram: int, group: int) -> DataFrame:
    """TWIN rows of the pieces in `units`, at most one each: groups of more than `group` words get longer prefixes."""
    sizes = lambda u: u.groupBy("gram").agg(F.sum(F.length("piece")).alias("b"), F.count(F.lit(1)).alias("n")).where((F.col("b") > 6 * group) & (F.col("n") > 1))
    hot = written(sizes(units).select("gram"), "hot")
    if not hot.take(1):
        return _treed(units, window)
    out = _treed(units.join(hot, "gram", "left_anti"), window)
    parts, prefix, rest = [], gram, units.join(hot, "gram", "left_semi")
    while True:
        prefix = min(2 * prefix, window)
        rest = written(rest.select(UNIT).mapInArrow(_windows(window, prefix), "gram long, k1 long, k2 long, piece binary, at int, doc_id long, start int, copies long"), "windows")
        if prefix == window:
            break
        hot = written(sizes(rest).select("gram"), "hot")
        parts.append(_treed(rest.join(hot, "gram", "left_anti"), window))
        rest = rest.join(hot, "gram", "left_semi")
    # A group of one window: its first place is a minimum, with partial sums before the shuffle.
    first = written(rest.groupBy("gram", "piece").agg(F.min(F.struct("doc_id", "start")).alias("first")), "firsts")
    told = rest.join(first, ["gram", "piece"])
    twin = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))
    ranges = F.when(twin, F.array(F.col("at"), F.col("at") + window)).otherwise(F.array().cast("array<int>"))
    parts.append(told.where(twin | (F.col("copies") > 1)).select("k1", "k2", F.col("doc_id").alias("first_id"), (F.col("start") - F.col("at")).alias("first_start"), ranges.alias("twins")))
    split = parts[0]
    for p in parts[1:]:
        split = split.unionByName(p)
    merged = split.groupBy("k1", "k2", "first_id", "first_start").agg(F.flatten(F.collect_list("twins")).alias("twins"))  # the windows of one piece
    return out.unionByName(merged)


def repeated(read: DataFrame, window: int, gram: int, group: int = GROUP) -> DataFrame:
    """doc_id, tk, found: a flat array of ranges, the words [begin, end) of that text in windows which start earlier too."""
    flagged = written(_flagged(read, window, gram), "flagged")
    pieces = written(_pieces(read, flagged, window, gram), "pieces")
    released(flagged)
    at = F.array_min(F.transform("at", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"))))
    unique = pieces.select("gram", "k1", "k2", "piece", at.alias("first"), F.size("at").alias("n")).groupBy("gram", "k1", "k2").agg(
        F.min("first").alias("first"), F.first("piece").alias("piece"), F.sum("n").alias("copies")
    )
    units = written(unique.select("gram", "k1", "k2", "piece", F.lit(0).alias("at"), F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), "copies"), "units")
    twins = _decided(units, window, gram, group)
    places = pieces.select("k1", "k2", "n", "at").join(twins, ["k1", "k2"]).select("n", "first_id", "first_start", "twins", F.explode("at").alias("x"))
    first = (F.col("x.doc_id") == F.col("first_id")) & (F.col("x.start") == F.col("first_start"))
    ranges = F.when(first, F.transform("twins", lambda x: x + F.col("x.start"))).otherwise(F.array(F.col("x.start"), F.col("x.start") + F.col("n") - 1 + window))
    told = places.select("x.doc_id", "x.tk", ranges.alias("ranges")).where("size(ranges) > 0")
    told = written(told.groupBy("doc_id", "tk").agg(F.flatten(F.collect_list("ranges")).alias("found")), "found")  # no more than a document's words
    released(pieces, units)
    return told


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept (its other words, joined by one space), repeats.

    Words are runs without ASCII white space, unchanged.  A word goes if a window of
    `window` words that covers it also starts earlier: in a document with a smaller
    id, or before it in the same one; windows are judged on the input.  `repeats`
    are the maximal runs of words that went, as (begin, end) in words.  A null or
    empty text has no words; a text shorter than a window keeps them all.  A null id
    comes after all others.  Rows that share an id are one document for the order:
    of two equal windows at the same place of such rows, neither is earlier.
    """
    read = _keyed(docs, id_col, text_col)
    rows = read.join(repeated(read, window, gram, group), ["doc_id", "tk"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            ids, text, found = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            for lo in range(0, len(ids), 500):
                out: dict[str, list] = {k: [] for k in schema.names}
                for k in range(lo, min(lo + 500, len(ids))):
                    own = words(text[k].as_py())
                    n = len(own)
                    edge = np.zeros(n + 2, np.int64)
                    if found[k].is_valid:
                        ranges = found[k].values.to_numpy()
                        np.add.at(edge, ranges[::2] + 1, 1)
                        np.subtract.at(edge, ranges[1::2] + 1, 1)
                    gone = np.cumsum(edge) > 0  # the word at i is at i + 1
                    turns = np.nonzero(gone[1:] != gone[:-1])[0].tolist()
                    runs = list(zip(turns[::2], turns[1::2], strict=True))
                    if runs:
                        own = [own[i] for i in np.nonzero(~gone[1 : n + 1])[0].tolist()]
                    for name, x in zip(schema.names, (None if ids[k] == LAST else ids[k], n, n - len(own), b" ".join(own), [{"begin": b, "end": e} for b, e in runs]), strict=True):
                        out[name].append(x)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    ends = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("repeats", ends)])
    return rows.select("doc_id", "text", "found").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary, repeats array<struct<begin:int,end:int>>")
