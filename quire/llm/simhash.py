"""SimHash near-duplicates, searched with BK-trees.

A fingerprint's bit is 1 if it is set in over half of the hashes of a text's
shingles.  Equal fingerprints are one node, whose id is their least document.
Two fingerprints within `radius` bits agree in at least one of radius + 1 parts of
their bits, so each is dealt to a shard for every part's value; a shard with too
many members is dealt again by the parts of its other bits, which loses no pair
either, until what is left of the bits bounds its size.  Each shard has a BK-tree
of its own: a node's children are keyed by their Hamming distance to it, and a
search follows only the edges within the radius.  Of the links found, a task
passes on a spanning forest, so that a group of n near copies costs n links, not
its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import similar
from quire.llm._batches import map_chunks, settle, texts
from quire.llm.components import Forest, components
from quire.llm.store import released, written

SEED = 42
BITS = 64
#: Fingerprints in a shard before it is dealt again.
SHARD = 500
#: Hashes whose bits are counted at once; bounds memory.
AT_ONCE = 1 << 16


def shingles(text: bytes, size: int) -> list[bytes]:
    """Each run of `size` words (all words, if fewer), joined by a space, A-Z lower-cased."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(w) for w in zip(*(islice(words, k, None) for k in range(size)), strict=False)]


def hashes(runs: list[bytes], seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in runs), np.uint64, len(runs))


def fingerprint(found: np.ndarray) -> int:
    """The fingerprint of some shingles' hashes as a signed 64-bit number; that of none is 0."""
    if not len(found):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(found), AT_ONCE):
        part = found[i : i + AT_ONCE].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) of each whole text."""

    def make():
        return lambda ids, blobs: {"doc_id": ids, "fp": [fingerprint(hashes(shingles(b, shingle))) for b in blobs]}

    return map_chunks(texts(docs, id_col, text_col), "doc_id long, fp long", make)


class BKTree:
    """Numbers under Hamming distance."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, x: int) -> None:
        if self.root is None:
            self.root, self.children = x, {x: {}}
            return
        at = self.root
        while (d := (at ^ x).bit_count()) and d in (below := self.children[at]):
            at = below[d]
        if d:
            self.children[at][d] = x
            self.children[x] = {}

    def within(self, x: int, radius: int) -> Iterator[int]:
        """Members at most `radius` bits from x."""
        todo = [] if self.root is None else [self.root]
        while todo:
            at = todo.pop()
            d = (at ^ x).bit_count()
            if d <= radius:
                yield at
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]


def _parts(mask: int, n: int) -> list[int]:
    """Masks that add to `mask` each of n parts of the other bits, whose sizes differ by one at most."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    edges = [len(free) * k // n for k in range(n + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(rows: DataFrame, masks: Column) -> DataFrame:
    return rows.withColumn("mask", F.explode(masks)).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def _linked(radius: int):
    """Sorted rows (mask, value, fp, rep) to links of each task's spanning forest, each of two that are within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        forest, key, tree, rep = Forest(), None, BKTree(), {}
        first: tuple[int, int] | None = None
        out: list[tuple[int, int]] = []
        for batch in batches:
            mask, value, fp, ids = (batch.column(k).to_numpy() for k in range(4))
            same = np.concatenate([[False], (mask[1:] == mask[:-1]) & (value[1:] == value[:-1])])
            alone = ~same & ~np.concatenate([same[1:], [False]])
            if len(alone):  # the ends of a batch may go on in another
                alone[-1] = False
                alone[0] &= (mask[0], value[0]) != key
            for k in np.nonzero(~alone)[0].tolist():
                now = (mask[k], value[k])
                x, own = int(fp[k]) & (1 << 64) - 1, int(ids[k])
                if now != key:
                    key, tree, rep, first = now, None, {}, (x, own)
                    continue
                if tree is None:
                    tree = BKTree()
                    tree.add(first[0])
                    rep[first[0]] = first[1]
                for y in tree.within(x, radius):
                    if forest.join(own, rep[y]):
                        out.append((own, rep[y]))
                tree.add(x)
                rep[x] = own
        for i in range(0, len(out), 10_000):
            a, b = zip(*out[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def links(nodes: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """a, b: links that connect all nodes (rep, fp; each fp once) within `radius` bits of one another."""
    n = radius + 1
    level = _parts(0, n)
    rows = _dealt(nodes, F.array(*(F.lit(_signed(m)) for m in level)))
    out = []
    while True:
        narrowest = min(BITS - m.bit_count() for m in level)
        if narrowest < n or 1 << max(BITS - m.bit_count() for m in level) <= shard:
            break  # a shard holds different fingerprints, so its other bits bound its size
        hot = rows.groupBy("mask", "value").count().where(F.col("count") > shard).select("mask", "value")
        hot = written(hot, "shards")
        if not hot.take(1):
            break
        out.append(rows.join(hot, ["mask", "value"], "left_anti"))
        parts = {m: _parts(m, n) for m in level}
        pairs = [x for m, p in parts.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(c)) for c in p)))]
        rows = _dealt(rows.join(hot, ["mask", "value"], "left_semi").select("rep", "fp", F.col("mask").alias("above")), F.create_map(*pairs)[F.col("above")]).drop("above")
        rows = rows.select("rep", "fp", "mask", "value").distinct()
        level = sorted({c for p in parts.values() for c in p})
    out.append(rows)
    found = None
    for r in out:
        keyed = r.select("mask", "value", "fp", "rep").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
        some = keyed.mapInArrow(_linked(radius), "a long, b long")
        found = some if found is None else found.unionByName(some)
    return found


def groups(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fp, component_id (the least doc_id reachable over links, itself included).

    Texts whose fingerprints differ in at most `radius` bits are linked.  A null
    or empty text, or one of white space, has fingerprint 0, and is linked like any
    other.  A document with a null id has a fingerprint, but takes part in no link:
    its component is null.  Rows that repeat are each reported; rows that share an
    id but not a text are linked where that id is the least of both.
    """
    found = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = written(found.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes", found.count())
    joined = components(links(nodes, radius), rows=nodes.count())
    classes = nodes.join(joined, nodes["rep"] == joined["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return found.join(classes, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def hexed(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 3, least: float = 0.8) -> DataFrame:
    """The rows of `docs`, all their columns, of one document of each group: that with the least id.

    Documents are linked whose sets of shingles have a Jaccard similarity of `least`
    or more.  Fingerprints within `radius` bits are candidates, found with BK-trees,
    whose similarity is computed; a join of prefixes finds all that are as similar
    and lie further apart.  Rows without an id are kept.  Of rows that share an id,
    each text is a document of its own; rows that repeat in both are one.
    """
    share = Fraction(str(least))
    sets = lambda text: np.unique(hashes(shingles(text, shingle)))
    read = texts(docs).where("doc_id is not null")
    seen = docs.sparkSession.sparkContext.broadcast(similar.counts(read, sets))

    def make():
        def each(text):
            held = hashes(shingles(text, shingle))
            found = np.unique(held)
            key = xxhash.xxh64_intdigest(text, SEED)  # as Spark's xxhash64 has it
            return _signed(key), similar.node_of(found), len(found), similar.prefix(found, seen.value, share), similar.sketch(found), fingerprint(held)

        return lambda ids, blobs: {"doc_id": ids} | dict(zip(("text_key", "node", "n", "prefix", "sketch", "fp"), zip(*map(each, blobs), strict=True), strict=True))

    found = written(map_chunks(read, "doc_id long, text_key long, node long, n long, prefix array<long>, sketch binary, fp long", make), "fingerprints")
    placed = written(found.select("doc_id", "text_key", "node"), "placed")
    repeats = bool(placed.groupBy("doc_id", "text_key").count().where("count > 1").take(1))
    one = F.min(F.struct("doc_id", "text_key", "n", "prefix", "sketch", "fp")).alias("one")
    nodes = written(found.groupBy("node").agg(one).select("node", "one.*"), "nodes")
    released(found)
    met = similar.meeting(nodes)
    sources = written(nodes.drop("prefix"), "sources")
    released(nodes)
    reps = written(sources.groupBy("fp").agg(F.min("node").alias("rep")), "reps", sources.count())
    same = sources.join(reps, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    linked = similar.verified(same.unionByName(links(reps, radius)), read, sources, sets, share, repeats)
    joined = components(similar.similar(met, read, sources, sets, share, linked, repeats), rows=sources.count())
    grouped = placed.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = grouped.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    gone = grouped.join(first, "component").where("struct(doc_id, text_key) <> first")
    gone = written(gone.select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key")).distinct(), "gone", placed.count())
    released(met, sources, reps, placed)
    key = F.xxhash64(F.coalesce(docs["text"].cast("binary"), F.lit("").cast("binary")))
    kept = docs.join(gone, (docs["doc_id"].cast("long") == gone["__gone_id"]) & (key == gone["__gone_key"]), "left_anti")
    if repeats:
        named = kept.where("doc_id is not null").withColumn("__key", key).dropDuplicates(["doc_id", "__key"]).drop("__key")
        kept = named.unionByName(kept.where("doc_id is null"))
    return kept
