"""All pairs of texts whose shingle sets have a Jaccard similarity of `least` or more, by a prefix-filter join.

If the shingles of all texts are put in one order, two sets of similarity t or more
share one of the first n - ceil(t n) + 1 shingles of each.  The order is rarest first,
as counted in a sample (the sample decides what the join costs, never what it finds).
Texts with equal sets are one node.  Nodes that share such a shingle are candidates
unless their sizes or the shingle's places rule the similarity out, or their sketches,
which bound from above what two sets share; the similarity of each candidate that is
left is then computed from both whole sets of 64-bit shingle hashes.  Only the texts
of such candidates are read into sets, and no text is shuffled.

The links found connect all that similar pairs connect, but are not all those pairs:
first each bucket's nodes are compared with its first few, whose prefixes hold few
rare shingles (an original, rather than its edited copies); then all that are not yet
in one component are compared with one another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._batches import map_chunks, settle
from quire.llm.components import components
from quire.llm.store import released, written

#: Counters of shingles, by their hash's low bits, in pieces; and one text in so many is counted.
COUNTERS, PIECES, SAMPLE = 1 << 20, 16, 4
#: Nodes of a bucket that all its others are compared with at first.
HUBS = 3
#: Candidates handed on at once; bounds memory.
AT_ONCE = 1 << 16
#: Bits for each text that is wanted, and at most, of the map that tells most others from them.
WANTED_BITS, MOST_BITS = 16, 1 << 27
#: Passes, a power of two, in which the prefixes' hashes are counted.
PASSES = 2
#: Seed of a text's hash, as Spark's xxhash64 has it.
SEED = 42
#: A pair's nodes, and the documents that their sets are read from.
ENDS = ["a", "a_id", "a_key", "b", "b_id", "b_key"]
#: Odd numbers that mix a document's id and its text's hash.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def node_of(found: np.ndarray) -> int:
    """A number for a set, signed."""
    x = xxhash.xxh3_64_intdigest(found.tobytes())
    return x - (1 << 64) if x >> 63 else x


def needed(n: int, least: Fraction) -> int:
    """Members that a set of n must share with any set that similar."""
    return -(-least.numerator * n // least.denominator)


def counts(read: DataFrame, sets) -> np.ndarray:
    """How often the shingles of each counter are in a sample of a `texts` frame; sets(text) gives a text's hashes."""
    sample = read.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0)
    size = COUNTERS // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for text in batch.column(1):
                total[(sets(text.as_py()) & np.uint64(COUNTERS - 1)).astype(np.int64)] += 1  # hashes of one text that share a counter count once
        for k in range(PIECES):
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "held": pa.array([zlib.compress(total[k * size : (k + 1) * size].tobytes(), 1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[k] = totals.get(k, np.zeros(size, np.uint32)) + np.frombuffer(zlib.decompress(held), np.uint32)
        for k, x in totals.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "held": pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())})

    schema = "piece int, held binary"
    out = np.zeros(COUNTERS, np.uint32)
    for r in sample.mapInArrow(count, schema).repartition("piece").mapInArrow(add, schema).collect():
        out[r.piece * size : (r.piece + 1) * size] = np.frombuffer(zlib.decompress(bytes(r.held)), np.uint32)
    return out


def prefix(found: np.ndarray, seen: np.ndarray, least: Fraction) -> np.ndarray:
    """The first hashes of a set, rarest first, one of which any set that similar has among its own first."""
    n = len(found)
    order = np.lexsort((found, seen[(found & np.uint64(COUNTERS - 1)).astype(np.int64)]))
    return found[order[: n - needed(n, least) + 1 if n else 0]].view(np.int64)


def _bucket(nodes, sizes, places, groups, least: Fraction, hubs: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of one bucket, sorted by place: with its first nodes, or all others that are in different groups."""
    num, den = least.numerator, least.denominator
    rest = sizes - places  # a hash's own and those after it in the order
    for i in range(0 if hubs else HUBS, min(HUBS, len(nodes) - 1) if hubs else len(nodes) - 1):
        n, other = sizes[i], slice(i + 1, None)
        m = sizes[other]
        fit = (groups[other] != groups[i]) & (num * np.maximum(n, m) <= den * np.minimum(n, m))
        # least shared: least / (1 + least) of both sizes; none before the least common hash, if this is it
        fit &= (num + den) * np.minimum(rest[i], rest[other]) >= num * (n + m)
        at = np.nonzero(fit)[0] + i + 1
        if len(at):
            yield np.repeat(nodes[i], len(at)), nodes[at]


def _candidates(least: Fraction, hubs: bool):
    """Rows (hash, node, n, place, group), sorted by hash and place, to candidates (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        held: np.ndarray | None = None
        out, size = [], 0

        def handed() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_pydict({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

        def buckets():
            nonlocal held
            for batch in batches:
                rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)])
                held = rows if held is None else np.concatenate([held, rows], axis=1)
                edges = np.nonzero(held[0, 1:] != held[0, :-1])[0] + 1
                edges = np.concatenate([[0], edges])
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if hi - lo > 1:
                        yield held[:, lo:hi]
                held = held[:, edges[-1] :]
            if held is not None and held.shape[1] > 1:
                yield held

        for bucket in buckets():
            for pairs in _bucket(*bucket[1:], least, hubs):
                out.append(pairs)
                size += len(pairs[0])
                if size >= AT_ONCE:
                    yield handed()
                    size = 0
        if out:
            yield handed()

    return run


def _alike(least: Fraction):
    """Rows (a, b, set of a, set of b) to those pairs that are as similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(least.denominator * both >= least.numerator * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return run


def sketch(found: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, by a power of two not under their number: whether an odd number of them has it."""
    size = max(64, 1 << max(0, len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def most_shared(n: int, x: bytes, m: int, y: bytes) -> int:
    """How many members two sets of n and m share at most: each bit that differs is of a member that one of them lacks."""
    x, y = (np.frombuffer(v, np.uint8) for v in (x, y))
    least = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, least), axis=0) for v in (x, y))
    return (n + m - int(np.bitwise_count(x ^ y).sum())) // 2


def _possible(least: Fraction):
    """Rows (n and sketch of a, n and sketch of b, ENDS) to the ends of those pairs that may be as similar."""
    num, den = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            n, x, m, y = (batch.column(k).to_pylist() for k in range(4))
            keep = [(num + den) * most_shared(n[k], x[k], m[k], y[k]) >= num * (n[k] + m[k]) for k in range(batch.num_rows)]
            yield batch.select(ENDS).filter(pa.array(keep, pa.bool_()))

    return run


def _spots(ids, keys, size: int) -> np.ndarray:
    """Two bits of a map of `size` bits, a power of two, for each document."""
    mixed = (np.asarray(ids, np.int64).view(np.uint64) * MIX[0] + np.asarray(keys, np.int64).view(np.uint64)) * MIX[1]
    mixed ^= mixed >> np.uint64(29)
    return np.stack([mixed & np.uint64(size - 1), mixed >> np.uint64(64 - size.bit_length() + 1)]).astype(np.int64)


def _map_of(wanted: DataFrame, n: int) -> np.ndarray:
    """A map of bits in which both spots of each of n documents (doc_id, text_key) are set; few others have both."""
    size = min(MOST_BITS, max(1 << 10, 1 << (WANTED_BITS * n - 1).bit_length()))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        total = np.zeros(size, np.bool_)
        for batch in batches:
            total[_spots(batch.column(0).to_numpy(), batch.column(1).to_numpy(), size)] = True
        if total.any():
            yield pa.RecordBatch.from_pydict({"held": pa.array([zlib.compress(np.packbits(total).tobytes(), 1)], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    for r in wanted.select("doc_id", "text_key").mapInArrow(step, "held binary").toLocalIterator(prefetchPartitions=True):
        out |= np.frombuffer(zlib.decompress(bytes(r.held)), np.uint8)
    return out


def verified(pairs: DataFrame, read: DataFrame, sources: DataFrame, sets, least: Fraction, repeats: bool = True) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are as similar, from the texts of `sources` (node, doc_id, text_key, n, sketch).

    `repeats`: whether any row of `read` may be there more than once.
    """
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in ("a", "b"):
        named = {"node": end, "doc_id": f"{end}_id", "text_key": f"{end}_key", "n": f"{end}_n", "sketch": f"{end}_sketch"}
        pairs = pairs.join(sources.select(*(F.col(k).alias(v) for k, v in named.items())), end)
    pairs = pairs.select("a_n", "a_sketch", "b_n", "b_sketch", *ENDS).mapInArrow(_possible(least), ", ".join(f"{k} long" for k in ENDS))
    pairs = written(pairs, "candidates")
    ends = (pairs.select(F.col(f"{end}_id").alias("doc_id"), F.col(f"{end}_key").alias("text_key")) for end in ("a", "b"))
    wanted = written(next(ends).unionByName(next(ends)).distinct(), "wanted", 2 * pairs.count())
    n = wanted.count()
    if not n:
        return pairs.select("a", "b")
    seen = read.sparkSession.sparkContext.broadcast(_map_of(wanted, n))

    def make():
        spots, size = seen.value, 8 * len(seen.value)

        def step(ids, blobs):
            keys = np.array([xxhash.xxh64_intdigest(b, SEED) for b in blobs], np.uint64).view(np.int64)
            at = _spots(ids, keys, size)
            wants = (spots[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0)
            some = np.nonzero(wants)[0].tolist()
            return {"doc_id": [ids[k] for k in some], "text_key": keys[some], "held": [sets(blobs[k]).tobytes() for k in some]} if some else None

        return step

    held = map_chunks(read, "doc_id long, text_key long, held binary", make)
    held = written(held.dropDuplicates(["doc_id", "text_key"]) if repeats else held, "sets")
    seen.destroy()
    x, y = (held.select(F.col("doc_id").alias(f"{end}_id"), F.col("text_key").alias(f"{end}_key"), F.col("held").alias(f"{end}_held")) for end in ("a", "b"))
    both = pairs.join(x, ["a_id", "a_key"]).join(y, ["b_id", "b_key"]).select("a", "b", "a_held", "b_held")
    alike = written(both.mapInArrow(_alike(least), "a long, b long"), "alike")
    released(held, wanted, pairs)
    return alike


def meeting(firsts: DataFrame) -> DataFrame:
    """hash, node, n, place of the prefixes' hashes that several nodes have; firsts (node, n, prefix) has each node once.

    Most hashes are one node's alone.  Hashes are taken by their last bits, a part
    at a time, so that the shuffles of all are never on disk at once.
    """
    out = None
    for k in range(PASSES):
        rows = firsts.select("node", "n", F.posexplode("prefix").alias("place", "hash")).where(F.col("hash").bitwiseAND(F.lit(PASSES - 1)) == k)
        many = rows.groupBy("hash").count().where("count > 1").select("hash")
        met = written(rows.join(many, "hash", "left_semi").select("hash", "node", "n", "place"), "met")
        out = met if out is None else out.unionByName(met)
    return out


def similar(met: DataFrame, read: DataFrame, sources: DataFrame, sets, least: Fraction, known: DataFrame | None = None, repeats: bool = True) -> DataFrame:
    """a, b: links that connect all nodes of similarity `least` or more, from what `meeting` gives."""

    def candidates(rows: DataFrame, hubs: bool) -> DataFrame:
        keyed = rows.select("hash", "node", "n", "place", "group").repartition("hash").sortWithinPartitions("hash", "place", "node")
        return keyed.mapInArrow(_candidates(least, hubs), "a long, b long")

    links = verified(candidates(met.withColumn("group", F.col("node")), True), read, sources, sets, least, repeats)
    links = links if known is None else links.unionByName(known)
    grouped = met.join(components(links, rows=links.count()).withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    return links.unionByName(verified(candidates(grouped, False), read, sources, sets, least, repeats))
