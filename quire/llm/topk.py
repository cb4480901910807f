"""Exact top-k search over integer vectors with an impact-ordered index.

Vectors are packed into shards of bounded size, queries into blocks of bounded
size, and each block meets each shard once.  In a shard, the postings of a
dimension are its vectors in order of their quantised value there, their impact,
cut into segments of like impact.  For a query, what a segment can add is the
query's weight times the segment's best value, less the least that the dimension
can add: never below zero.  Segments are processed in descending order of it, and
each posting adds its lower bound to its vector's accumulator.

Processing stops only on proof: a vector can still gain at most what is left in
each dimension, or what quantisation hides there; once few vectors can reach the k-th best lower bound, these alone are possible
members, and they are scored again exactly, from the vectors themselves.  Ties at
the bound stay possible members, so they are decided by id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._batches import settle

#: Vectors in a shard, and queries in a block, and bytes of either: wide vectors make smaller ones.
SHARD, BLOCK, PACK_BYTES = 1 << 15, 1 << 12, 16 << 20
#: Segments in a dimension of a shard.
LEVELS = 8
#: Impacts in a dimension of a shard; a posting's is its value, rounded down to one of them.
IMPACTS = 256
#: Times in a search that the proof is tried.
CHECKS = 16
#: A search stops when at most so many vectors, or k, are left.
FEW = 256
#: Products are summed in 64 bits if all that a search adds stays below this; else in Python's integers.
LARGEST = 1 << 60


def _largest(values: np.ndarray) -> int:
    """The largest magnitude."""
    return max(int(values.max()), -int(values.min())) if values.size else 0


class Shard:
    """The impact-ordered index of some vectors."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, levels: int = LEVELS) -> None:
        self.ids, self.values = ids, values
        n, self.dims = values.shape
        self.largest = _largest(values)
        if self.largest * max(self.dims, 1) >= LARGEST:  # no query but of zeros could use the index
            return
        self.order = np.argsort(values, axis=0, kind="stable").T.copy() if n else np.zeros((self.dims, 0), np.int64)
        edges = np.unique(np.linspace(0, n, min(levels, max(n, 1)) + 1).astype(np.int64))
        self.edges, self.segments = edges, len(edges) - 1
        ordered = np.take_along_axis(values.T, self.order, axis=1)
        self.low = ordered[:, edges[:-1]]  # by dimension and segment
        self.high = ordered[:, edges[1:] - 1]
        spread = ordered[:, -1] - ordered[:, 0] if n else np.zeros(self.dims, np.int64)
        self.step = spread // IMPACTS + 1
        self.impact = ordered // self.step[:, None] * self.step[:, None]  # quantised down

    def search(self, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but `own`; all, if fewer."""
        n, mine = len(self.ids), int((self.ids == own).sum()) if own is not None else 0
        fits = max(self.dims, 1) * self.largest * max(_largest(query), 1) < LARGEST
        possible = self._possible(query, k + mine) if fits and n > max(FEW, k + mine) else np.arange(n)
        possible = possible[self.ids[possible] != own] if own is not None else possible
        if not fits:
            return self._exact(possible, query, k)
        scores = self.values[possible] @ query
        if len(scores) > k:
            best = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            possible, scores = possible[best], scores[best]
        order = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible][order], scores[order]

    def _exact(self, possible: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for some vectors, scored in Python's integers."""
        q = query.tolist()
        found = ((-sum(x * y for x, y in zip(self.values[i].tolist(), q, strict=True)), int(self.ids[i])) for i in possible.tolist())
        best = heapq.nsmallest(k, found)
        if any(not -(1 << 63) <= -s < 1 << 63 for s, _ in best):
            raise ArithmeticError("a score among the best does not fit into 64 bits")
        return np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)

    def _possible(self, query: np.ndarray, k: int) -> np.ndarray:
        """Vectors that may be among the k best."""
        n = len(self.ids)
        w = query[:, None]
        base = np.where(w >= 0, w * self.low, w * self.high).min(axis=1)  # least that a dimension can add
        worth = np.where(w >= 0, w * self.high, w * self.low) - base[:, None]  # most that a segment's vectors gain beyond it
        hidden = np.abs(query) * (self.step - 1)  # most that quantisation hides of a posting
        shift = np.where(query >= 0, 0, query * (self.step - 1)) - base
        sums = np.zeros(n, np.int64)
        by_worth = np.argsort(-worth.ravel(), kind="stable")
        every = max(1, len(by_worth) // CHECKS)
        for step, s in enumerate(by_worth.tolist(), 1):
            d, j = divmod(s, self.segments)
            part = slice(self.edges[j], self.edges[j + 1])
            sums[self.order[d, part]] += query[d] * self.impact[d, part] + shift[d]
            if step % every == 0 or step == len(by_worth):
                left = hidden.copy()  # most that a dimension can still add to a vector's sum
                np.maximum.at(left, by_worth[step:] // self.segments, worth.ravel()[by_worth[step:]])
                bound = np.partition(sums, n - k)[n - k]
                possible = np.nonzero(sums + left.sum() >= bound)[0]
                if len(possible) <= max(FEW, k):
                    break
        return possible


def _pack(size: int):
    """Rows (id, values) to packed rows (n, dims, ids, values), each of at most `size` vectors, or PACK_BYTES, of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        held: dict[int, list] = {}

        def packed(dims: int) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
            return pa.RecordBatch.from_pydict(
                {"n": pa.array([len(ids)], pa.int32()), "dims": pa.array([dims], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([values.tobytes()], pa.binary())}
            )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for dims in np.unique(lengths).tolist():
                rows = np.nonzero(lengths == dims)[0]
                most = max(1, min(size, PACK_BYTES // (8 * max(dims, 1))))
                for i in range(0, len(rows), most):
                    part = rows[i : i + most]
                    if sum(len(x[0]) for x in held.get(dims, ())) + len(part) > most:
                        yield packed(dims)
                    held.setdefault(dims, []).append((ids[part], flat[starts[part][:, None] + np.arange(dims)[None, :]].astype(np.int64)))
        for dims in list(held):
            yield packed(dims)

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        last, shard = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["shard"]) != last:
                    last = (row["part"], row["shard"])
                    shard = Shard(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(row["n"], row["dims"]))
                own = np.frombuffer(row["q_ids"], np.int64)
                queries = np.frombuffer(row["q_vectors"], np.int64).reshape(row["q_n"], row["dims"])
                found = [shard.search(q, int(i), k) for i, q in zip(own, queries, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array(np.repeat(own, [len(x[0]) for x in found]), pa.int64()),
                        "vec_id": pa.array(np.concatenate([x[0] for x in found]), pa.int64()),
                        "score": pa.array(np.concatenate([x[1] for x in found]), pa.int64()),
                    }
                )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to smaller ids.

    Both frames have the columns id (long) and values (array of long).  A query's
    candidates are the vectors of its length whose id is not its own; a query
    without any has no rows.  Vectors or ids that are null, and vectors that hold a
    null, take no part.  Vectors of no dimension score 0.  An id that repeats is
    searched, and returned, once for each of its different vectors and once for
    each of its rows.  Shards are dealt over as many slots as there are shuffle
    partitions and a copy of each query block goes to each slot; k rows a query and
    shard are ranked.
    """
    clean = lambda df: df.select(F.col("id").cast("long").alias("id"), "values").where("id is not null and values is not null and forall(values, x -> x is not null)")
    packed = "n int, dims int, ids binary, vectors binary"
    number = F.monotonically_increasing_id()
    slots = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = clean(vectors).mapInArrow(_pack(SHARD), packed).select(F.spark_partition_id().alias("part"), number.alias("shard"), "*")
    shards = shards.withColumn("slot", F.pmod(F.xxhash64("part", "shard"), F.lit(slots)))
    blocks = clean(queries).mapInArrow(_pack(BLOCK), packed).select("dims", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    blocks = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))  # a copy for each slot of shards
    met = shards.join(blocks, ["dims", "slot"]).select("part", "shard", "n", "dims", "ids", "vectors", "q_n", "q_ids", "q_vectors")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, values: floor(scale * x) of each component, as double; vectors that are null or hold a null, NaN or infinity are left out."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return embeddings.where(F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("values"),
    )
