"""Connected components of a graph given by its links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import written


class Forest:
    """Union-find with the least member as each set's root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            above = up.get(x, x)
            up[x] = top
            x = above
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def components(links: DataFrame, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """node, component (the least node reachable) of each node of a link, from links (a, b) of longs.

    A hub's links are never gathered: each round takes a minimum, with partial
    sums before the shuffle, and joins it back, which Spark splits where a hub is
    hot.  Rounds grow with the logarithm of the longest path; each is written to
    the shared folder, so lineage stays short, in files as its links need them, not
    one for each part of a shuffle.  `rows` is about how many links there are, if
    known.  Links with a null end, or from a node to itself, tell nothing.
    """
    now = written(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", rows)
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "links", 2 * state[0])
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links", 2 * state[0])
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")
