"""Spans found in texts: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int>>"


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the order they have."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest(found: DataFrame, base: tuple[str, ...], scores: bool = False) -> DataFrame:
    """doc_id, n_<kind> of each base kind, base_sha256 and spans, from rows of doc_id and spans; with `scores`, theirs in the same order."""
    kinds = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select(
        "doc_id",
        *map(_count, base),
        F.sha2(joined(kinds), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *([F.transform("spans", lambda s: F.round(s["score"], 3)).alias("scores")] if scores else []),
    )


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of spans that overlap, replaced by its first kind in brackets."""
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])
