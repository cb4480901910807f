"""Search over whole books, topic filters, and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: Code points of a snippet, and those of them that stand before the match.
SNIPPET, BEFORE = 110, 45


def snippet(body: Column, at: Column) -> Column:
    """The cleaned text around a match at a 1-based place; the start is clamped, and the length counts from there."""
    return T.clean_snippet(F.substring(body, F.greatest(at - BEFORE, F.lit(1)), F.lit(SNIPPET)))


def search(df: DataFrame, needle: str, keys: list[str], title: str, body: str, collation: str | None = None) -> DataFrame:
    """(keys..., title, snippet) of the rows whose title or body holds the needle.

    ASCII case is ignored; with a collation (such as UNICODE_CI_AI) its rules hold.
    A match in the title alone shows the title.  A null body has no match; an empty
    needle finds nothing.
    """
    if not needle:
        return df.select(*keys, F.col(title).alias("title"), F.lit("").alias("snippet")).limit(0)
    t, b = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(body), F.lit(""))
    if collation:
        n = F.collate(F.lit(needle), collation)
        at, in_title = F.instr(F.collate(b, collation), n), F.contains(F.collate(t, collation), n)
    else:
        n = F.lit("".join(c.lower() if c.isascii() else c for c in needle))
        at, in_title = F.instr(T.ascii_lower(b), n), F.contains(T.ascii_lower(t), n)
    found = df.select(*keys, t.alias("title"), b.alias("__b"), at.alias("__at"), in_title.alias("__t")).where("__at > 0 or __t")
    return found.select(*keys, "title", F.when(F.col("__at") > 0, snippet(F.col("__b"), F.col("__at"))).otherwise(F.col("title")).alias("snippet"))


def topic_filter(df: DataFrame, query: str, key: str, title: str) -> DataFrame:
    """Rows whose id or title holds the query, case-sensitive; all rows for an empty one."""
    return df if not query else df.where(F.contains(F.col(key), F.lit(query)) | F.contains(F.col(title), F.lit(query)))


def lookup(df: DataFrame, key: str, value: str, any_case: bool = False) -> DataFrame:
    """The rows of an id: exactly, or without ASCII case."""
    return df.where(T.equals_ci(key, F.lit(value)) if any_case else F.col(key) == value)
