"""Ordered sequences: differences of two, fixed rows from placed fragments, cells with one owner."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _opcodes(before, after, most: int, values: int) -> list[dict]:
    out = []
    for op, a, b, c, d in SequenceMatcher(None, before or [], after or [], autojunk=False).get_opcodes():
        if op != "equal" and len(out) < most:
            out.append({"op": op, "before": list(before[a:b])[:values] if before else [], "after": list(after[c:d])[:values] if after else []})
    return out


def difference(before: Column | str, after: Column | str, most: int = 3, values: int = 2) -> Column:
    """The first differences of two arrays of strings: (op, before, after), each with the first values; null arrays are empty."""
    schema = "array<struct<op:string,before:array<string>,after:array<string>>>"
    return F.udf(lambda a, b: _opcodes(a, b, most, values), schema, useArrow=True)(before, after)


def fixed_rows(fragments: DataFrame, part: list[str]) -> DataFrame:
    """(part..., row, text, conflict) from fragments (part..., row, column from 0, text, padding).

    Real characters beat padding; two that differ in one cell are a conflict, and the
    row's text is then null.  Cells that nothing covers are blanks.
    """
    cells = fragments.select(*part, "row", F.col("column").alias("__c"), "padding", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("__k", "ch"))
    one = cells.groupBy(*part, "row", (F.col("__c") + F.col("__k")).alias("at")).agg(
        F.min(F.when(~F.col("padding"), F.col("ch"))).alias("lo"), F.max(F.when(~F.col("padding"), F.col("ch"))).alias("hi"), F.min("ch").alias("pad")
    )
    own = one.select(*part, "row", "at", F.coalesce("lo", "pad").alias("ch"), F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("bad"))
    held = own.groupBy(*part, "row").agg(F.map_from_entries(F.collect_list(F.struct("at", "ch"))).alias("m"), F.max("at").alias("last"), F.bool_or("bad").alias("conflict"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(" "))), "")
    return held.select(*part, "row", F.when(~F.col("conflict"), text).alias("text"), "conflict")


def ownership(claims: DataFrame, cell: list[str], disposition: str) -> DataFrame:
    """(cell..., disposition, n_claims, conflict): each cell's one disposition, or null where claims disagree."""
    own = claims.groupBy(*cell).agg(F.min(disposition).alias("lo"), F.max(disposition).alias("hi"), F.count(F.lit(1)).alias("n_claims"))
    conflict = F.col("lo") != F.col("hi")
    return own.select(*cell, F.when(~conflict, F.col("lo")).alias(disposition), "n_claims", conflict.alias("conflict"))


def unaccounted(tokens: DataFrame, roles: DataFrame, key: list[str], topic: list[str]) -> DataFrame:
    """(topic..., n): topics some of whose tokens have no role, and how many; a topic is recognised only if it is not here."""
    return tokens.join(roles, key, "left_anti").groupBy(*topic).agg(F.count(F.lit(1)).alias("n"))
