"""Topics, contents, nesting and book properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def catalog(topics: DataFrame, toc: DataFrame) -> DataFrame:
    """Topics and contents entries merged: (folded_id, topic_id, topic_no, toc, in_toc).

    The id is compared without ASCII case; a topic may have several entries (toc:
    their indexes, in order).  Order by topic_no, then toc[0], nulls last.  Input: topics(topic_id, topic_no), toc(topic_id, toc_index).
    """
    t = topics.select(T.ascii_upper("topic_id").alias("folded_id"), "topic_id", "topic_no")
    c = toc.groupBy(T.ascii_upper("topic_id").alias("folded_id")).agg(
        F.array_sort(F.collect_list("toc_index")).alias("toc"), F.min_by("topic_id", "toc_index").alias("toc_id")
    )
    both = t.join(c, "folded_id", "full_outer")
    return both.select(
        "folded_id", F.coalesce("topic_id", "toc_id").alias("topic_id"), "topic_no", "toc", F.col("toc").isNotNull().alias("in_toc")
    )


def catalog_faults(topics: DataFrame) -> DataFrame:
    """(folded_id, fault): empty ids, and ids that differ in ASCII case at most."""
    keyed = topics.groupBy(T.ascii_upper("topic_id").alias("folded_id")).agg(F.count(F.lit(1)).alias("n"))
    fault = F.when(F.coalesce("folded_id", F.lit("")) == "", "empty id").when(F.col("n") > 1, "duplicate id")
    return keyed.select("folded_id", fault.alias("fault")).where("fault is not null")


def with_toc(topics: DataFrame, toc: DataFrame) -> DataFrame:
    """Topics with in_toc and the level and style of their first entry, by exact id."""
    first = toc.groupBy("topic_id").agg(F.min_by(F.struct("level", "style"), "toc_index").alias("e"))
    return topics.join(first, "topic_id", "left").select(
        topics["*"], F.col("e").isNotNull().alias("in_toc"), F.col("e.level").alias("toc_level"), F.col("e.style").alias("toc_style")
    )


def source_index(toc: DataFrame, topics: DataFrame, n_topics: Column) -> DataFrame:
    """Contents entries with their topic's ordinal, or the number of topics where there is none."""
    return toc.join(topics.select("topic_id", F.col("topic_no").alias("source_index")), "topic_id", "left").withColumn(
        "source_index", F.coalesce("source_index", n_topics)
    )


def nesting(nodes: DataFrame, key: str, parent: str, book: list[str], most: int = 64) -> DataFrame:
    """Depth of each node under its parents: rows (book..., key, depth).

    An empty parent ends a chain; a null parent, one that is not there, or a cycle
    gives a null depth.  Of a key's rows the one with the least parent counts.  Each round doubles the length of the chains that are
    known, so a chain of n parents takes log n joins; ends after `most` rounds.
    """
    from quire.operators.checkpoints import cut

    first = nodes.groupBy(*book, key).agg(F.min(parent).alias("up"))
    now = cut(first.select(*book, F.col(key).alias("k"), F.when(F.col("up") == "", F.lit(None)).otherwise(F.col("up")).alias("up"),
                           F.when(F.col("up") == "", "end").when(F.col("up").isNull(), "lost").otherwise("open").alias("state"),
                           F.when(F.col("up") == "", 0).otherwise(1).cast("long").alias("d")))
    n, rounds = now.count(), 0
    while now.where("state = 'open'").limit(1).count() and rounds < most and 2 ** max(0, rounds - 1) <= n:
        up = now.select(*book, F.col("k").alias("up"), F.col("up").alias("up2"), F.col("state").alias("state2"), F.col("d").alias("d2"))
        step = now.join(up, [*book, "up"], "left")
        open_ = F.col("state") == "open"
        now = cut(step.select(
            *book, "k",
            F.when(open_, F.col("up2")).otherwise(F.col("up")).alias("up"),
            F.when(open_, F.coalesce("state2", F.lit("lost"))).otherwise(F.col("state")).alias("state"),
            F.when(open_, F.col("d") + F.coalesce("d2", F.lit(0))).otherwise(F.col("d")).alias("d"),
        ))
        rounds += 1
    return now.select(*book, F.col("k").alias(key), F.when(F.col("state") == "end", F.col("d")).alias("depth"))


def all_or_nothing(toc: DataFrame, book: list[str], column: str) -> DataFrame:
    """Entries of books in which every entry has a value: one null declines a whole book's contents."""
    fine = F.bool_and(F.col(column).isNotNull()).over(Window.partitionBy(*book))
    return toc.withColumn("__fine", fine).where("__fine").drop("__fine")


def topic_ranges(records: DataFrame, book: list[str], order: str, header: Column) -> DataFrame:
    """(book..., topic_no, start, end): half-open ranges that header records open; the last ends after the last record."""
    w = Window.partitionBy(*book).orderBy(order)
    last = F.max(order).over(Window.partitionBy(*book))
    heads = records.withColumn("__last", last).where(header)
    return heads.select(*book, F.row_number().over(w).cast("long").alias("topic_no"), F.col(order).alias("start"), F.coalesce(F.lead(order).over(w), F.col("__last") + 1).alias("end"))


def first_of_id(df: DataFrame, book: list[str], key: str, order: str) -> DataFrame:
    """The first row of each id; later ones with the same id go."""
    w = Window.partitionBy(*book, key).orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def properties(controls: DataFrame, book: list[str], singles: list[str], repeated: str) -> DataFrame:
    """One row a book: the last value of each single key, and all non-empty values of the repeated key, in order.

    Input: (book..., ord, key, value).  A later empty value counts as a value.
    """
    last = [F.max_by("value", F.when(F.col("key") == k, F.col("ord"))).alias(k.lower()) for k in singles]
    held = F.filter(F.array_sort(F.collect_list(F.when((F.col("key") == repeated) & (F.col("value") != ""), F.struct("ord", "value")))), lambda s: s.isNotNull())
    return controls.groupBy(*book).agg(*last, F.transform(held, lambda s: s["value"]).alias(repeated.lower()))


def until_first(df: DataFrame, book: list[str], order: str, closing: Column) -> DataFrame:
    """Rows up to the first one that closes a header, with it; all, if none does."""
    end = F.min(F.when(closing, F.col(order))).over(Window.partitionBy(*book))
    return df.withColumn("__end", end).where(F.col("__end").isNull() | (F.col(order) <= F.col("__end"))).drop("__end")


def detail_counts(books: DataFrame, topics: DataFrame, toc: DataFrame, resources: DataFrame, key: str = "book_id") -> DataFrame:
    """Books with the numbers of their topics, contents entries and resources."""
    out = books
    for name, df in (("n_topics", topics), ("n_toc", toc), ("n_resources", resources)):
        out = out.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return out.na.fill(0, ["n_topics", "n_toc", "n_resources"])
