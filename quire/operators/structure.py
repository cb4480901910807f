"""Structure of topics: counters, form rows, numbered steps, declared characters, slices, and selectors that show pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import grammar as G
from quire.functions import text as T

SEGMENT = "kind"


def picture_selectors(selectors: DataFrame, resources: DataFrame, book: list[str]) -> DataFrame:
    """Selectors (book..., operands, payload) with `image`: their third operand is a stored resource, or the payload an image mark."""
    known = resources.select(*book, T.ascii_lower("resource_id").alias("__r")).distinct().withColumn("__known", F.lit(True))
    out = selectors.withColumn("__r", T.ascii_lower(F.get("operands", F.lit(2)))).join(known, [*book, "__r"], "left")
    marked = F.startswith(T.ascii_lower(T.trim_ascii_whitespace("payload")), F.lit("<image>"))
    return out.withColumn("image", F.coalesce("__known", F.lit(False)) | F.coalesce(marked, F.lit(False))).drop("__r", "__known")


def structure_counts(segments: DataFrame, rows: DataFrame, topic: list[str]) -> DataFrame:
    """One row a topic: its heading's kind and how often it has each feature.

    segments: (topic..., ord, kind, opcode, operands, image); rows: (topic..., text).
    Both are summed before they meet; a topic of either side has a row.
    """
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    kind, figure = F.col("kind"), (F.col("kind") == "structural") & F.startswith(T.ascii_lower("opcode"), F.lit("srfig"))
    image = F.coalesce(F.col("image"), F.lit(False))
    own = segments.groupBy(*topic).agg(
        F.min_by(T.ascii_lower(T.trim_ascii(F.array_join("operands", " "))), F.when(kind == "heading_level", F.col("ord"))).alias("heading"),
        count((kind == "select") & ~image).alias("selectors"), count((kind == "select") & image).alias("image_selectors"), count(kind == "font").alias("fonts"),
        count(kind == "table_start").alias("tables"), count(kind.isin("menu_start", "menu_item", "menu_end")).alias("menu"),
        count(kind == "message_start").alias("messages"), count(figure).alias("figures"), count((kind == "structural") & ~figure).alias("others"),
    )
    body = rows.groupBy(*topic).agg(F.count(F.lit(1)).alias("rows"), count(G.list_item_row("text")).alias("lists"))
    numbers = [c for c in (*own.columns, *body.columns) if c not in (*topic, "heading")]
    return own.join(body, topic, "full_outer").na.fill(0, numbers)


def classified(counts: DataFrame, topic_id: str) -> DataFrame:
    """Counts with their signature and class."""
    figures = F.col("figures") + F.col("image_selectors")
    signature = G.structure_signature(**({f: F.col(f) for f in G.FEATURES if f != "figures"} | {"figures": figures}))
    out = counts.withColumn("signature", signature)
    return out.withColumn("class", G.structure_class(topic_id, "heading", F.col("rows"), F.col("signature")))


def form_rows(rows: DataFrame, part: list[str], order: str, cells: list[str], mark: str = "kind") -> DataFrame:
    """(part..., row from 1, cells...): physical rows gathered into form rows.

    A row_start opens a form row, a border closes it, a continuation adds to it (or
    opens one after a border), and spacers are left out.  A cell's non-empty pieces
    are joined by a line break, in order; a form row is as long as its physical rows.
    """
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    session = F.count_if(F.col(mark).isin("row_start", "border")).over(w)
    held = rows.withColumn("__s", session).where(F.col(mark).isin("row_start", "continuation"))
    pieces = lambda c: F.array_sort(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.col(order).alias("o"), F.col(c).alias("v")))))
    out = held.groupBy(*part, "__s").agg(*(F.array_join(F.transform(pieces(c), lambda p: p["v"]), "<br>").alias(c) for c in cells))
    return out.select(*part, F.row_number().over(Window.partitionBy(*part).orderBy("__s")).alias("row"), *cells)


def numbered_steps(rows: DataFrame, part: list[str], order: str, number: str, origin: str, barrier: Column, proven: Column) -> DataFrame:
    """Rows of numbered runs: two or more in a row that count up by one from one origin with no barrier between, all of them proven."""
    w = Window.partitionBy(*part).orderBy(order)
    follows = (F.col(number) == F.lag(number).over(w) + 1) & F.col(origin).eqNullSafe(F.lag(origin).over(w)) & ~F.coalesce(barrier, F.lit(False))
    run = F.count_if(~F.coalesce(F.col("__follows"), F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("__follows", follows).withColumn("__run", run)
    own = Window.partitionBy(*part, "__run")
    fine = (F.count(F.lit(1)).over(own) >= 2) & F.bool_and(F.coalesce(proven, F.lit(False))).over(own)
    return marked.withColumn("__fine", fine).where("__fine").drop("__follows", "__run", "__fine")


def declared_characters(lines: DataFrame, book: list[str]) -> DataFrame:
    """(book..., characters): the different characters that revision declarations of a book's header name, in order.

    lines: (book..., words): a line's drawn words; blanks are none.  An operand is one visible character.
    """
    words = F.filter("words", lambda x: F.trim(x) != "")
    operand = F.get(words, F.lit(1))
    fine = (T.ascii_lower(F.get(words, F.lit(0))) == "crevdesc") & (F.length(operand) == 1) & (F.ascii(operand) > 32) & (operand != "�")
    return lines.where(fine).groupBy(*book).agg(F.array_sort(F.collect_set(operand)).alias("characters"))


def earliest_slices(slices: DataFrame, block: list[str], place: list[str]) -> DataFrame:
    """The slice of each block that comes first in the source, by (record, segment, token) or what `place` names."""
    rest = [c for c in slices.columns if c not in block]
    first = F.min_by(F.struct(*rest), F.struct(*place)).alias("__first")
    return slices.groupBy(*block).agg(first).select(*block, "__first.*")


def with_named_destinations(targets: DataFrame, named: DataFrame, topic: list[str]) -> DataFrame:
    """Link targets, and as anchors the names that the source gives a whole topic; empty names go."""
    return targets.unionByName(named.where("id <> ''").select(*topic, F.lit("anchor").alias("kind"), "id"))


def sampled(df: DataFrame, name: str, n: int, seed: int) -> DataFrame:
    """n rows that hash lowest: the same ones on every run, however the rows are dealt.  Sampling is the feature here."""
    return df.orderBy(F.xxhash64(F.lit(seed), name), name).limit(n)


def carried_selection(segments: DataFrame, part: list[str], record: str, order: str) -> DataFrame:
    """(part..., record, carried): whether the record just before ends with a selection whose line is still to come.

    Empty font controls at a record's end are passed over.  Records meet by number, so no part is sorted in one task.
    """
    passed = F.coalesce((F.col("kind") == "font") & (F.col("payload") == ""), F.lit(False))
    last = F.max_by(F.struct("kind", "payload"), F.when(~passed, F.col(order)))
    ends = segments.groupBy(*part, record).agg(last.alias("__last"))
    open_ = ends.where("__last.kind = 'select' and __last.payload = ''").select(*part, (F.col(record) + 1).alias(record), F.lit(True).alias("carried"))
    return ends.select(*part, record).join(open_, [*part, record], "left").na.fill(False, ["carried"])


def drawn_cells(cells: DataFrame, controls: DataFrame, key: list[str]) -> DataFrame:
    """Cells that no proven control owns; controls: (key..., proven)."""
    return cells.join(controls.where("proven").select(*key).distinct(), key, "left_anti")
