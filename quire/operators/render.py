"""Flat document blocks to Markdown and HTML: one expression a block, then an ordered join.

Blocks are rows (topic_id, ord, kind, level, text, marker, depth, target): a topic's
blocks are gathered in order, no further than the topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def markdown_block() -> Column:
    """The Markdown of one block; text is inline Markdown already, but for preformatted and opaque blocks."""
    kind, text = F.col("kind"), _c("text")
    indent = F.repeat(F.lit("  "), F.coalesce("depth", F.lit(0)))
    fence = F.repeat(F.lit("`"), F.greatest(T.longest_backticks("text") + 1, F.lit(3)))
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), text))
        .when(kind == "thematic_break", "---")
        .when(kind == "anchor", F.concat(F.lit('<a id="'), T.html_escape(_c("target"), True), F.lit('"></a>')))
        .when(kind == "list_item", F.concat(indent, F.coalesce("marker", F.lit("-")), F.lit(" "), text))
        .when(kind == "note", F.concat(F.lit("> **"), _c("marker"), F.lit(":** "), text))
        .when(kind == "footnote", F.concat(F.lit("[^"), _c("marker"), F.lit("]: "), text))
        .when(kind.isin("preformatted", "opaque"), F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence))
        .when(kind == "figure", F.concat(F.lit("!["), text, F.lit("]("), _c("target"), F.lit(")")))
        .when(kind == "menu_item", F.concat(F.lit("- ["), text, F.lit("]("), _c("target"), F.lit(")")))
        .when(kind == "index_group", F.concat(F.lit("**"), text, F.lit("**")))
        .otherwise(text)
    )


def html_block(prefix: str = "doc-") -> Column:
    """The HTML of one block, with a class of its kind; text is plain and is escaped."""
    kind, text = F.col("kind"), T.html_escape(_c("text"))
    tag = F.when(kind == "heading", F.concat(F.lit("h"), F.coalesce("level", F.lit(1)))).when(kind == "list_item", "li").when(kind.isin("preformatted", "opaque"), "pre").when(kind == "note", "aside").otherwise("p")
    name = F.concat(F.lit(f' class="{prefix}'), F.replace(kind, F.lit("_"), F.lit("-")), F.lit('"'))
    href = F.when(T.safe_href(_c("target")), T.html_escape(_c("target"), True)).otherwise("#")
    return (
        F.when(kind == "thematic_break", F.concat(F.lit("<hr"), name, F.lit(">")))
        .when(kind == "anchor", F.concat(F.lit('<a id="'), T.html_escape(_c("target"), True), F.lit('"></a>')))
        .when(kind == "figure", F.concat(F.lit("<figure"), name, F.lit('><img src="'), href, F.lit('" alt="'), T.html_escape(_c("text"), True), F.lit('"></figure>')))
        .when(kind == "menu_item", F.concat(F.lit("<p"), name, F.lit('><a href="'), href, F.lit('">'), text, F.lit("</a></p>")))
        .otherwise(F.concat(F.lit("<"), tag, name, F.lit(">"), text, F.lit("</"), tag, F.lit(">")))
    )


def topics(blocks: DataFrame, block: Column, separator: str = "\n\n") -> DataFrame:
    """(topic_id, body): each topic's blocks in order; blocks without text are left out."""
    own = blocks.select("topic_id", "ord", block.alias("b")).where("b <> ''")
    held = F.array_sort(F.collect_list(F.struct("ord", "b")))
    return own.groupBy("topic_id").agg(F.array_join(F.transform(held, lambda s: s["b"]), separator).alias("body"))


def book(rendered: DataFrame, book: list[str], order: str) -> DataFrame:
    """(book..., body): a book's non-empty topics in order, a blank line between them."""
    held = F.array_sort(F.collect_list(F.struct(order, "body")))
    return rendered.where("body <> ''").groupBy(*book).agg(F.array_join(F.transform(held, lambda s: s["body"]), "\n\n").alias("body"))


def with_diagnostic(body: Column, severity: Column, reason: Column) -> Column:
    """The body under a comment that says how it was made, unless it is fully typed."""
    return F.when(severity == "typed", body).otherwise(F.concat(F.lit("<!-- "), severity, F.lit(": "), F.replace(reason, F.lit("--"), F.lit("- -")), F.lit(" -->\n"), body))
