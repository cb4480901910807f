"""Link maps, resolution with fallbacks, repair, and dead links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# The prefixes under which a figure's or table's anchor is known too.
ALIAS_PREFIXES = {"figure": "FIG", "table": "TBL"}


def extracted(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, ord from 1, href) of each href attribute in double quotes, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit('href="([^"]*)"'), 1)
    return df.select(key, F.posexplode(found).alias("at", "href")).select(key, (F.col("at") + 1).alias("ord"), "href")


def link_map(targets: DataFrame, book: list[str], last_wins: bool = False) -> DataFrame:
    """(book..., anchor, dest) from targets (book..., ord, anchor, kind, dest): each under its own name and its aliases.

    Of targets with one name the first wins; `last_wins` is the other policy that readers have.
    """
    names = F.array_distinct(
        F.filter(
            F.array(F.col("anchor"), *(F.when(F.col("kind") == k, F.concat(F.lit(p), F.col("anchor"))) for k, p in ALIAS_PREFIXES.items())),
            lambda a: a.isNotNull() & (a != ""),
        )
    )
    each = targets.select(*book, "ord", F.explode(names).alias("anchor"), "dest")
    pick = F.max_by if last_wins else F.min_by
    return each.groupBy(*book, "anchor").agg(pick("dest", "ord").alias("dest"))


def resolved(links: DataFrame, anchors: DataFrame, toc: DataFrame, book: list[str]) -> DataFrame:
    """Links (book..., topic_id, anchor) with how they resolve: (dest_topic, fragment, resource, how, url).

    anchors: (book..., anchor, dest_topic, fragment, resource), one row an anchor;
    toc: (book..., folded_id, toc_topic), one row an id.  An exact anchor wins: its
    resource, else a fragment of the same topic, else the other topic with its
    fragment; else the anchor is taken for a contents id, without ASCII case; else
    the link is dead and its url null.
    """
    out = links.withColumn("folded_id", T.ascii_upper("anchor")).join(anchors, [*book, "anchor"], "left").join(toc, [*book, "folded_id"], "left")
    hit = F.col("dest_topic").isNotNull() | F.col("resource").isNotNull()
    with_fragment = F.concat(F.col("dest_topic"), F.when(F.coalesce("fragment", F.lit("")) != "", F.concat(F.lit("#"), "fragment")).otherwise(""))
    how = F.when(hit & F.col("resource").isNotNull(), "resource").when(hit & (F.col("dest_topic") == F.col("topic_id")), "same").when(hit, "topic").when(F.col("toc_topic").isNotNull(), "toc").otherwise("dead")
    url = (
        F.when(how == "resource", F.concat(F.lit("object/"), "resource"))
        .when(how == "same", F.concat(F.lit("#"), F.coalesce("fragment", F.lit(""))))
        .when(how == "topic", with_fragment)
        .when(how == "toc", F.col("toc_topic"))
    )
    return out.withColumn("how", how).withColumn("url", url).drop("folded_id")


def rendered_targets(links: DataFrame) -> DataFrame:
    """href and unresolved of cross references (kind, value, resolved): "" is dead, null asks for the kind's fallback."""
    value = F.col("value")
    fallback = (
        F.when(F.col("kind") == "anchor", F.concat(F.lit("#"), value))
        .when(F.col("kind") == "resource", value)
        .when(F.col("kind").isin("topic", "external") & T.safe_href("value"), value)
        .otherwise("#")
    )
    href = F.when(F.col("resolved") == "", "#").when(F.col("resolved").isNotNull(), F.col("resolved")).otherwise(fallback)
    return links.withColumn("href", href).withColumn("unresolved", (F.col("href") == "#"))


def resources_resolved(links: DataFrame, resources: DataFrame, book: list[str]) -> DataFrame:
    """Links to exact stored resource ids get an object URL; others stay as written."""
    known = resources.select(*book, F.col("resource_id").alias("target")).distinct().withColumn("__known", F.lit(True))
    out = links.join(known, [*book, "target"], "left")
    return out.withColumn("url", F.when(F.col("__known"), F.concat(F.lit("object/"), "target")).otherwise(F.col("target"))).drop("__known")


def repaired(broken: DataFrame, anchors: DataFrame, part: list[str]) -> DataFrame:
    """Broken links with the one anchor of their file that ends with their name, ASCII case aside; else null.

    anchors' endings are dealt as rows, so the ends-with join is an equi-join on
    (file, ending); an anchor has as many endings as letters.
    """
    last = F.length("anchor")
    ends = anchors.select(*part, "anchor").distinct().select(
        *part, F.col("anchor").alias("candidate"), F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: T.ascii_lower(F.substr("anchor", i)))).alias("ending")
    )
    named = broken.withColumn("ending", T.ascii_lower("name"))
    hits = named.select(*part, "ending").distinct().join(ends, [*part, "ending"]).groupBy(*part, "ending").agg(F.count(F.lit(1)).alias("n"), F.first("candidate").alias("repair")).where("n = 1").drop("n")
    return named.join(hits, [*part, "ending"], "left").drop("ending")


def dead(links: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Links whose target no anchor has."""
    return links.join(anchors.select(*keys).distinct(), keys, "left_anti")


def menus_valid(items: DataFrame, catalog: DataFrame, part: list[str], book: list[str], label: str | None = None) -> DataFrame:
    """Menu items of menus all of whose targets their own book's catalog has: one that fails declines its whole menu.

    items: (book..., part..., target), catalog: (book..., folded_id).  With `label`,
    items have it and the catalog has topic_title and toc_title, and an item's label
    must be one of its target's titles too; ASCII case and runs of blanks aside.
    """
    plain = lambda c: T.ascii_lower(T.trim_ascii(T.collapse_whitespace(c)))
    own = [*book, F.col("folded_id").alias("__target")]
    titles = F.array_distinct(F.flatten(F.collect_list(F.array(plain("topic_title"), plain("toc_title"))))) if label else F.lit(True)
    known = catalog.select(*own, *(["topic_title", "toc_title"] if label else [])).groupBy(*book, "__target").agg(
        titles.alias("__known") if label else F.first(titles).alias("__known")
    )
    out = items.withColumn("__target", T.ascii_upper("target")).join(known, [*book, "__target"], "left")
    fits = F.coalesce(F.array_contains("__known", plain(label)), F.lit(False)) if label else F.col("__known").isNotNull()
    fine = F.bool_and(fits).over(Window.partitionBy(*dict.fromkeys([*book, *part])))
    return out.withColumn("__fine", fine).where("__fine").select(items.columns)


def figure_anchors(blocks: DataFrame, part: list[str], order: str) -> DataFrame:
    """Anchors with the resource of the figure right after them; breaks are skipped, any other block stands between."""
    w = Window.partitionBy(*part).orderBy(order)
    own = blocks.where("kind <> 'thematic_break'")
    nxt = F.when(F.lead("kind").over(w) == "figure", F.lead("resource").over(w))
    return own.withColumn("next_resource", nxt).where("kind = 'anchor' and next_resource is not null").select(*part, "anchor", F.col("next_resource").alias("resource"))
