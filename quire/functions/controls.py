"""Controls of decoded records as Column expressions: contents lines, topic headers, fonts, media headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def contents_entries(record: Column | str, nested: bool) -> Column:
    """Array of (nesting, style, id, title) of a record's contents lines; `nested` grammars give a nesting before the style.

    Lines that do not fit the grammar are left out; titles end at the next line.
    """
    parts = F.split(F.regexp_replace(_c(record), "(?i)(^|[ ?])CTOCE +", "\u0001"), "\u0001")
    shape = "^([0-9]+) +([0-9]+) +(\\S+) +(.*)$" if nested else "^()([0-9]+) +(\\S+) +(.*)$"
    lines = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.rlike(shape))
    group = lambda x, k: F.regexp_extract(x, shape, k)
    return F.transform(
        lines,
        lambda x: F.struct(
            group(x, 1).try_cast("int").alias("nesting"), group(x, 2).try_cast("int").alias("style"),
            T.toc_id(group(x, 3)).alias("id"), T.trim_ascii(group(x, 4)).alias("title"),
        ),
    )


def topic_id(record: Column | str) -> Column:
    """The id that a header record gives, folded; null if it opens no topic."""
    found = F.regexp_extract(_c(record), "(?i)(?:^|[ ,?])SH([^ ,?]+)", 1)
    return F.when(T.topic_header(record) & (found != ""), T.toc_id(found))


def topic_parent(record: Column | str) -> Column:
    """The parent that a header record names: empty if it names none after CPARENT, null if it has no CPARENT."""
    x = _c(record)
    found = F.regexp_extract(x, "(?i)CPARENT +\\??([^ ,?]*) *(?=CFORWARDLEVEL|CBACKLEVEL|CSUMMARY|CHDLEVEL|CSOURCEFN|ST |$)", 1)
    return F.when(x.rlike("(?i)(^|[ ,?])CPARENT( |$)"), T.toc_id(found))


def topic_number(record: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(record), "(?i)CTOPIC[N#] +([0-9]+)", 1), F.lit("")).try_cast("int")


def font_triples(operands: Column | str) -> Column:
    """Array of (column, length, code) of a font control's operands; null if a triple is incomplete or a length not positive."""
    split = F.filter(F.split(F.regexp_replace(F.trim(_c(operands)), ",$", ""), " +"), lambda x: x != "")

    def triples(parts: Column) -> Column:
        of = lambda i: F.struct(F.get(parts, i).try_cast("int").alias("column"), F.get(parts, i + 1).try_cast("int").alias("length"), F.get(parts, i + 2).alias("code"))
        whole = (F.size(parts) >= 3) & (F.size(parts) % 3 == 0)
        return F.when(whole, F.transform(F.filter(F.transform(parts, lambda x, i: i), lambda i: i % 3 == 0), of))

    fine = lambda t: F.forall(t, lambda x: x["column"].isNotNull() & F.coalesce(x["length"] > 0, F.lit(False)))
    return T.bound(T.bound(split, triples), lambda t: F.when(fine(t), t))


def font_definitions(control: Column | str) -> Column:
    """(code, style) of a font definition: a digit, an upper-case letter or an underscore, and its style's text; else null."""
    code, style = (F.regexp_extract(_c(control), "(?i)^cfontdef[ =]+([0-9A-Z_])[ ,]+(.+)$", k) for k in (1, 2))
    return F.when(code != "", F.struct(T.ascii_upper(code).alias("code"), F.trim(style).alias("style")))


def _le16(x: Column, at: int) -> Column:
    b = lambda k: F.conv(F.hex(F.substring(x, at + k, 1)), 16, 10).cast("int")
    return b(0) + b(1) * 256


def display_size(content: Column | str) -> Column:
    """(width, height) of a GIF or PNG from its header; null for anything else, or if a side is 0."""
    x = _c(content)
    head = F.hex(F.substring(x, 1, 8))
    gif = F.startswith(head, F.lit("474946383761")) | F.startswith(head, F.lit("474946383961"))
    png = (head == "89504E470D0A1A0A") & (F.hex(F.substring(x, 13, 4)) == "49484452")
    width = F.when(gif, _le16(x, 7)).when(png, T.be_int(x, 16, 4).cast("int"))
    height = F.when(gif, _le16(x, 9)).when(png, T.be_int(x, 20, 4).cast("int"))
    return F.when((width > 0) & (height > 0), F.struct(width.alias("width"), height.alias("height")))


def index_terms(record: Column | str) -> Column:
    """Array of (term, level, targets) of a record's index controls: `citerm`, a delimiter, then fields between delimiters."""
    raw = F.regexp_extract_all(_c(record), F.lit("(?i)citerm +(\\S)((?:(?!citerm ).)*)"), 0)

    def one(x: Column) -> Column:
        mark = F.regexp_extract(x, "(?i)citerm +(\\S)", 1)
        rest = F.regexp_replace(x, "(?i)^citerm +\\S", "")
        fields = F.transform(F.split(F.replace(rest, mark, F.lit("\u0001")), "\u0001"), lambda f: F.trim(f))
        targets = F.filter(F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(0))), lambda f: f != "")
        return F.struct(F.get(fields, F.lit(0)).alias("term"), F.get(fields, F.lit(1)).try_cast("int").alias("level"), targets.alias("targets"))

    return F.filter(F.transform(raw, one), lambda t: t["level"].isNotNull())
