"""The grammar of controls, fonts, selectors and rows, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# The controls that are known by their whole opcode.
CONTROLS = {
    "ctopicn": "topic_number", "ctopic#": "topic_number", "cparent": "parent", "cforwardlevel": "forward_level", "cbacklevel": "back_level",
    "csummary": "summary", "chdlevel": "heading_level", "csourcefn": "source_file", "st": "title", "cfont": "font", "cselect": "select",
    "c.sp": "spacing", "c.rev": "revision_definition", "cz": "layout_directive", "cmenu": "menu_start", "cmitem": "menu_item",
    "cemenu": "menu_end", "srmsg": "message_start", "csart": "art_start", "ceart": "art_end", "csartdesc": "art_description_start",
    "cartdesc": "art_description", "ceartdesc": "art_description_end",
}
# How many operands follow an opcode, where any do.
OPERANDS = {
    "topic_number": 1, "parent": 1, "forward_level": 1, "back_level": 1, "heading_level": 1, "source_file": 1, "menu_item": 1, "message_start": 1,
    "art_description_start": 1, "revision_definition": 2, "summary": 3, "select": 3,
}
# The style of a font code, of codes whose case counts and of the others.
EXACT_STYLES = {
    "1": "hp1", "2": "hp2", "3": "hp3", "5": "hp5", "6": "hp6", "7": "hp7", "8": "hp8", "9": "hp9", "_": "underscore",
    "B": "bold", "D": "bold", "F": "bold", "O": "bold", "T": "bold", "Y": "bold",
}
STYLES = {
    "0": "italic", "4": "xph", "a": "apl", "c": "cit", "e": "xmp", "g": "warningtext", "h": "bold", "i": "bold", "j": "bold", "k": "italic",
    "l": "italic", "m": "bold", "p": "pk", "q": "pkdef", "r": "bold", "v": "pv", "w": "warning", "x": "xph", "z": "pvdef",
}
# Marks that open a list item, and those that decoded lines leave behind.
BULLETS = ("o", "-", "*", "°", "•")
LINE_MARKS = "$;()*!\\-':="
SPACE = "[ \\t\\n\\x0B\\f\\r]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _found(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def control_kind(opcode: Column | str) -> Column:
    """The kind of control that a word opens; "text" if none.

    The stop that an empty operand leaves behind a C control is not part of it.
    Topic starts are SH and a digit, tables SRTBL... and SRETBL..., and any other
    word of SR and letters, digits or underscores is structural.
    """
    x = T.ascii_lower(opcode)
    bare = F.when(x.rlike("^c.+\\.\\z") & (x != "c."), F.regexp_replace(x, "\\.\\z", "")).otherwise(x)
    return (
        F.when(x.rlike("^sh[0-9]"), "topic_start")
        .when(_found(CONTROLS, bare).isNotNull(), _found(CONTROLS, bare))
        .when(F.startswith(x, F.lit("srtbl")), "table_start")
        .when(F.startswith(x, F.lit("sretbl")), "table_end")
        .when(x.rlike("^sr[a-z0-9_]+\\z"), "structural")
        .otherwise("text")
    )


def operand_count(kind: Column | str) -> Column:
    return F.coalesce(_found(OPERANDS, _c(kind)), F.lit(0))


def control_segments(record: Column | str) -> Column:
    """Array of (kind, opcode, operands, payload) of a record's words: each control with its fixed operands and what follows it.

    Words before the first control are a segment of kind "text"; a word among the
    operands of a control opens none.  A null record has none.
    """
    none = F.array().cast("array<struct<at:int,kind:string>>")
    last = lambda acc: F.try_element_at(acc, F.lit(-1))

    def openings(words: Column) -> Column:
        marked = F.transform(words, lambda w, i: F.struct(i.alias("at"), control_kind(w).alias("kind")))
        kept = F.aggregate(
            F.filter(marked, lambda m: m["kind"] != "text"), none,
            lambda acc, m: F.when(F.coalesce(m["at"] - last(acc)["at"] <= operand_count(last(acc)["kind"]), F.lit(False)), acc).otherwise(F.concat(acc, F.array(m))),
        )
        # Words before the first control follow one at -1.
        lead = F.array(F.struct(F.lit(-1).alias("at"), F.lit("text").alias("kind")))
        return F.filter(F.concat(lead, kept), lambda m, i: (i > 0) | ((F.size(words) > 0) & (control_kind(F.get(words, F.lit(0))) == "text")))

    def segments(words: Column, starts: Column) -> Column:
        def segment(m: Column, i: Column) -> Column:
            end = F.coalesce(F.get(starts, i + 1)["at"], F.size(words))
            n = F.least(operand_count(m["kind"]), end - m["at"] - 1)
            piece = lambda lo, size: F.array_join(F.slice(words, lo + 1, F.greatest(size, F.lit(0))), " ")
            return F.struct(
                m["kind"].alias("kind"), F.when(m["at"] >= 0, F.get(words, m["at"])).alias("opcode"),
                F.slice(words, m["at"] + 2, n).alias("operands"), piece(m["at"] + 1 + n, end - m["at"] - 1 - n).alias("payload"),
            )

        return F.transform(starts, segment)

    split = F.filter(F.split(_c(record), f"{SPACE}+"), lambda w: w != "")
    return T.bound(split, lambda words: T.bound(openings(words), lambda starts: segments(words, starts)))


def font_style(code: Column | str) -> Column:
    """The style of a font code; "unknown" for others."""
    x = _c(code)
    return F.coalesce(_found(EXACT_STYLES, x), _found(STYLES, T.ascii_lower(x)), F.lit("unknown"))


def selector_link(alternatives: Column | str) -> Column:
    """struct(kind, destination, image, error) of a link selector's six or seven bracketed alternatives."""
    a = _c(alternatives)
    inner = F.transform(a, lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
    kind, anchor, named, fourth = T.ascii_lower(F.get(inner, F.lit(0))), F.get(inner, F.lit(1)), F.get(inner, F.lit(2)), F.get(inner, F.lit(3))
    to = lambda prefix: F.concat(F.lit("DOCNUM/"), fourth, F.lit("/"), prefix, anchor)
    image = F.when(named == "", fourth).otherwise(named)
    web = image.rlike("^(?i)(https?://|ftp://|mailto:|/)")
    odd = F.filter(a, lambda x: ~x.rlike("(?s)^<.*>\\z"))
    in_book = kind.isin("hdr", "spt", "fig", "tbl", "figure")
    outside = kind.isin("other", "internet", "image")
    error = (
        F.when(~F.size(a).between(6, 7), "not six or seven alternatives")
        .when(F.size(odd) > 0, "an alternative is not bracketed")
        .when((kind == "book") & (fourth == ""), "no document number")
        .when(in_book & ((fourth == "") | (anchor == "")), "no document number or anchor")
        .when(outside & (fourth == ""), "no external target")
        .when((kind == "image") & ~web, "no image address")
        .when(~(in_book | outside | (kind == "book")), "unknown kind")
    )
    name = F.when(kind == "book", "book_contents").when(kind == "hdr", "book_heading").when(kind == "spt", "book_spot").when(kind == "image", "external_image").when(outside, "external_link").otherwise("book_anchor")
    destination = F.when(kind == "book", F.concat(F.lit("DOCNUM/"), fourth, F.lit("/CCONTENTS"))).when(in_book, to(F.upper(kind))).otherwise(fourth)
    fine = error.isNull()
    return F.struct(F.when(fine, name).alias("kind"), F.when(fine, destination).alias("destination"), F.when(fine & (kind == "image"), image).alias("image"), error.alias("error"))


def list_item_row(row: Column | str) -> Column:
    """Whether a row opens a list item: a bullet, or a letter or up to three digits with a stop or bracket, and then more text."""
    bullets = "|".join(f"\\Q{b}\\E" for b in BULLETS)
    return _c(row).rlike(f"^{SPACE}*({bullets}|[A-Za-z][.)]|[0-9]{{1,3}}[.)]){SPACE}+[^ \\t\\n\\x0B\\f\\r]")


# The features of a topic's body in the order in which a signature lists them, and the class of a body with just one.
FEATURES = {
    "lists": "prose + lists", "tables": "contains fixed rows/tables", "selectors": "contains selectors/cross-references",
    "figures": "contains figures/images", "menu": "menu", "messages": "messages",
}
GENERATED = ((":toc", ":figlist", ":tlist"), ("contents", "index", "figures", "tables"), "generated (TOC/INDEX/FIGURES/TABLES)")
FRONT = ((":cover", ":title", ":tipage", ":vnotice", ":notices", ":edition"), ("cover", "edition", "notices"), "title/edition front matter")


def structure_signature(**counts: Column) -> Column:
    """The features whose count is above zero, joined by "+"; "prose" without any."""
    has = F.array_compact(F.array(*(F.when(counts[f] > 0, f) for f in FEATURES)))
    return F.when(F.size(has) > 0, F.array_join(has, "+")).otherwise("prose")


def structure_class(topic_id: Column | str, heading: Column | str, rows: Column, signature: Column) -> Column:
    """Generated topics, then front matter, then by the features of the body; two features or more are mixed."""
    name, kind = T.ascii_lower(topic_id), F.coalesce(T.ascii_lower(heading), F.lit(""))
    out = F.when(rows == 0, "title only (no body rows)").when(signature == "prose", "heading + prose paragraphs only")
    for feature, label in FEATURES.items():
        out = out.when(signature == feature, label)
    out = out.otherwise("mixed")
    for kinds, names, label in (FRONT, GENERATED):
        out = F.when(kind.isin(*kinds) | F.coalesce(name.isin(*names), F.lit(False)), label).otherwise(out)
    return out


def without_line_marks(x: Column | str) -> Column:
    """Text without what decoded lines leave behind: selector and heading marks, fillers of slashes, and marks before an indent."""
    v = F.regexp_replace(
        _c(x),
        f"(?i)<IMAGE>|<INTERNET>|<OTHER>|<>|:h[1-6](?={SPACE})|/+{SPACE}{{2,}}|(?:^|(?<={SPACE}))[{LINE_MARKS}](?:{SPACE}{{2,}}|\\z)",
        "\u0001",
    )
    v = F.regexp_replace(F.regexp_replace(v, "^\u0001+", ""), "(?<=[ \u0001])\u0001", "")
    return F.replace(v, F.lit("\u0001"), F.lit(" "))


def dot_text(x: Column | str) -> Column:
    """A decoded line as text: marks and separators go, but for a question mark at its end."""
    v = T.trim_ascii_whitespace(without_line_marks(x))
    v = F.regexp_replace(v, "([A-Za-z0-9)]\\?)\\?\\z", "$1")
    v = F.regexp_replace(v, "\\?(?!\\z)", " ")
    return F.trim(F.regexp_replace(v, f"{SPACE}+", " "))


def literal_question_marks(x: Column | str) -> Column:
    """How many question marks of a decoded text are its own, not separators.

    They stand behind a letter, a digit, a closing bracket or a quote, and before the
    end, another question mark, or what is neither a small letter nor a control.
    """
    own = f"(?<=[A-Za-z0-9)\"'])\\?(?=({SPACE}*(\\z|[?]|(?!(?-i:[a-z])|:[A-Za-z])[^ \\t\\n\\x0B\\f\\r])))"
    return F.regexp_count(_c(x), F.lit(own))


def occurrences(x: Column | str, needle: str) -> Column:
    """The places (from 1) of a needle in a text, without ASCII case, from left to right without overlaps; none of an empty one."""
    if not needle:
        return F.array().cast("array<int>")
    parts = F.split(T.ascii_lower(x), "\\Q" + "".join(c.lower() if c.isascii() else c for c in needle) + "\\E")
    found = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, p: F.struct((acc["at"] + F.length(p) + len(needle)).alias("at"), F.concat(acc["all"], F.array(acc["at"] + F.length(p))).alias("all")),
    )
    return found["all"]


def uri_encoded(x: Column | str) -> Column:
    """Percent-encoded UTF-8, all but letters, digits and -._~"""
    return F.replace(F.replace(F.replace(F.url_encode(_c(x)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def base64_decoded(x: Column | str) -> Column:
    """The bytes of canonical base64; null for anything else."""
    v = F.try_to_binary(_c(x), F.lit("base64"))
    return F.when(F.base64(v) == _c(x), v)


def resource_uri(scheme: str, *parts: Column) -> Column:
    """scheme://shelf/... of encoded path parts."""
    return F.concat(F.lit(f"{scheme}://shelf"), *(F.concat(F.lit("/"), uri_encoded(p)) for p in parts))


def resource_parts(uri: Column | str, scheme: str) -> Column:
    """The decoded path parts of a resource URI; null if it is none, or a part is empty or malformed."""
    head = f"{scheme}://shelf/"
    parts = F.transform(F.split(F.substr(_c(uri), F.lit(len(head) + 1)), "/"), T.path_segment)
    fine = F.startswith(_c(uri), F.lit(head)) & F.forall(parts, lambda p: F.coalesce(p != "", F.lit(False)))
    return F.when(fine, parts)


def cache_key(*fields: Column) -> Column:
    """A digest of some texts, each behind its length in bytes, so that no two lists of texts share one by shifting a border."""
    sized = (F.concat(F.octet_length(f).cast("string"), F.lit(":"), f) for f in (F.coalesce(f.cast("string"), F.lit("")) for f in fields))
    return F.sha1(F.concat(*sized))


def not_modified(if_none_match: Column | str, identity: Column | str) -> Column:
    """Whether a conditional request's weak tags hold that of an identity."""
    tags = F.transform(F.split(_c(if_none_match), ","), lambda t: F.regexp_replace(F.trim(t), "^W/", ""))
    return F.coalesce((F.trim(_c(if_none_match)) == "*") | F.array_contains(tags, F.concat(F.lit('"'), _c(identity), F.lit('"'))), F.lit(False))


def identified_heading(topic_id: Column | str, title: Column | str, plain: Column | None = None) -> Column:
    """A heading with its topic's id in front, unless there is none or a plain title spells it, ignoring ASCII case; the id alone without a title."""
    i, t = F.coalesce(_c(topic_id), F.lit("")), F.coalesce(_c(title), F.lit(""))
    spelled = (F.lit(True) if plain is None else plain) & T.equals_ci(T.trim_ascii(t), i)
    return F.when((i == "") | spelled, t).when(t == "", i).otherwise(F.concat(i, F.lit(" "), t))
