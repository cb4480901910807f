"""Text functions as Column expressions: ASCII folding, trimming, titles, words, escapes, classifications.

All folding is ASCII-only and all expressions stay in the JVM.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

# The words of a title that stay in lower case, and the spellings that a title is given.
MINOR_WORDS = ("a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "with")
TITLE_MARKERS = ("<IMAGE>", "<INTERNET>", "<OTHER>", "<>")
TITLE_SPELLINGS = ("AS/400", "(TM)", "OfficeVision", "Cross-Reference", "OCL", "DBCS", "User ID")
CONTROL_SPELLINGS = ("AS/400", "(TM)", "OfficeVision", "Cross-Reference")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once a row, however often and within whatever lambda f names it; plans grow fast where this nests deep."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def ascii_lower(x: Column | str) -> Column:
    return F.translate(_c(x), UPPER, LOWER)


def ascii_upper(x: Column | str) -> Column:
    return F.translate(_c(x), LOWER, UPPER)


def equals_ci(a: Column | str, b: Column | str) -> Column:
    return ascii_lower(a) == ascii_lower(b)


def contains_ci(a: Column | str, b: Column | str) -> Column:
    return F.contains(ascii_lower(a), ascii_lower(b))


def starts_with_ci(a: Column | str, b: Column | str) -> Column:
    return F.startswith(ascii_lower(a), ascii_lower(b))


def replace_ci(x: Column | str, old: str, new: str) -> Column:
    """Every occurrence of `old`, whatever its ASCII case, from left to right without overlaps."""
    return F.regexp_replace(_c(x), "(?i)" + re.escape(old), new.replace("\\", "\\\\").replace("$", "\\$"))


def trim_right_spaces(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), " +$", "")


def _trim(x: Column | str, chars: str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(x), f"^[{chars}]+", ""), f"[{chars}]+\\z", "")


def trim_ascii_whitespace(x: Column | str) -> Column:
    return _trim(x, "\\x00-\\x20")


def trim_ascii(x: Column | str) -> Column:
    """White space and control bytes, and the question marks that stand for undecoded bytes."""
    return _trim(x, "\\x00-\\x20?")


def collapse_whitespace(x: Column | str) -> Column:
    return trim_ascii(F.regexp_replace(_c(x), "[ \\t\\n\\x0B\\f\\r]+", " "))


def capitalized(x: Column | str) -> Column:
    """ASCII letters at the start, or right after a space, colon, opening bracket or hyphen, in upper case; others unchanged."""
    chars = F.split(_c(x), "")
    starts = F.array(*(F.lit(c) for c in " :(-"))
    one = F.transform(
        chars, lambda c, i: F.when((i == 0) | F.array_contains(starts, F.try_element_at(chars, i)), ascii_upper(c)).otherwise(c)
    )
    return F.array_join(one, "")


def _spelled(x: Column, spellings: tuple[str, ...]) -> Column:
    for s in spellings:
        x = replace_ci(x, s, s)
    return x


def control_value(key: Column | str, value: Column | str) -> Column:
    """The value of a book control, in the form that its key asks for."""
    k, v = _c(key), _c(value)
    return (
        F.when(k == "CDOCNUM", ascii_upper(v))
        .when(k.isin("CTITLE", "CSTITLE"), _spelled(capitalized(v), CONTROL_SPELLINGS))
        .when(k == "CCOPYRIGHT", _spelled(v, ("IBM",)))
        .when(k == "CDATE", capitalized(v))
        .otherwise(v)
    )


def toc_title(x: Column | str) -> Column:
    """A contents title: markers and a detached last glyph go, words are capitalized, minor ones not but at the start."""
    v = _c(x)
    for m in TITLE_MARKERS:
        v = replace_ci(v, m, "")
    v = trim_ascii(v)
    v = trim_ascii(F.regexp_replace(v, "(?<=[ \\t\\n\\x0B\\f\\r])[()<>/\\-:=\"]\\z", ""))
    v = capitalized(v)
    for w in MINOR_WORDS:
        v = F.regexp_replace(v, f"(?i)(?<=[\\s\\-]){w}(?=[\\s\\-]|\\z)", w)
    return _spelled(v, TITLE_SPELLINGS)


def toc_id(x: Column | str) -> Column:
    return ascii_upper(x)


def _unglued(x: Column | str) -> Column:
    """Lower-cased text without the marks that glue a word's parts together."""
    return ascii_lower(F.regexp_replace(_c(x), "[*`\\\\]", ""))


def words(x: Column | str) -> Column:
    """Runs of ASCII letters and digits, folded; emphasis and code marks do not separate."""
    return F.regexp_extract_all(_unglued(x), F.lit("[0-9a-z]+"), 0)


def punctuation_units(x: Column | str) -> Column:
    """Words with the punctuation mark right behind them."""
    return F.regexp_extract_all(_unglued(x), F.lit("[0-9a-z]+[,.;:!)]"), 0)


def bytes_to_hex(x: Column | str) -> Column:
    return F.lower(F.hex(_c(x)))


def token_words_text(codes: Column | str) -> Column:
    """Code units as text: ASCII as it is, A0 a space, A1 to FF Latin-1, others a question mark."""
    one = lambda w: F.when(w <= 0x7E, F.chr(w)).when(w == 0xA0, " ").when(w.between(0xA1, 0xFF), F.chr(w)).otherwise("?")
    return F.array_join(F.transform(_c(codes), one), "")


def fold_words(codes: Column | str, upper: bool) -> Column:
    """Dictionary code units in upper or lower case by Latin-1's rules: sharp s becomes S, y with diaeresis stays, signs stay."""
    w_upper = lambda w: F.when(w.between(0x61, 0x7A) | (w.between(0xE0, 0xFE) & (w != 0xF7)), w - 0x20).when(w == 0xDF, 0x53).otherwise(w)
    w_lower = lambda w: F.when(w.between(0x41, 0x5A) | (w.between(0xC0, 0xDE) & (w != 0xD7)), w + 0x20).otherwise(w)
    return F.transform(_c(codes), w_upper if upper else w_lower)


def heading_depth(kind: Column | str) -> Column:
    """0 to 8 for :H1 to :H9; else 0."""
    d = F.regexp_extract(_c(kind), "^:[Hh]([1-9])$", 1)
    return F.when(d == "", 0).otherwise(F.coalesce(d.try_cast("int"), F.lit(1)) - 1)


def numbered_depth(topic_id: Column | str) -> Column:
    """Depth of a dotted numeric id, a last ".0" not counted; other ids are 0 deep."""
    x = _c(topic_id)
    core = F.regexp_replace(x, "\\.0$", "")
    return F.when(x.rlike("^[0-9]+(\\.[0-9]+)*$"), F.size(F.split(core, "\\.")) - 1).otherwise(0)


def topic_header(text: Column | str) -> Column:
    """Whether a record's text opens a topic."""
    x = ascii_lower(text)
    return x.rlike("(^|[ ,?])sh[^ ]") & (F.contains(x, F.lit("ctopicn")) | F.contains(x, F.lit("ctopic#")))


def contents_topic(text: Column | str) -> Column:
    x = ascii_lower(text)
    return F.contains(x, F.lit("shcontents")) | F.contains(x, F.lit("chdlevel :toc")) | F.contains(x, F.lit("ctocdef="))


def clean_snippet(x: Column | str) -> Column:
    """Link targets, escapes, emphasis and runs of space go, in that order."""
    v = F.regexp_replace(_c(x), "\\[([^\\]]+)\\]\\([^)]*\\)", "$1")
    v = F.regexp_replace(v, "\\\\(\\p{Punct})", "$1")
    v = F.regexp_replace(v, "[`*_#>]+", " ")
    return F.trim(F.regexp_replace(v, "\\s+", " "))


def html_escape(x: Column | str, attribute: bool = False) -> Column:
    v = F.replace(F.replace(F.replace(_c(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(v, F.lit('"'), F.lit("&quot;")) if attribute else v


def safe_href(url: Column | str) -> Column:
    """Whether a link's scheme is one that may be followed: none, http(s), ftp or mailto."""
    x = trim_ascii_whitespace(url)
    return ~x.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:") | ascii_lower(x).rlike("^(https?|ftp|mailto):")


def longest_backticks(x: Column | str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(_c(x), F.lit("`+"), 0), F.length)), F.lit(0))


def code_span(x: Column | str) -> Column:
    """Inline code, fenced by one backtick more than its longest run; padded where it starts or ends with one."""
    v = _c(x)
    fence = F.repeat(F.lit("`"), longest_backticks(v) + 1)
    pad = F.when(F.startswith(v, F.lit("`")) | F.endswith(v, F.lit("`")), " ").otherwise("")
    return F.concat(fence, pad, v, pad, fence)


def markdown_escape(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "([\\\\`*_{}\\[\\]<>#|])", "\\\\$1")


def media_type(stored_format: Column | str) -> Column:
    known = {"gif": "image/gif", "png": "image/png", "jpeg": "image/jpeg", "jpg": "image/jpeg", "bmp": "image/bmp"}
    f = ascii_lower(stored_format)
    out = F.lit("application/octet-stream")
    for k, v in known.items():
        out = F.when(f == k, v).otherwise(out)
    return out


def path_segment(x: Column | str) -> Column:
    """A decoded URL path segment; null if it is malformed, not UTF-8, a dot segment, or holds a slash, backslash or control byte."""
    v = F.try_url_decode(F.replace(_c(x), F.lit("+"), F.lit("%2B")))
    broken = F.contains(v, F.lit("\ufffd")) & ~F.contains(ascii_lower(x), F.lit("%ef%bf%bd")) & ~F.contains(_c(x), F.lit("\ufffd"))
    bad = v.rlike("[\\x00-\\x1f\\x7f/\\\\]") | v.isin(".", "..") | broken
    return F.when(~bad, v)


def query_parameters(x: Column | str) -> Column:
    """A map of a query string's names; null if a part has no "=", or a name comes twice."""
    parts = F.filter(F.split(_c(x), "&"), lambda p: F.lit(True))
    names = F.transform(parts, lambda p: F.substring_index(p, "=", 1))
    fine = F.forall(parts, lambda p: F.contains(p, F.lit("="))) & (F.size(F.array_distinct(names)) == F.size(names))
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.instr(p, F.lit("=")) + 1).alias("v")))
    return F.when(_c(x) == "", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).when(fine, F.map_from_entries(pairs))


def file_stem(x: Column | str) -> Column:
    """Lower-case letters and digits; other runs are one hyphen, none at an end."""
    v = F.regexp_replace(ascii_lower(x), "[^0-9a-z]+", "-")
    return F.regexp_replace(v, "^-+|-+$", "")


def short_hash(values: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of an array's compact JSON."""
    return F.substr(F.sha2(F.to_json(values), 256), F.lit(1), F.lit(16))


def tsv_unescape(x: Column | str) -> Column:
    """The four escapes of a report's fields; null if there is any other."""
    v = _c(x)
    odd = F.regexp_replace(v, "\\\\[\\\\trn]", "")
    marked = F.replace(v, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\t", "\t"), ("\\r", "\r"), ("\\n", "\n")):
        marked = F.replace(marked, F.lit(a), F.lit(b))
    return F.when(~F.contains(odd, F.lit("\\")), F.replace(marked, F.lit("\x00"), F.lit("\\")))


def tsv_escape(x: Column | str) -> Column:
    v = F.replace(_c(x), F.lit("\\"), F.lit("\\\\"))
    for a, b in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def be_int(content: Column | str, offset: Column | int, size: int) -> Column:
    """A big-endian unsigned integer of `size` bytes at a byte offset; null if it is outside the content."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    v = F.conv(F.hex(F.substring(_c(content), at + 1, size)), 16, 10).cast("long")
    return F.when((at >= 0) & (at <= F.length(_c(content)) - size), v)
