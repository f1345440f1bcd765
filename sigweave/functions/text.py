"""Text and number helpers.  All are native expressions, so they stay inside codegen."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

# What the data model counts as whitespace: ASCII whitespace, every Unicode space,
# line and paragraph separator, and the byte-order mark.  Java's \s is ASCII only and Spark's trim
# removes only U+0020.  The class means the same in Java and in RE2; the characters are its members.
WHITESPACE = r"[\s\x0B\p{Z}\x{feff}]"
WHITESPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# What may not touch an alias on either side.
WORD_CHAR = "[a-z0-9]"


def trim_all(col: Column) -> Column:
    """Strip every kind of whitespace from both ends."""
    return F.btrim(col, F.lit(WHITESPACE_CHARS))


def collapse(col: Column) -> Column:
    """Runs of two or more whitespace characters become one space; then trim."""
    return trim_all(F.regexp_replace(col, WHITESPACE + "{2,}", " "))


def _decode(col: Column, entities: list[tuple[str, str]]) -> Column:
    for entity, text in entities:
        col = F.replace(col, F.lit(entity), F.lit(text))
    return col


def strip_html(col: Column, mode: str = "full") -> Column:
    """Markup to text.  Fixed values: the steps, their order and the four entities define the result.

    ``full`` removes style and script elements, replaces tags by a space, decodes four entities
    in a fixed order and blanks numeric ones.  ``short`` keeps style and script text and decodes
    only ``&amp;`` and ``&nbsp;``.
    """
    if mode not in ("full", "short"):
        raise ValueError(f"mode must be 'full' or 'short', not {mode!r}")
    if mode == "full":
        for element in ("style", "script"):
            col = F.regexp_replace(col, rf"(?is)<{element}[^>]*>.*?</{element}>", "")
    col = F.regexp_replace(col, "<[^>]+>", " ")
    if mode == "full":
        # &amp; goes first, so "&amp;lt;" ends as "<".
        col = _decode(col, [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")])
        col = F.regexp_replace(col, "&#[0-9]+;", " ")
    else:
        col = _decode(col, [("&amp;", "&"), ("&nbsp;", " ")])
    return collapse(col)


_NAMED = r"[A-Za-z][A-Za-z0-9]{1,31}"
_NUMBERED = r"#[0-9]+;?|#[xX][0-9A-Fa-f]+;?"
# In an address "&copy=1" and "&copyright" are parameters; a name needs its semicolon there or an end.
_REFERENCE = {
    False: f"&(?:{_NUMBERED}|{_NAMED};?)",
    True: f"&(?:{_NUMBERED}|{_NAMED}(?:;|(?![=A-Za-z0-9])))",
}
#: A browser reads a NUL as U+FFFD, so no text holds one that is not ours.
_MARK, _UNKNOWN = "\x00", "\ufffd"
#: What Windows-1252 has at 0x80 to 0x9F; browsers read references to these numbers so.
_WINDOWS = {str(i): bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)}


def _names() -> Column:
    """The named references of HTML with their texts, one constant."""
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def _numbered(reference: Column) -> Column:
    digits = F.regexp_extract(reference, r"#[xX]?0*([0-9A-Fa-f]*)", 1)
    base = F.when(reference.rlike("^&#[xX]"), 16).otherwise(10)
    code = F.when(F.length(digits) > 7, F.lit(0x110000)).when(base == 16, F.conv(digits, 16, 10).cast("long")).otherwise(
        F.try_to_number(digits, F.lit("9999999")).cast("long")
    )
    code = F.coalesce(code, F.lit(0))
    windows = F.from_json(F.lit(json.dumps(_WINDOWS)), "map<string,string>")
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
    no_character = code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), _UNKNOWN)
        .when(code.between(0x80, 0x9F), F.try_element_at(windows, code.cast("string")))
        .when(control | no_character, "")
        .otherwise(text)
    )


def decode_entities(col: Column, attribute: bool = False) -> Column:
    """Character references as HTML defines them: named ones, numbers, and the old names that need no semicolon.

    Nothing decodes twice.  With ``attribute`` a name without a semicolon stays where a letter, a digit
    or ``=`` follows, as in the parameters of an address.
    """
    marked = F.regexp_replace(F.replace(col, F.lit(_MARK), F.lit(_UNKNOWN)), _REFERENCE[attribute], f"{_MARK}$0{_MARK}")
    old = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))

    def read(reference: Column) -> Column:
        name = F.substring(reference, 2, 40)
        whole = F.try_element_at(_names(), name)
        if attribute:
            return F.coalesce(whole, reference)
        start = F.regexp_extract(name, rf"\A(?:{old})", 0)
        rest = F.substr(name, F.length(start) + 1)
        return F.coalesce(whole, F.concat(F.try_element_at(_names(), start), rest), reference)

    def piece(text: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, text).when(text.startswith("&#"), _numbered(text)).otherwise(read(text))

    return F.when(col.contains("&"), F.array_join(F.transform(F.split(marked, _MARK, -1), piece), "")).otherwise(col)


def posting_text(title: Column, description: Column) -> Column:
    """The text that is searched for technologies: title, a space, description."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))


def round2(col: Column) -> Column:
    """Half-up rounding to two places on the binary value (0.145 * 100 is 14.499..., so 0.14)."""
    return F.floor(col * 100 + F.lit(0.5)) / 100


def round4(col: Column) -> Column:
    """Confidence sums are kept at four places, so 0.7 + 0.05 * 2 compares as 0.8."""
    return F.round(col, 4)


def valid_domain(col: Column) -> Column:
    """Length 3 to 253 and the shape of a host name (fixed values); compared in lower case."""
    return F.length(col).between(3, 253) & col.rlike(
        r"\A[a-zA-Z0-9][a-zA-Z0-9\-.]+\.[a-zA-Z]{2,}\z"
    )


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def null_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def key_hash(col: Column) -> Column:
    """How an API key is stored: the SHA-256 of the raw key in hex."""
    return F.sha2(col, 256)


def encode_component(col: Column) -> Column:
    """Percent-encoding of a URL component, which leaves ``!'()*~`` alone and writes a space as ``%20``."""
    return _decode(
        F.url_encode(col),
        [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*"),
         ("%7E", "~")],
    )
