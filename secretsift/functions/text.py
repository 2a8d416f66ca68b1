"""Text helpers as Spark column expressions."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

# Characters str.strip() removes in Python.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex character class body, for Java regexes.
WHITESPACE_CLASS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column, chars: str = WHITESPACE) -> Column:
    """Trim a fixed set of characters at both ends."""
    return F.btrim(c, F.lit(chars))


def all_matches(c: Column, regex: str, group: int = 0) -> Column:
    """Every match of ``regex`` in ``c``, left to right."""
    return F.regexp_extract_all(c, F.lit(regex), F.lit(group))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, whatever filters follow.

    A filter on a plain column is copied below the projection that makes it, and
    the work is done again there. Rows of a generator are final instead.
    """
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(made))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use ``value`` several times in ``body`` but compute it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Named references without their semicolon, the usual ones first.
_USUAL = ["amp", "lt", "gt", "quot", "apos", "nbsp"]
_NAMES = _USUAL + [n[:-1] for n in html5 if n.endswith(";") and n[:-1] not in _USUAL]
# The table as one text, ``<name>=<characters>`` between separators.
_SEPARATOR = "\x01"
_ENTITIES = _SEPARATOR + "".join(f"{n}={html5[n + ';']}{_SEPARATOR}" for n in _NAMES)
# References that browsers also accept without a semicolon; longest name first,
# because "notin" must win over "not".
_BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)

_NUMERIC = r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"
_NAMED = r"^[^\t\n\f <&#;\x01=]{1,32};"


def _windows_1252() -> dict[int, str]:
    """Numeric references to these control codes mean Windows characters."""
    out = {}
    for code in range(0x80, 0xA0):
        try:
            out[code] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            out[code] = chr(code)
    return out


def _character(code: Column) -> Column:
    """Code point to character by the HTML rules for numeric references."""
    low = F.create_map(*[F.lit(x) for kv in _windows_1252().items() for x in kv])
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    dropped = (
        code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd"))
        .when(code.between(0x80, 0x9F), F.try_element_at(low, code.cast("int")))
        .when(dropped, F.lit(""))
        .otherwise(plain)
    )


def _code_point(numeric: Column) -> Column:
    """Number of a numeric reference; anything too long is out of range."""
    is_hex = F.rlike(numeric, F.lit("^#[xX]"))
    digits = F.regexp_extract(numeric, r"^#[xX]?0*([0-9a-fA-F]*)", 1)

    def number(text: Column) -> Column:
        base16 = F.conv(text, 16, 10).cast("long")
        value = F.when(is_hex, base16).otherwise(text.cast("long"))
        return F.when(text == "", F.lit(0)).when(F.length(text) > 7, F.lit(0x110000)).otherwise(value)

    return let(digits, number)


def _characters_of(name: Column) -> Column:
    """Characters of a named reference, null for an unknown name."""
    key = F.concat(F.lit(_SEPARATOR), name, F.lit("="))

    def found(place: Column) -> Column:
        rest = F.substr(F.lit(_ENTITIES), place + F.length(key), F.lit(8))
        return F.when(place > 0, F.substring_index(rest, _SEPARATOR, 1))

    return let(F.instr(F.lit(_ENTITIES), key), found)


def _decode_reference(piece: Column) -> Column:
    """``piece`` is the text right after an ampersand."""
    rest = lambda head: F.substr(piece, F.length(head) + F.lit(1))
    as_is = F.concat(F.lit("&"), piece)

    def numeric(head: Column) -> Column:
        return F.when(head == "", as_is).otherwise(
            F.concat(let(_code_point(head), _character), rest(head))
        )

    def bare(head: Column) -> Column:
        return F.when(head == "", as_is).otherwise(F.concat(_characters_of(head), rest(head)))

    def named(head: Column) -> Column:
        text = let(
            F.when(head != "", _characters_of(F.rtrim(head, F.lit(";")))),
            lambda known: F.concat(known, rest(head)),
        )
        no_semicolon = F.regexp_extract(piece, "^(?:" + "|".join(_BARE_NAMES) + ")", 0)
        return F.coalesce(text, let(no_semicolon, bare))

    is_numeric = F.startswith(piece, F.lit("#"))
    return (
        F.when(is_numeric, let(F.regexp_extract(piece, _NUMERIC, 0), numeric))
        .when(F.startswith(piece, F.lit("amp;")), F.concat(F.lit("&"), F.substring(piece, 5, 1 << 30)))
        .otherwise(let(F.regexp_extract(piece, _NAMED, 0), named))
    )


def unescape_html(c: Column) -> Column:
    """Decode HTML character references; text without ``&`` is left alone at once."""
    decoded = F.transform(
        F.split(c, "&", -1),
        lambda piece, i: F.when(i == 0, piece).otherwise(_decode_reference(piece)),
    )
    return F.when(F.contains(c, F.lit("&")), F.array_join(decoded, "")).otherwise(c)


def strip_tags(c: Column) -> Column:
    """Text of a small HTML fragment."""
    return unescape_html(F.regexp_replace(c, r"<[^>]*>", ""))
