"""Text expressions: whitespace, numbers, words, paragraph text."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

# Every character that counts as white space, as a list for trimming and as a
# regex class body. The class reads the same in Java and in RE2.
SPACE_CODES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
SPACE_CHARS = "".join(map(chr, SPACE_CODES))
SPACE_CLASS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
PADDED_DECIMAL = f"[ \\t-\\r]*{DECIMAL}[ \\t-\\r]*"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.btrim(F.regexp_replace(c, f"[{SPACE_CLASS}]+", " "), F.lit(" "))


def squeezed_words(c: Column) -> Column:
    """Number of words in text that is already squeezed."""
    blanks = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(c == "", F.lit(0)).otherwise(blanks + 1).cast("long")


def word_count(c: Column) -> Column:
    """Number of words, cut at any white space."""
    pieces = F.split(F.coalesce(c, F.lit("")), f"[{SPACE_CLASS}]+")
    return F.size(F.array_remove(pieces, "")).cast("long")


# Names of characters in markup: the standard's table as Python's own library has it.
ENTITIES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}


def undo_entities(c: Column) -> Column:
    """``&name;``, ``&#n;`` and ``&#xh;`` as the characters they stand for, once each.

    Unknown names stay as they are; numbers that are no character give U+FFFD.
    """
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def character(code: Column) -> Column:
        good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        points = F.lpad(F.hex(F.when(good, code).otherwise(F.lit(0xFFFD))), 8, "0")
        return F.decode(F.unhex(points), "UTF-32")

    def named(value: Column, use: Callable[[Column], Column]) -> Column:
        """``use(value)`` with the value worked out once, however often it is mentioned."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def meaning(name: Column) -> Column:
        number = F.when(F.startswith(F.lower(name), F.lit("#x")), F.conv(F.substr(name, F.lit(3)), 16, 10)) \
            .otherwise(F.substr(name, F.lit(2))).cast("long")
        return F.when(F.startswith(name, F.lit("#")), character(number)).otherwise(F.try_element_at(names, name))

    def undone(part: Column) -> Column:
        whole = F.concat(F.lit("&"), part)
        found = F.regexp_extract(part, r"^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        return named(found, lambda name: F.when(name == "", whole).otherwise(named(
            meaning(name), lambda char: F.when(char.isNull(), whole).otherwise(
                F.concat(char, F.substr(part, F.length(name) + 2))))))

    def all_undone(text: Column) -> Column:
        return F.array_join(F.transform(
            F.split(text, "&", -1), lambda part, i: F.when(i == 0, part).otherwise(undone(part))), "")

    return named(c, lambda text: F.when(F.contains(text, F.lit("&")), all_undone(text)).otherwise(text))


HIDDEN_MARKUP = (
    r"(?is)<script[ \t\n\r\f>].*?(?:</script[^>]*>|\z)"
    r"|<style[ \t\n\r\f>].*?(?:</style[^>]*>|\z)|<!--.*?(?:-->|\z)"
)
BETWEEN_PARAGRAPHS = r"(?is)</p[ \t\n\r\f]*>.*?(<p[ \t\n\r\f>/]|\z)"
TAG = r"</?[a-zA-Z][^>]*>|<[!?][^>]*>"


def paragraph_text(html: Column) -> Column:
    """Text of all ``<p>`` elements, joined by blanks.

    Scripts, styles and comments go first, so that markup inside them is not
    seen. Then everything from a paragraph's end to the next paragraph's start
    goes; a closing tag put in front makes the page head such a gap. A
    paragraph left open runs to the next one and so counts once.
    """
    page = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN_MARKUP, " ")
    inside = F.regexp_replace(F.concat(F.lit("</p>"), page), BETWEEN_PARAGRAPHS, " $1")
    plain = F.regexp_replace(inside, TAG, " ")
    return squeeze(undo_entities(plain))
