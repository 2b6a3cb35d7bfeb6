"""Plain text of markup: tags off, character references decoded, all in built-in functions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Characters of names, of Python's table; a space that does not break is a space, as in the tables since the first load.
NAMED = {name: chr(point) for name, point in name2codepoint.items()} | {"nbsp": " ", "apos": "'"}
#: Where the standard sends references that name no character.
UNKNOWN = 0xFFFD


def _character(point: Column) -> Column:
    """The character of a code point."""
    bad = (point > 0x10FFFF) | point.between(0xD800, 0xDFFF) | (point == 0)
    safe = F.when(bad, F.lit(UNKNOWN)).otherwise(point)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def _decoded(reference: Column) -> Column:
    """What one reference stands for; an unknown name stays as it is."""
    body = F.substring(reference, F.lit(2), F.length(reference) - 2)
    names = F.map_from_arrays(F.lit(list(NAMED)), F.lit(list(NAMED.values())))
    return (
        F.when(F.lower(body).startswith("#x"), _character(F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10).cast("int")))
        .when(body.startswith("#"), _character(F.substring(body, F.lit(2), F.length(body)).cast("int")))
        .otherwise(F.coalesce(F.try_element_at(names, body), reference))
    )


def decode_references(text: Column) -> Column:
    """Decimal, hexadecimal and named references in one pass, so that what a reference makes is never read as another."""
    between = F.split(text, REFERENCE, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _decoded)
    joined = F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def plain_text(markup: Column) -> Column:
    return decode_references(F.regexp_replace(markup, "<[^>]*>", ""))


def first_element(markup: Column, tag: str, css: str | None = None) -> Column:
    """Plain text of the first element of a tag (and class); NULL when there is none."""
    named = rf"""[^>]*class=["'][^"']*\b{css}\b[^"']*["']""" if css else ""
    found = F.regexp_extract_all(markup, F.lit(rf"(?s)<{tag}\b{named}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return plain_text(F.get(found, F.lit(0)))
