"""Text expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def filled(column: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(column, F.lit(""))


def normal_title(title: Column) -> Column:
    """Lower case, white space collapsed to single spaces and cut off at both ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(title, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""

    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), lambda chars: F.when(F.size(chars) == 0, F.lit(0.0)).otherwise(of(chars)))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_markdown(text: Column) -> Column:
    for raw in "\\`*_[]<>|#":
        text = F.replace(text, F.lit(raw), F.lit("\\" + raw))
    return text


def escape_stix(text: Column) -> Column:
    for raw in "\\']":
        text = F.replace(text, F.lit(raw), F.lit("\\" + raw))
    return text


def name_uuid(namespace: str, name: Column) -> Column:
    """Version-5 UUID of a name, from the SHA-1 of the namespace's bytes and the name's."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda start, n: F.substring(digest, start, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
