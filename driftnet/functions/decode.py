"""Decoded views of a text: base64, escapes, percent and entities, as Columns.

A view is null where nothing decodes.  Each replaces the encoded runs in place,
by splitting the text at the runs and joining it again with what they decode to.
Texts of any length are decoded.
"""

from __future__ import annotations

import html
import string
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# A run of base64 letters; longer runs than a regular expression repeats are taken as one.
# (The class is spelled out: the JVM looks single characters up in a bit set, ranges one by one.)
_LETTER = "[" + string.ascii_letters + string.digits + r"+/_\-]"
_RUN = _LETTER + "{20,8192}={0,2}"


def _replaced(text: Column, pattern: str, decoded: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` replaced by ``decoded(match)`` (kept where null)."""
    between = F.split(text, pattern, -1)
    inside = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.coalesce(decoded(m), m))
    joined = F.zip_with(between, inside, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(joined, "")


def _base64_run(run: Column) -> Column:
    body = F.regexp_replace(run, "=+$", "")
    plain = F.when(body.rlike(r"^[A-Za-z0-9+/]+$"), body).when(body.rlike(r"^[A-Za-z0-9_\-]+$"), F.translate(body, "-_", "+/"))
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int")))
    data = F.try_to_binary(padded, F.lit("base64"))
    latin = F.decode(data, "ISO-8859-1")
    printable = F.length(F.regexp_replace(latin, r"[^\x20-\x7e\t\n\r]", "")) / F.length(latin)
    return F.when((F.length(body) >= 20) & (F.length(latin) >= 8) & (printable >= 0.9), F.decode(F.when(F.is_valid_utf8(data.cast("string")), data), "UTF-8"))


def base64_view(text: Column) -> Column:
    return _changed(text, F.when(text.rlike(_LETTER + "{20}"), _replaced(text, _RUN, _base64_run)))


def _code(hexa: Column) -> Column:
    """The character of two hex digits, from a table: CHAR of 128 and more is one character too."""
    return F.decode(F.unhex(hexa), "ISO-8859-1")


def escape_view(text: Column) -> Column:
    r"""``\u00HH`` and ``\xHH`` as characters."""
    once = _replaced(text, r"\\[uU]00[0-9a-fA-F]{2}", lambda m: _code(F.substring(m, -2, 2)))
    return _changed(text, F.when(text.rlike(r"\\[uUx]"), _replaced(once, r"\\x[0-9a-fA-F]{2}", lambda m: _code(F.substring(m, -2, 2)))))


def percent_view(text: Column) -> Column:
    """``%HH`` as single characters (Latin-1, not UTF-8, and no plus signs)."""
    return _changed(text, F.when(F.contains(text, F.lit("%")), _replaced(text, "%[0-9a-fA-F]{2}", lambda m: _code(F.substring(m, 2, 2)))))


def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else html.unescape(t))


def entity_view(text: Column) -> Column:
    """Character references as characters; only texts that hold one leave the JVM."""
    return _changed(text, F.pandas_udf(_unescape, "string")(F.when(text.rlike(r"&(?:#x?[0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,31});"), text)))


def _changed(text: Column, view: Column) -> Column:
    return F.when(view != text, view)


# In this order a value found twice is kept once.
VIEWS: tuple[tuple[str, Callable[[Column], Column]], ...] = (("base64", base64_view), ("unicode-escape", escape_view), ("percent", percent_view), ("html-entity", entity_view))


def views(text: Column) -> Column:
    """All decoded views as an array of (view_ord, label, text)."""
    made = [F.struct(F.lit(i).alias("view_ord"), F.lit(label).alias("label"), view(text).alias("text")) for i, (label, view) in enumerate(VIEWS, 1)]
    return F.filter(F.array(*made), lambda v: v["text"].isNotNull())
