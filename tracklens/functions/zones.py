"""Parsing of the ``zones_hit`` text column.

The column holds NULL, blank text, a bare zone name or a JSON array of
names.  Two rules exist and differ on purpose:

* ``zones_loader`` (per-track zone sets, map points): strip, JSON array when
  it starts with '[' (malformed JSON -> the raw text as one zone), bare
  text -> one zone, NULL/blank -> empty.  Array elements are not trimmed;
  JSON null elements are dropped.
* ``zones_sql`` (zone statistics): JSON array when the stripped text starts
  with '[' (malformed -> nothing), bare text -> itself; every element is
  then trimmed and NULL/blank elements are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ARRAY = "array<string>"
_WS = " \t\n\r\f\u000b"


def strip_ws(c: Column) -> Column:
    """Strip leading/trailing ASCII whitespace (Python ``str.strip``)."""
    return F.btrim(c, F.lit(_WS))


def has_zones(raw: Column) -> Column:
    """Row predicate: zones_hit is present and not blank."""
    return raw.isNotNull() & (strip_ws(raw) != "")


def json_array(text: Column) -> Column:
    """The elements of a JSON array as texts; NULL unless ``text`` is exactly one valid array.

    The parser stops behind the first value, so the text is parsed inside an
    outer array and inside an object: only white space can follow a value in
    both, or a comma, which makes a second element of the outer array.
    """
    strict = {"allowSingleQuotes": "false"}
    in_array = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{_ARRAY}>", strict)
    in_object = F.from_json(F.concat(F.lit('{"z":'), text, F.lit("}")), f"z {_ARRAY}", strict)
    return F.when((F.size(in_array) == 1) & in_object["z"].isNotNull(), in_array[0])


def zones_loader(raw: Column) -> Column:
    s = strip_ws(raw)
    parsed = F.coalesce(json_array(s), F.array(s))
    arr = (
        F.when(raw.isNull() | (s == ""), F.array().cast(_ARRAY))
        .when(s.startswith("["), parsed)
        .otherwise(F.array(s))
    )
    return F.filter(arr, lambda z: z.isNotNull())


def zones_sql(raw: Column) -> Column:
    """Array of trimmed, non-blank zone names (before explode)."""
    arr = F.when(strip_ws(raw).startswith("["), json_array(strip_ws(raw))).otherwise(F.array(raw))
    trimmed = F.transform(arr, strip_ws)
    return F.filter(trimmed, lambda z: z.isNotNull() & (z != ""))
