"""Display labels for zone names and search over result rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def zone_label(zone: Column) -> Column:
    """Underscores become spaces (table label)."""
    return F.regexp_replace(zone, "_", " ")


def title_words(s: Column) -> Column:
    """Upper-case the first word character of every word; the rest unchanged.

    A word character is [A-Za-z0-9_]; it starts a word when the character
    before it is not a word character (or it is the first one).
    """
    chars = F.split(s, "")
    return F.array_join(
        F.transform(
            chars,
            lambda ch, i: F.when(
                ch.rlike(r"^\w$")
                & ((i == 0) | ~F.substring(s, i, 1).rlike(r"^\w$")),
                F.upper(ch),
            ).otherwise(ch),
        ),
        "",
    )


def zone_title(zone: Column) -> Column:
    """Tooltip label: underscores to spaces, then each word capitalised."""
    return title_words(zone_label(zone))


def search_terms(query: str) -> list[str]:
    return [t for t in re.split(r"\s+", query or "") if t]


def term_pattern(term: str) -> str:
    """Case-insensitive match of ``term`` at the start of a word."""
    return r"(?i)(^|[^\p{L}\-])" + re.escape(term)
