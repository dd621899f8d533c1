"""Text helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def after_last(text: Column, mark: str) -> Column:
    """Text behind the last `mark`, or the whole text where it is absent."""
    return F.substring_index(text, mark, -1)


def before_first(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def plain_tax_id(tax_id: Column) -> Column:
    """The one form in which tax ids are compared: lower case, no spaces."""
    return F.lower(F.replace(tax_id, F.lit(" "), F.lit("")))


def holds_any(text: Column, words) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def holds_all(text: Column, words) -> Column:
    found = F.lit(True)
    for word in words:
        found = found & text.contains(word)
    return found
