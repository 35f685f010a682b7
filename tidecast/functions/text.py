"""String repair: dirty numbers, dates, column names, category codes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The byte-order mark and its Latin-1 misreading.
BOM_MARKS = ("\ufeff", "\u00ef\u00bb\u00bf")

# Date formats of the supported tables.
DATE_FORMATS = ("M/d/yyyy", "M/d/yyyy H:mm", "yyyy-MM-dd")

# Shipping modes in order of speed, and the rank of an unknown mode.
SHIPPING_MODE_RANK = {"Same Day": 0, "First Class": 1, "Second Class": 2, "Standard Class": 3}
SHIPPING_MODE_DEFAULT = 2
EXPEDITED_MODES = ("Same Day", "First Class")


def parse_number(c: Column, accounting_negative: bool = False) -> Column:
    """Keep digits, dot and minus, then cast; unparsable text becomes null.

    ``(100)`` reads as 100 unless ``accounting_negative`` is set, then as -100.
    """
    number = F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")
    if accounting_negative:
        bracketed = F.trim(c).rlike(r"^\(.*\)$")
        number = F.when(bracketed, -number).otherwise(number)
    return number


def parse_timestamp(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that parses; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def clean_name(name: str) -> str:
    for mark in BOM_MARKS:
        name = name.replace(mark, "")
    return name


def slug(name: str) -> str:
    """Column name for a derived feature: lower case, underscores, no parentheses."""
    return re.sub(r"[()]", "", re.sub(r"[ /]", "_", name.lower()))


def slug_column(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[ /]", "_"), "[()]", "")


def ordinal(c: Column, ranks: dict[str, int], default: int) -> Column:
    """Position of a category in a fixed order; ``default`` where it is not listed."""
    out = F.lit(default)
    for value, rank in ranks.items():
        out = F.when(c == value, F.lit(rank)).otherwise(out)
    return out
