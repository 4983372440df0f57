"""Array helpers for bounded groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_values(cells: Column, size: Column) -> Column:
    """Array of ``size`` values from (slot, value) structs; empty slots are NULL."""
    by_slot = F.map_from_entries(cells)
    slots = F.sequence(F.lit(0), size.cast("int") - 1)
    return F.transform(slots, lambda i: F.try_element_at(by_slot, i))
