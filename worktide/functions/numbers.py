"""Numbers as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(value: Column, places: int) -> Column:
    """Rounded half up, whatever the last bits of a sum or quotient are: 0.2025 that
    came out as 0.20249999999999999 is a tie."""
    return F.round(F.round(value, places + 7), places)
