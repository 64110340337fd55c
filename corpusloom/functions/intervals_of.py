"""Places of strings in a text, compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_inside(text: Column, short: Column, longer: Column) -> Column:
    """Every place of ``short`` in the text lies in a place of ``longer``: blotting out the places of ``longer`` leaves none.

    Places of ``longer`` that overlap each other are blotted out from left to right.
    """
    return F.contains(text, longer) & ~F.contains(F.replace(text, longer, F.lit("\u0000")), short)
