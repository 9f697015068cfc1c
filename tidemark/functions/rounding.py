"""Rounding of values that aren't negative: half up at the given number of places, on the binary value."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int) -> Column:
    return F.floor(x * 10**places + 0.5) / 10**places
