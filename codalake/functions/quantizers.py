"""Quantizer scales: the public 0..63 scale against the index scales of both codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Index of each public quantizer (VP8, 0..127).
VP8_INDEX = [
    0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 12, 13, 15, 17, 18, 19, 20, 21, 23, 24, 25, 26, 27, 28, 29, 30, 31, 33, 35, 37, 39, 41,
    43, 45, 47, 49, 51, 53, 55, 57, 59, 61, 64, 67, 70, 73, 76, 79, 82, 85, 88, 91, 94, 97, 100, 103, 106, 109, 112, 115, 118, 121, 124, 127,
]
# The VP9 scale (0..255) is four per step up to 244, and then 249 and 255.
VP9_INDEX = [*range(0, 245, 4), 249, 255]


def _array(table: list[int]) -> Column:
    return F.array(*map(F.lit, table))


def to_index(public: Column, table: list[int]) -> Column:
    """The index of a public quantizer, which is clamped to 0..63."""
    return F.get(_array(table), F.least(F.greatest(public, F.lit(0)), F.lit(63)).cast("int"))


def to_public(index: Column, table: list[int]) -> Column:
    """The first public quantizer whose index is at least the given one; 63 beyond the table."""
    below = F.size(F.filter(_array(table), lambda x: x < index))
    return F.least(below, F.lit(63))
