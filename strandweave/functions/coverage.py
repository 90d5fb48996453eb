"""Coverage arithmetic and length ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strand import col, palindromic

#: Coverages closer than this count as equal.
TOLERANCE = 0.1


def weighted_mean(multiplicity: Column | str, length: Column | str) -> Column:
    """Aggregate: the length-weighted mean coverage."""
    return F.sum(col(multiplicity) * col(length)) / F.sum(col(length))


def step_coverage(multiplicity: Column | str, src: Column | str, dst: Column | str) -> Column:
    """What one pass over an edge may use: half of it where the edge is its own reverse complement."""
    return F.when(palindromic(src, dst), col(multiplicity) / 2).otherwise(col(multiplicity))


def ratio(a: Column | str, b: Column | str) -> Column:
    """The shorter over the longer."""
    return F.least(col(a), col(b)) / F.greatest(col(a), col(b))


def unbalanced(a: Column | str, b: Column | str, most: float = 0.5) -> Column:
    """Whether two coverages differ by more than ``most`` of the lesser."""
    return F.abs(col(a) - col(b)) / F.least(col(a), col(b)) > most
