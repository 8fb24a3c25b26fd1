"""Robust peer scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal-consistency factors of the median absolute deviation and the interquartile range, and the share
# of the median's size below which a scale counts as zero.
MAD_FACTOR = 0.67448975
IQR_FACTOR = 1.3489795
TOLERANCE = 1e-12


def _usable(scale: Column, median: Column) -> Column:
    return scale > TOLERANCE * F.greatest(F.lit(1.0), F.abs(median))


def robust_z(x: Column, median: Column, mad: Column, iqr: Column) -> Column:
    """Deviation over the MAD; over the IQR where the MAD vanishes; null where both do."""
    d = x - median
    return F.when(_usable(mad, median), MAD_FACTOR * d / mad).when(_usable(iqr, median), IQR_FACTOR * d / iqr)


def scale_source(x: Column, median: Column, mad: Column, iqr: Column) -> Column:
    label = F.when(_usable(mad, median), "mad").when(_usable(iqr, median), "iqr-fallback").otherwise("degenerate")
    return F.when(x.isNotNull() & median.isNotNull(), label)


def median_ratio(x: Column, median: Column) -> Column:
    return F.when(median > 0, x / median)


def all_gates(*gates: Column) -> Column:
    """True where every gate holds; an unknown gate counts as failed."""
    flag = gates[0]
    for g in gates[1:]:
        flag = flag & g
    return F.coalesce(flag, F.lit(False))
