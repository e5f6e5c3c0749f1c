"""Pitch arithmetic as column expressions, and the constants of a profile.

A missing (unvoiced) value is NULL throughout, never NaN.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

#: Fixed value: an unvoiced frame in quantised tracks.
UNVOICED = -32768


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))


def hz_to_cents(f0: Column, ref_hz: float = 55.0) -> Column:
    """Cents above the reference; NULL for missing, NaN and non-positive frequencies."""
    return F.when((f0 > 0) & ~F.isnan(f0), F.log2(f0 / F.lit(float(ref_hz))) * 1200.0)


def fold_octave(cents: Column) -> Column:
    return F.pmod(cents, F.lit(1200.0))


def pitch_bin(cents: Column, n_classes: int = 24) -> Column:
    """Pitch class of a cents value, half-even rounded."""
    return F.rint(fold_octave(cents) / F.lit(1200.0 / n_classes)).cast("int") % n_classes


def transpose(bin_: Column, shift: Column | int, n_classes: int = 24) -> Column:
    return F.pmod(bin_ + (shift if isinstance(shift, Column) else F.lit(shift)), F.lit(n_classes))


def quantise(cents: Column) -> Column:
    """Half-even whole cents within 16 bits; missing or non-finite becomes UNVOICED."""
    clipped = F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), F.rint(cents)))
    return F.when(finite(cents), clipped).otherwise(F.lit(float(UNVOICED))).cast("smallint")


def dequantise(samples: Column) -> Column:
    return F.nullif(samples, F.lit(UNVOICED).cast("smallint")).cast("double")


def one_hot(bin_: Column, n_classes: int = 24) -> Column:
    """Salience column of a bin; all zero for NULL."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.when(k == bin_, 1.0).otherwise(0.0))


def kernel(n_classes: int = 24, sigma_cents: float = 150.0) -> np.ndarray:
    """Profile column of bin 0: a one-hot column under a circular Gaussian of
    ``sigma_cents``, cut at four standard deviations and normalised to sum 1."""
    column = np.zeros(n_classes)
    if sigma_cents <= 0:
        column[0] = 1.0
        return column
    sd = sigma_cents / (1200.0 / n_classes)
    reach = int(4 * sd + 0.5)
    offsets = np.arange(-reach, reach + 1)
    weights = np.exp(-0.5 * (offsets / sd) ** 2)
    np.add.at(column, offsets % n_classes, weights / weights.sum())
    return column / column.sum()


def profile(bin_: Column, n_classes: int = 24, sigma_cents: float = 150.0) -> Column:
    """Dense profile column of a bin: the kernel turned to it, zero for NULL."""
    g = F.array(*[F.lit(float(x)) for x in kernel(n_classes, sigma_cents)])
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.coalesce(F.get(g, F.pmod(k - bin_, F.lit(n_classes)).cast("int")), F.lit(0.0)))


def distance_table(n_classes: int = 24, sigma_cents: float = 150.0, metric: str = "euclidean", half_precision: bool = False) -> np.ndarray:
    """Distances of profile columns, (n_classes + 1) squared: query bin, reference
    bin, the last index for unvoiced. All voiced columns are turns of one kernel,
    so this table replaces any distance of whole columns.

    ``half_precision`` rounds the reference side to float16 as stored tracks were.
    """
    from ..operators.distance import pairwise

    g = kernel(n_classes, sigma_cents)
    columns = np.array([np.roll(g, b) for b in range(n_classes)] + [np.zeros(n_classes)])
    stored = columns.astype(np.float16).astype(float) if half_precision else columns
    return pairwise(columns, stored, metric)
