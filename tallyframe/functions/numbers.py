"""Number helpers: guarded ratios and the numeric value of a verdict."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def harmonic(precision: Column, recall: Column) -> Column:
    """F1 of a precision and a recall; NULL if either is NULL or both are zero."""
    return F.try_divide(F.lit(2.0) * (precision * recall), precision + recall)


def verdict_number(value: Column) -> Column:
    """A verdict or score as a number: missing (NULL or NaN) is one half."""
    return F.nanvl(F.coalesce(value.cast("double"), F.lit(0.5)), F.lit(0.5))
