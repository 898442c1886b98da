"""Row-level column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Segment names and the score each one starts above.
SEGMENTS = (("High-Value", 4), ("Mid-Value", 2))
LOWEST_SEGMENT = "Low-Value"


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour periods from `start` to `end` (not calendar days, and the
    same in every session time zone)."""
    return F.extract(F.lit("DAY"), end - start).cast("long")


def micros_between(start: Column, end: Column) -> Column:
    gap = end - start

    def part(name: str) -> Column:
        return F.extract(F.lit(name), gap)

    minutes = (part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def yes_flag(column: Column) -> Column:
    """1 for the text 'Yes'; anything else, NULL included, is 0."""
    return F.when(column == "Yes", 1).otherwise(0)


def segment_label(score: Column) -> Column:
    """Value segment of an overall score; the highest threshold passed wins."""
    (top, above_top), *rest = SEGMENTS
    label = F.when(score > above_top, top)
    for name, above in rest:
        label = label.when(score > above, name)
    return label.otherwise(LOWEST_SEGMENT)


def present_id(column: Column) -> Column:
    """True for an id that is neither NULL nor NaN (test before casting to text)."""
    return column.isNotNull() & ~F.isnan(column.try_cast("double"))


def discounted(amount: Column, annual_rate: Column, month: Column) -> Column:
    """Present value of `amount` paid `month` months from now, compounded monthly."""
    return amount / F.pow(F.lit(1.0) + annual_rate / F.lit(12.0), month)


def log1p_exp(z: Column) -> Column:
    """ln(1 + e^z) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def logistic(z: Column) -> Column:
    """1 / (1 + e^-z) without overflow."""
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def rounded(column: Column, places: int) -> Column:
    """round() with negative zero folded to zero, for printing and comparing."""
    return F.round(column, places) + F.lit(0.0)


def text_literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
