"""Recency decay and ranking scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V
from .predicates import has, has_any

#: Days of the month in which ages are counted.
MONTH_DAYS = 30
NO_RATE = 0.3


def age_months(as_of: Column, at: Column) -> Column:
    """Age in months of 30 days, with fractions."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400e6 * MONTH_DAYS)


def half_life(trends: Column) -> Column:
    """Months in which a note's surface loses half its weight, by the trends it leans on."""
    short = has_any(trends, V.SHORT_TERM_TRENDS)
    return F.when(has(trends, V.ANY_TREND), 60.0).when(has(trends, V.ERA_LANGUAGE) & ~short, 30.0).when(short, 9.0).otherwise(12.0)


def decay(age: Column, months: Column | float) -> Column:
    """0.5 to the power of age over half-life."""
    return F.pow(F.lit(0.5), age / months)


def linear_recency(as_of: Column, at: Column, days: int = 365) -> Column:
    """The older linear decay that reaches zero after ``days``."""
    return F.greatest(F.lit(0.0), 1 - age_months(as_of, at) * MONTH_DAYS / days)


def tier_bonus(tier: Column) -> Column:
    return F.when(tier == V.MEGA_HIT, 0.5).when(tier == V.HIT, 0.3).when(tier == V.REFERENCE, 0.15).otherwise(0.0)


def source_bonus(source: Column) -> Column:
    return F.when(source.isin(*V.HUMAN_SOURCES), 0.2).otherwise(0.0)


def rank_score(recency: Column, tier: Column, source: Column, rate: Column) -> Column:
    """Recency, tier, source and the account's hit rate (0.3 where unknown) in one score."""
    return recency + tier_bonus(tier) + source_bonus(source) + F.coalesce(rate, F.lit(NO_RATE)) * 0.3


def layered_weights(age: Column, trends: Column) -> list[Column]:
    """surface, essence (60 months) and audience (30 months) weights of a note of an age."""
    return [decay(age, half_life(trends)).alias("surface_weight"), decay(age, 60.0).alias("essence_weight"), decay(age, 30.0).alias("audience_weight")]
