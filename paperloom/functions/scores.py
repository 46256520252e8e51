"""Confidence formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def field_confidence(model: Column, source: Column, valid: Column, consensus: Column) -> Column:
    """Weighted geometric blend of four signals, each clipped to [0, 1]."""
    rule = F.when(valid, F.lit(0.9)).otherwise(F.lit(0.5))
    return clip(F.pow(clip(model), F.lit(0.4)) * F.pow(clip(source), F.lit(0.3))
                * F.pow(clip(consensus), F.lit(0.2)) * F.pow(rule, F.lit(0.1)))


def overall_confidence(mean_field: Column, classification: Column, pass_rate: Column) -> Column:
    """Field mean, classification and validation; a document without fields has mean 0."""
    return clip(0.6 * F.coalesce(mean_field, F.lit(0.0)) + 0.25 * clip(classification)
                + 0.15 * clip(F.coalesce(pass_rate, F.lit(0.0))))


def quality_image(text: Column, n_lines: Column, n_tables: Column) -> Column:
    """Extraction quality of an image page."""
    score = (F.lit(0.7) + F.when(F.length(text) > 100, 0.1).otherwise(0.0)
             + F.when(n_lines > 5, 0.1).otherwise(0.0) + F.when(n_tables > 0, 0.1).otherwise(0.0))
    return F.least(score, F.lit(1.0))


def quality_direct(text: Column, n_tables: Column) -> Column:
    """Extraction quality of a directly parsed PDF."""
    score = (F.lit(0.8) + F.when(F.length(text) > 100, 0.1).otherwise(0.0)
             + F.when(n_tables > 0, 0.1).otherwise(0.0))
    return F.least(score, F.lit(1.0))


QUALITY_BASIC = 0.6
QUALITY_FAILED = 0.0
