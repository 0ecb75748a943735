"""Retrieval and answer metrics as Column expressions over arrays and strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


def _first(found: Column, k: int) -> Column:
    return F.slice(found, 1, k)


def _hits(found: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(_first(found, k), relevant)).cast("double")


def _distinct_size(a: Column) -> Column:
    return F.size(F.array_distinct(a)).cast("double")


def recall_at_k(found: Column, relevant: Column, k: int, total: Column | None = None) -> Column:
    """Distinct relevant items among the first k over all relevant ones; 0 where nothing is relevant.

    ``total``: how many are relevant, where ``relevant`` has only those that were found.
    """
    n = _distinct_size(relevant) if total is None else total
    return F.when(n > 0, _hits(found, relevant, k) / n).otherwise(F.lit(0.0))


def precision_at_k(found: Column, relevant: Column, k: int) -> Column:
    """Distinct relevant items among the first k over k itself, not over what was found."""
    return _hits(found, relevant, k) / F.lit(float(k)) if k > 0 else F.lit(0.0)


def mrr(found: Column, relevant: Column) -> Column:
    """One over the place of the first relevant item, else 0."""
    at = F.array_position(F.transform(found, lambda x: F.array_contains(relevant, x)), F.lit(True))
    return F.when(at > 0, 1.0 / at).otherwise(F.lit(0.0))


def ndcg_at_k(found: Column, relevant: Column, k: int, total: Column | None = None) -> Column:
    """Binary gains over the ideal; an item that is found twice gains twice, so the value can pass 1. ``total`` as in ``recall_at_k``."""
    gains = F.transform(_first(found, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + 2)).otherwise(0.0))
    gained = F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)
    n = F.least(_distinct_size(relevant) if total is None else total.cast("double"), F.lit(float(k))).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    ideal = F.aggregate(steps, F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    return F.when(ideal > 0, gained / ideal).otherwise(F.lit(0.0))


def hit_at_k(found: Column, relevant: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(_first(found, k), relevant), F.lit(False))


def exact_match(predicted: Column, truth: Column) -> Column:
    return text.normalized(predicted) == text.normalized(truth)


def f1_score(predicted: Column, truth: Column) -> Column:
    """F1 over the sets of words; 0 where either side has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    p, t = words(predicted), words(truth)
    both = F.size(F.array_intersect(p, t)).cast("double")
    return F.when((F.size(p) > 0) & (F.size(t) > 0) & (both > 0), 2.0 * both / (F.size(p) + F.size(t))).otherwise(F.lit(0.0))
