"""Evaluators of answers by name: columns of predicted and expected text in, a boolean column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import score
from larkspur.functions.python import sequence_reaches

Evaluator = Callable[[Column, Column], Column]

#: The share of matching text from which a fuzzy answer counts; the semantic mode stands in for meaning by the same measure.
ALIKE = 0.8

_evaluators: dict[str, Evaluator] = {
    "exact": score.exact_match,
    "substring": score.substring_match,
    "fuzzy": lambda p, e: sequence_reaches(p, e, ALIKE),
    "semantic": lambda p, e: sequence_reaches(p, e, ALIKE),
}


def register_evaluator(name: str, evaluate: Evaluator) -> None:
    """Add or replace an evaluator."""
    _evaluators[name] = evaluate


def evaluated(name: str, predicted: Column, expected: Column) -> Column:
    """Whether the named evaluator takes the answer as right; missing answers are wrong. Raises ValueError for an unknown name."""
    if name not in _evaluators:
        raise ValueError(f"no evaluator named {name}")
    return F.coalesce(_evaluators[name](predicted, expected), F.lit(False))
