"""Answers that follow a transformed document, each by its kind (inventory T17)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import list_items, mapped_tokens
from larkspur.functions.transform import bound

#: Confidence of reworded answers and of answers kept as they are; of a span that is not found in the document, and what it keeps where its new form is not in the new one.
REWORDED, KEPT, UNFOUND, UNPLACED = 0.9, 1.0, 0.5, 0.7


def _found(part: Column, whole: Column) -> Column:
    return F.contains(F.lower(whole), F.lower(part))


def transformed_answer(answer: Column, kind: Column, document: Column, transformed: Column, mapping: dict[str, str], translate: Callable[[Column], Column] | None = None) -> Column:
    """(answer, confidence) after a document's words were exchanged by ``mapping`` and it was, with ``translate``, put into another language.

    Spans take the new words and are looked up in both documents; option letters and plain numbers stay; a plain yes or no
    is only translated; lists are reworded item by item and joined by commas with a last 'and'; everything else is reworded.
    A missing answer stays null.
    """
    told = translate or (lambda c: c)
    mapped = lambda c: mapped_tokens(c, mapping)
    out = lambda a, sure: F.struct(a.alias("answer"), (F.lit(sure) if isinstance(sure, float) else sure).alias("confidence"))
    reworded = out(told(mapped(answer)), REWORDED)
    bare = F.trim(answer)

    def spans(m: Column) -> Column:
        sure = F.when(_found(bare, document), KEPT).otherwise(UNFOUND) * F.when(_found(m, transformed), 1.0).otherwise(UNPLACED)
        return out(told(m), sure)

    def joined(items: Column) -> Column:
        new = F.transform(items, lambda x: told(mapped(x)))
        first = F.array_join(F.slice(new, F.lit(1), F.greatest(F.size(new) - 1, F.lit(0))), ", ")
        text = F.when(F.size(items) > 1, F.concat(first, F.lit(", and "), F.element_at(new, -1))).when(F.size(items) == 1, F.get(new, F.lit(0))).otherwise(answer)
        return out(text, F.when(F.size(items) > 0, REWORDED).otherwise(KEPT))

    plain = (
        ((kind == "multiple_choice") & F.rlike(bare, F.lit(r"^([A-D]|\d+)$")))
        | ((kind == "numeric") & F.rlike(bare, F.lit(r"^\d+(\.\d+)?$")))
    )
    return (
        F.when(plain, out(answer, KEPT))
        .when((kind == "yes_no") & F.lower(bare).isin("yes", "no", "true", "false"), out(told(answer), KEPT))
        .when(kind == "extractive", bound(mapped(answer), spans))
        .when(kind == "list", bound(list_items(answer), joined))
        .otherwise(reworded)
    )
