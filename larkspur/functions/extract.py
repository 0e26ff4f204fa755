"""Fields of records: problem texts, answers, and the text of nested values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Names under which records hold problems and answers, in order of precedence.
PROBLEM = ("question", "problem", "text", "prompt", "input", "query")
ANSWER = ("answer", "solution", "output", "target", "label", "ground_truth")


def problem_text(df: DataFrame, priority: tuple[str, ...] = PROBLEM) -> Column:
    """The first text field that a record has, else all its texts joined by blanks."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return F.coalesce(*[F.col(c) for c in priority if c in texts], F.concat_ws(" ", *[F.col(f"`{c}`") for c in texts]))


def answer_text(df: DataFrame, priority: tuple[str, ...] = ANSWER) -> Column:
    """The first answer field that a record has, as text, else 'unknown'."""
    return F.coalesce(*[F.col(c).cast("string") for c in priority if c in df.columns], F.lit("unknown"))


def nested_texts(c: Column, kind: DataType) -> Column | None:
    """All texts within a value of a nested type, as an array in order of fields; None for types that hold none."""
    if isinstance(kind, StringType):
        return F.array(c)
    if isinstance(kind, StructType):
        parts = [p for f in kind.fields if (p := nested_texts(c[f.name], f.dataType)) is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, MapType):
        return nested_texts(F.map_values(c), ArrayType(kind.valueType))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType):
            return c
        if nested_texts(F.lit(None), kind.elementType) is not None:
            return F.flatten(F.transform(c, lambda x: nested_texts(x, kind.elementType)))
    return None


def nested_text(c: Column, kind: DataType) -> Column:
    """The texts of a nested value joined by blanks."""
    texts = nested_texts(c, kind)
    return F.lit("") if texts is None else F.concat_ws(" ", texts)
