"""Text functions as column expressions. Classes of letters are Unicode's; nothing depends on engine-specific word boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def normalized(c: Column) -> Column:
    """Lower case, white space collapsed, then punctuation dropped."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), r"[^\p{L}\p{N}_\s]", "")


def stated_answer(c: Column) -> Column:
    """What follows 'answer:' or 'solution:' on its line, else the whole text stripped."""
    found = F.regexp_extract(c, r"(?i)(?:answer|solution):[ \t]*([^\n]+)", 1)
    return F.coalesce(F.nullif(F.trim(found), F.lit("")), F.trim(c))


def first_line(c: Column) -> Column:
    """The first line that is not blank, stripped."""
    return F.regexp_extract(c, r"^\s*([^\n]*[^\s])", 1)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("bigint")


def differences(a: Column, b: Column) -> Column:
    """Places at which two texts differ, those beyond the shorter included; a missing text counts as empty, two missing ones give null."""
    signs = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")
    same = F.size(F.filter(F.zip_with(signs(a), signs(b), lambda x, y: x == y), lambda equal: equal))
    return (F.greatest(F.length(a), F.length(b)) - same).cast("bigint")


def answer_type(c: Column, stated: Column | None = None) -> Column:
    """The kind that a record states, else the one that the form of the answer tells."""
    t = F.lower(F.trim(c))
    told = (
        F.when(t.isin("yes", "no", "true", "false"), "yes_no")
        .when(F.rlike(t, F.lit(r"^-?[0-9]+([.,][0-9]+)?%?$")), "numeric")
        .when(F.rlike(t, F.lit(r"^\(?[a-d]\)?[.)]?$")), "multiple_choice")
        .when(F.contains(t, F.lit(",")) | F.contains(t, F.lit(";")), "list")
        .when(word_count(c) <= 10, "extractive")
        .otherwise("abstractive")
    )
    return told if stated is None else F.coalesce(stated, told)


# What stands before a numbered item and before one with a bullet.
NUMBERED, BULLET = r"[0-9]+\.\s*", r"(?m)^\s*[-*•]\s*"


def list_items(c: Column) -> Column:
    """Items of a list: by commas, else semicolons, else ' and ', else numbers with a point, else bullets at the start of lines, else the whole."""
    has = lambda form: F.rlike(c, F.lit(form))
    parts = (
        F.when(F.contains(c, F.lit(",")), F.split(c, ","))
        .when(F.contains(c, F.lit(";")), F.split(c, ";"))
        .when(F.contains(c, F.lit(" and ")), F.split(c, " and "))
        .when(has(NUMBERED), F.split(c, NUMBERED))
        .when(has(BULLET), F.split(c, BULLET))
        .otherwise(F.array(c))
    )
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def sections(c: Column, separator: str = r"\n\s*\n") -> Column:
    """Array of (position, content) of non-empty sections; positions count the empty ones."""
    parts = F.transform(F.split(c, separator), lambda x, i: F.struct(i.alias("position"), F.trim(x).alias("content")))
    return F.filter(parts, lambda s: s["content"] != "")


def section_type(c: Column) -> Column:
    letters = F.rlike(c, F.lit(r"\p{L}"))
    return (
        F.when(F.startswith(c, F.lit("#")) | (letters & (F.upper(c) == c) & (F.length(c) < 100)), "heading")
        .when(F.rlike(c, F.lit(r"(^|\n)\s*[-*•] ")), "list")
        .when(F.rlike(c, F.lit(r"(^|\n)\s*[0-9]+\. ")), "numbered_list")
        .when(F.startswith(c, F.lit(">")) | F.startswith(c, F.lit('"')), "quote")
        .otherwise("paragraph")
    )


def importance(kind: Column, content: Column) -> Column:
    """min(1, base + a fifth of min(1, words / 50) + a tenth for numbers and a tenth for names)."""
    base = F.when(kind == "heading", 0.8).when(kind.isin("list", "numbered_list"), 0.6).when(kind == "quote", 0.4).otherwise(0.5)
    bonus = F.when(F.rlike(content, F.lit("[0-9]")), 0.1).otherwise(0.0) + F.when(F.rlike(content, F.lit(r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+")), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), base + 0.2 * F.least(F.lit(1.0), word_count(content) / 50) + bonus)


def masked_url(c: Column) -> Column:
    """A URL with the password of its user information hidden."""
    return F.regexp_replace(c, r"(://[^:/@]+):[^@/]+@", "$1:***@")


def mapped_tokens(c: Column, mapping: dict[str, str]) -> Column:
    """Whole words replaced by a map, case ignored on lookup; everything else untouched."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    pieces = F.regexp_extract_all(c, F.lit(rf"({WORD}|[^\p{{L}}\p{{N}}_]+)"), 1)
    return F.array_join(F.transform(pieces, lambda t: F.coalesce(F.element_at(table, F.lower(t)), t)), "")


# Capitalised words that are no names.
FUNCTION_WORDS = "The A An And Or But For Nor So Yet In On At By With From To Of About This That These Those His Her Its Their My Your Our He She It They We You I".split()
CAPITALISED, SEVERAL = r"(?U)\b[A-Z][a-zA-Z]+\b", r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"


def proper_nouns(c: Column) -> Column:
    """Capitalised words of three letters or more that start no sentence of the text and are no function words, and runs of
    capitalised words, each once, in order of letters."""
    found = lambda form: F.array_distinct(F.regexp_extract_all(c, F.lit(form), F.lit(0)))
    starters = F.transform(F.split(c, "[.!?]+"), lambda s: F.regexp_extract(s, r"(?U)^\s*([A-Z][a-zA-Z]+)\b", 1))
    single = F.array_except(found(CAPITALISED), F.concat(starters, F.array(*[F.lit(w) for w in FUNCTION_WORDS])))
    return F.array_sort(F.array_union(F.filter(single, lambda w: F.length(w) >= 3), found(SEVERAL)))
