"""Scores of answers and paraphrases as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def exact_match(predicted: Column, expected: Column) -> Column:
    return F.lower(stripped(predicted)) == F.lower(stripped(expected))


def substring_match(predicted: Column, expected: Column) -> Column:
    return F.contains(F.lower(stripped(predicted)), F.lower(stripped(expected)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def edit_ratio(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty texts."""
    return F.coalesce(F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of token sets; two empty texts are alike."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def _grams(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def _once(values: Column, use) -> Column:
    """use(values) with the values computed once, however often it names them."""
    return F.get(F.transform(F.array(values), use), 0)


def _numbered(grams: Column) -> Column:
    """Each gram with the number of its occurrence, so that a set operation counts repeats."""
    return _once(F.sort_array(grams), lambda s: F.transform(s, lambda g, i: F.concat_ws(" ", g, (i - F.array_position(s, g)).cast("string"))))


def _bleu(r: Column, c: Column) -> Column:
    logs = F.lit(0.0)
    for n in range(1, 5):
        own, other = _grams(c, n), _grams(r, n)
        total = F.greatest(F.size(own), F.lit(1))
        clipped = F.size(F.array_intersect(_numbered(own), _numbered(other)))
        logs = logs + F.log(F.when(clipped > 0, clipped.cast("double")).otherwise(0.1) / total) / 4
    brevity = F.when(F.size(c) > F.size(r), 1.0).otherwise(F.exp(1 - F.size(r) / F.size(c)))
    return F.when((F.size(c) == 0) | (F.size(r) == 0), 0.0).otherwise(brevity * F.exp(logs))


def bleu(reference: Column, candidate: Column) -> Column:
    """BLEU of up to four-grams against one reference; an order without a match counts 0.1. Empty texts give 0, nulls null."""
    return _once(F.struct(tokens(reference).alias("r"), tokens(candidate).alias("c")), lambda p: _bleu(p["r"], p["c"]))


def accepted(similarity: Column, edit: Column, bleu_: Column) -> Column:
    return (similarity >= 0.85) & ((edit >= 0.25) | (bleu_ <= 0.6))


def rejection(similarity: Column, edit: Column, bleu_: Column) -> Column:
    sem, sur = similarity < 0.85, ~((edit >= 0.25) | (bleu_ <= 0.6))
    return F.when(sem & sur, "both").when(sem, "semantic").when(sur, "surface").otherwise("none")


# Forms in which an answer names an option, in order of precedence.
CHOICES = [r"\b([A-E])\)", r"\(([A-E])\)", r"\b([A-E])\.", r"\b([1-5])\)", r"\(([1-5])\)", r"\b([1-5])\."]


def choice(c: Column) -> Column:
    """The option letter or number that an answer names; null if none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, form, 1), F.lit("")) for form in CHOICES])


def verdict(predicted: Column, expected: Column) -> Column:
    """How an answer is right: 'equal', 'contains' (the whole expected text) or 'choice' (both name the same option, looked for in
    lowered texts, so by number); else 'none', as for nulls."""
    p, e = F.lower(stripped(predicted)), F.lower(stripped(expected))
    return F.when(p == e, "equal").when(F.contains(p, e), "contains").when(choice(p) == choice(e), "choice").otherwise("none")


def price(name: Column, prices: dict[str, float], default: float) -> tuple[Column, Column]:
    """Price of a name and how it was found: 'exact'; 'part', where one name holds the other, the longest name of the list first; else 'default'.

    The list is a parameter, short by construction, so it becomes one expression and no join."""
    cost, kind = None, None
    order = [(name == F.lit(k), v, "exact") for k, v in prices.items()]
    order += [(F.contains(name, F.lit(k)) | F.contains(F.lit(k), name), prices[k], "part") for k in sorted(prices, key=lambda k: (-len(k), k))]
    for hit, value, said in order:
        cost = F.when(hit, F.lit(float(value))) if cost is None else cost.when(hit, F.lit(float(value)))
        kind = F.when(hit, said) if kind is None else kind.when(hit, said)
    return (F.lit(float(default)), F.lit("default")) if cost is None else (cost.otherwise(F.lit(float(default))), kind.otherwise("default"))
