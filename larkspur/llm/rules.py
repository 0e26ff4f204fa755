"""Quality rules kept as a ledger of bits.

Every rule is evaluated once for each document. The ledger stores the measurements
that rules look at and one number whose bit k says that rule k failed. Policies are
versioned sets of rules, that is masks: which documents a policy keeps, and what it
would keep without some of its rules, follows from the stored bits alone, by bitwise
operations, without a look at the texts.

Only DataFrame operations. A word is a run outside ``[\\x20\\x09-\\x0D]``. Repeats are
found inside a row, by sorting its windows, so nothing of a text is shuffled. Null
and empty texts have measurements of 0 and fail the rule of too few words; texts of
any length are measured whole; rows that repeat an id or have none each have a row
of their own; an empty table gives an empty ledger. Other columns are not read, so
their names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETWEEN, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Words of a window that counts as repeated.
WINDOW = 3
#: Windows of a text are told apart by place in so many bits; longer texts compare all their windows.
PLACE_BITS = 24
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Rules by bit: name, and when a document fails, over the measurements. Bits are never given to another rule.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 5 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("many_words", "n_words > 100000"),
    ("one_line", "n_lines = 1 and n_words > 1000"),
]


@dataclass(frozen=True)
class Policy:
    """A version and the rules whose failure drops a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        places = {name: k for k, (name, _) in enumerate(RULES)}
        return sum(1 << places[r] for r in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_words"))
#: The policies in use, oldest first; a version never changes once it is here.
POLICIES = [BASE, Policy("v1", (*BASE.rules, "symbols")), Policy("v2", (*BASE.rules, "symbols", "repeated_lines", "short_words", "long_words"))]


def _let(value: Column, body) -> Column:
    """body of a value that is computed once for a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window of so many words that the row holds twice or more."""

    def joined(w: Column, x: Column, i: Column, how) -> Column:
        return how(x, *[w[i + k] for k in range(1, window)])

    def among(w: Column) -> Column:
        starts = F.slice(w, 1, F.size(w) - (window - 1))
        hashes = F.transform(starts, lambda x, i: joined(w, x, i, F.xxhash64))
        # Where all hashes differ, so do the windows.
        some = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(w, h)).otherwise(F.lit(0)))
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(some)

    def exact(w: Column, h: Column) -> Column:
        """Compare words, but only of windows that share the high bits of their hash with another; places fit in the low ones."""
        place = (1 << PLACE_BITS) - 1
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("bigint"))))
        shared = _let(packed, lambda s: F.filter(s, next_to(lambda x: F.shiftright(x, PLACE_BITS), s)))
        at = F.transform(shared, lambda x: x.bitwiseAND(F.lit(place)).cast("int"))
        at = F.when(F.size(h) <= place, at).otherwise(F.transform(h, lambda x, i: i))
        # Words hold no blank, so windows joined by blanks are equal where their words are.
        keyed = F.transform(at, lambda i: F.struct(joined(w, w[i], i, lambda *x: F.concat_ws(" ", *x)).alias("key"), i.alias("at")))
        return _let(F.sort_array(keyed), lambda s: covered(F.transform(F.filter(s, next_to(lambda x: x["key"], s)), lambda x: x["at"])))

    def next_to(key, s: Column):
        """Whether an element of sorted s has the key of one of its neighbours."""
        return lambda x, i: F.coalesce(key(F.get(s, i - 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(s, i + 1)) == key(x), F.lit(False))

    def covered(at: Column) -> Column:
        step = lambda state, i: F.struct(i.alias("last"), (state["total"] + F.least(i - state["last"], F.lit(window))).alias("total"))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(F.sort_array(at), start, step, lambda state: state["total"])

    return _let(words, among)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of each row, long."""
    given = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    words = _let(F.array_remove(F.split("text", BETWEEN), ""), of_words)
    lines = _let(F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)), of_lines)
    found = given.select("doc_id", words.alias("w"), lines.alias("l"), F.regexp_count("text", F.lit(SYMBOLS)).alias("n_symbols"))
    value = {"n_symbols": F.col("n_symbols")} | {m: F.col(f"w.{m}") for m in ("n_words", "word_chars", "n_repeat_words")} | {m: F.col(f"l.{m}") for m in ("n_lines", "n_dup_lines")}
    return found.select("doc_id", *[value[m].cast("bigint").alias(m) for m in MEASURES])


def judge(measured: DataFrame) -> DataFrame:
    """Add ``failed``: bit k is set where rule k fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, (_, rule) in enumerate(RULES)]
    return measured.withColumn("failed", reduce(Column.bitwiseOR, bits))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and failed. Store it; all else is made from it."""
    return judge(measure(df, id_col, text_col))


def _of(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("bigint"))


def kept(policy: Policy) -> Column:
    """Whether a policy keeps a row of the ledger."""
    return _of(policy) == 0


def without(policy: Policy, rules: tuple[str, ...]) -> Column:
    """Whether a policy would keep a row of the ledger if it had not these rules."""
    return kept(Policy(policy.version, tuple(r for r in policy.rules if r not in rules)))


def decisive(policy: Policy) -> Column:
    """The one rule without which the policy would keep a row that it drops; null where no or several rules fail."""
    out = F.lit(None).cast("string")
    for name in policy.rules:
        out = F.when(_of(policy) == Policy("", (name,)).mask, F.lit(name)).otherwise(out)
    return out


def ablation(stored: DataFrame, policy: Policy, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each rule of a policy (and each value of ``by``): rows, dropped, failing the rule, failing it alone (kept without it) and words of those.

    Rows are first summed by the set of rules that they fail, of which there are at most two to the power of the rules.
    """
    sets = stored.groupBy(*by, _of(policy).alias("failed")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    bits = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(Policy("", (r,)).mask).cast("bigint").alias("bit")) for r in policy.rules])).alias("r")
    rows = sets.select(*by, "failed", "n", "words", bits)
    fails, alone = F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("failed") == F.col("r.bit")
    total = lambda when, what: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0))
    return rows.groupBy(*by, F.col("r.rule").alias("rule")).agg(F.sum("n").alias("rows"), total(F.col("failed") != 0, "n").alias("dropped"), total(fails, "n").alias("failing"), total(alone, "n").alias("alone"), total(alone, "words").alias("words_alone"))


def seen(stored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rules that any row fails and those that all rows fail, as masks, from one bitwise aggregation."""
    return stored.groupBy(*by).agg(F.bit_or("failed").alias("any_fails"), F.bit_and("failed").alias("all_fail"))
