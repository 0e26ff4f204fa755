"""Text perturbations as column expressions. Draws are ranks of md5 digests, so a result depends on seed, row and position only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import WORD

# Symbols that stand in for letters and digits.
SYMBOLS = "@#$%&*+=?"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row: what a higher-order function takes from outside, it computes for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scramble(text: Column, level: float, seed: str, identity: Column, symbols: str = SYMBOLS) -> Column:
    """floor(n * level) of the n letters and digits become symbols: those of least md5 of seed, id and position."""
    key = lambda c, i: F.when(F.rlike(c, F.lit("^[A-Za-z0-9]$")), F.md5(F.concat(F.lit(seed + ":"), identity, F.lit(":"), (i + 1).cast("string"))))
    signs = F.transform(F.split(text, ""), lambda c, i: F.struct(key(c, i).alias("h"), (i + 1).alias("i"), c.alias("c")))

    def changed(s: Column) -> Column:
        drawn = F.array_sort(F.transform(F.filter(s, lambda x: x["h"].isNotNull()), lambda x: F.struct(x["h"].alias("h"), x["i"].alias("i"))))
        # Those up to the last chosen one are the chosen ones, so no sign is looked up in a list.
        last = bound(drawn, lambda d: F.struct(F.get(d, F.floor(F.size(d) * F.lit(level)).cast("int") - 1).alias("last")))
        symbol = lambda i: F.substr(F.lit(symbols), (i % len(symbols)) + 1, F.lit(1))
        chosen = lambda x, z: F.coalesce(x["h"].isNotNull() & (F.struct(x["h"].alias("h"), x["i"].alias("i")) <= z["last"]), F.lit(False))
        return bound(last, lambda z: F.array_join(F.transform(s, lambda x: F.when(chosen(x, z), symbol(x["i"])).otherwise(x["c"])), ""))

    return F.when(F.length(text) == 0, text).otherwise(bound(signs, changed))


def rotated(k: int) -> str:
    return LOWER[k % 26 :] + LOWER[: k % 26]


def caesar(text: Column, k: int) -> Column:
    """Letters moved k places, case kept."""
    return F.translate(text, LOWER + LOWER.upper(), rotated(k) + rotated(k).upper())


def caesar_in_sequence(text: Column, k: int) -> Column:
    """The same rules applied one after another, so that a letter may move more than once."""
    for a, b in zip(LOWER, rotated(k)):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def phonetic(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Letter groups replaced in order of the rules."""
    for a, b in rules:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def translated(text: Column, vocabulary: dict[str, str], k: int) -> Column:
    """Word by word: numbers and capitalised words after the first stay, known words come from the vocabulary, others are enciphered."""
    table = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    pieces = F.regexp_extract_all(text, F.lit(rf"({WORD}|[^\p{{L}}\p{{N}}_]+)"), 1)

    def one(t: Column, i: Column) -> Column:
        keep = F.rlike(t, F.lit("^[0-9]+$")) | ((i > 0) & F.rlike(t, F.lit(r"^\p{Lu}\p{Ll}+$")))
        return F.when(keep, t).otherwise(F.coalesce(F.element_at(table, F.lower(t)), caesar(t, k)))

    return F.array_join(F.transform(pieces, one), "")


def synonyms(text: Column, table: dict[str, str], rate: float, seed: str) -> Column:
    """Words of the table replaced where the md5 of seed, word and place falls below the rate; a capital first letter stays one."""
    map_ = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    pieces = F.regexp_extract_all(text, F.lit(rf"({WORD}|[^\p{{L}}\p{{N}}_]+)"), 1)

    def one(t: Column, i: Column) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), t, i.cast("string"))), 1, 4), 16, 10).cast("int") / 65536
        new = F.element_at(map_, F.lower(t))
        cased = F.when(F.rlike(t, F.lit(r"^\p{Lu}")), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 100))).otherwise(new)
        return F.when(new.isNotNull() & (draw < rate), cased).otherwise(t)

    return F.array_join(F.transform(pieces, one), "")


def reordered(sections: Column) -> Column:
    """Non-heading sections in reverse order in their slots; headings stay. Elements have kind and content."""
    placed = F.transform(sections, lambda s, i: F.struct(i.alias("at"), s["kind"].alias("kind"), s["content"].alias("content")))
    headings, others = F.filter(placed, lambda s: s["kind"] == "heading"), F.filter(placed, lambda s: s["kind"] != "heading")
    moved = F.zip_with(others, F.reverse(others), lambda a, b: F.struct(a["at"].alias("at"), b["kind"].alias("kind"), b["content"].alias("content")))
    return F.transform(F.array_sort(F.concat(headings, moved)), lambda s: F.struct(s["kind"].alias("kind"), s["content"].alias("content")))


def at_random(n: int, *parts: Column) -> Column:
    """A number from 0 to n - 1 by the md5 of some texts."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 4), 16, 10).cast("int") % n


def pseudo_word(word: Column, seed: str, consonants: str, vowels: str, length: Column | None = None) -> Column:
    """Consonants and vowels in turn, as long as the word unless told otherwise, each by the md5 of seed, word and place."""

    def sign(i: Column) -> Column:
        pick = lambda letters: F.substr(F.lit(letters), at_random(len(letters), F.lit(seed + ":"), word, F.lit(":"), i.cast("string")) + 1, F.lit(1))
        return F.when(i % 2 == 1, pick(consonants)).otherwise(pick(vowels))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(word) if length is None else length), sign), "")


def first_shift(word: Column, shifts: list[tuple[str, str]]) -> Column:
    """The first of the rules whose letters are in the word, applied alone."""
    out = word
    for a, b in reversed(shifts):
        out = F.when(F.contains(word, F.lit(a)), F.replace(word, F.lit(a), F.lit(b))).otherwise(out)
    return out


def inner_scrambled(text: Column, share: float, seed: str, identity: Column) -> Column:
    """Of floor(n * share) of the n words, those of least md5 of seed, id and place, the inner letters go in order of md5 of seed, word and place; words of up to 3 letters stay."""
    words = F.split(text, " ")
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct(F.md5(F.concat(F.lit(seed + ":"), identity, F.lit(":"), i.cast("string"))).alias("h"), i.alias("i"))))
    chosen = F.transform(F.slice(ranked, F.lit(1), F.floor(F.size(words) * F.lit(share)).cast("int")), lambda s: s["i"])

    def moved(w: Column) -> Column:
        letters = F.array_sort(F.transform(F.sequence(F.lit(2), F.length(w) - 1), lambda j: F.struct(F.md5(F.concat(F.lit(seed + ":"), w, F.lit(":"), j.cast("string"))).alias("h"), F.substr(w, j, F.lit(1)).alias("c"))))
        return F.concat(F.substr(w, F.lit(1), F.lit(1)), F.array_join(F.transform(letters, lambda s: s["c"]), ""), F.substr(w, F.length(w), F.lit(1)))

    return F.array_join(F.transform(words, lambda w, i: F.when(F.array_contains(chosen, i) & (F.length(w) > 3), moved(w)).otherwise(w)), " ")


# Names that stand for others, by what they look like; lists are parameters of noun_swap.
STAND_INS = {
    "person": ["Ada", "Borin", "Celeste", "Dario", "Evangeline", "Fenwick", "Gus", "Henrietta"],
    "place": ["Ashford", "Brindleton", "Corland", "Dunmereburg", "Eastville", "Fernland"],
    "other": ["Acorn Works", "Blue Lantern", "Cobalt", "Delta Group", "Ember", "Foundry House"],
}
#: How far lengths may be apart in the phonetic strategy.
BANDS = {"person": 2, "place": 2, "other": 3}


def looks_like(noun: Column) -> Column:
    """'person' for one word of 3 to 12 letters or two of 2 to 12, else 'place' by its ending, else 'other'."""
    person = F.rlike(noun, F.lit(r"^[A-Z][a-z]{2,11}$")) | F.rlike(noun, F.lit(r"^[A-Z][a-z]{1,11} [A-Z][a-z]{1,11}$"))
    return F.when(person, "person").when(F.rlike(noun, F.lit("(land|burg|ville|ton|ford)$")), "place").otherwise("other")


def stand_in(noun: Column, strategy: str, seed: str = "n", names: dict[str, list[str]] | None = None) -> Column:
    """The one name that stands for a noun throughout: 'random' draws from the names of its kind, 'thematic' from all names of a
    theme that the noun's first letter sets, 'phonetic' from names of its kind whose length is near, and of these from those
    that sound alike from their first letter on, where there are any. Draws are by md5, so that equal nouns always agree."""
    names = names or STAND_INS
    lists = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(n) for n in x]) for pair in names.items() for x in pair])
    place = lambda n: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), noun)), 1, 4), 16, 10).cast("int") % n
    draw = lambda options: F.get(options, place(F.size(options)))
    own = F.element_at(lists, looks_like(noun))
    if strategy == "random":
        return draw(own)
    if strategy == "thematic":
        theme = F.element_at(F.array(*[F.lit(k) for k in names]), F.ascii(F.substring(noun, 1, 1)) % len(names) + 1)
        return draw(F.element_at(lists, theme))
    band = F.element_at(F.create_map(*[F.lit(x) for pair in BANDS.items() for x in pair]), looks_like(noun))
    near = F.filter(own, lambda n: F.abs(F.length(n) - F.length(noun)) <= band)
    alike = F.filter(near, lambda n: F.substring(F.soundex(n), 1, 2) == F.substring(F.soundex(noun), 1, 2))
    return draw(F.when(F.size(alike) > 0, alike).when(F.size(near) > 0, near).otherwise(own))


def noun_swap(c: Column, nouns: Column, strategy: str) -> Column:
    """A text with each of the given nouns exchanged, runs of capitalised words as wholes."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?U)(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b|\w+|\W+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(F.array_contains(nouns, p), stand_in(p, strategy)).otherwise(p)), "")
