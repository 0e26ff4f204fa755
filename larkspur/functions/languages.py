"""Constructed languages: word maps made once on the driver from md5 digits, so that equal seeds give equal maps everywhere."""

from __future__ import annotations

import hashlib

from larkspur.functions.transform import LOWER

# The sounds that made-up words are built from, and endings of the agglutinating kind.
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
VOWELS = "aeiou"
ENDINGS = ["en", "ka", "lo", "ti"]
KINDS = ("substitution", "phonetic", "scrambled", "synthetic", "english_like", "random_frequency")


def digits(seed: str, count: int) -> list[int]:
    """Numbers from 0 to 255 drawn from a chain of md5 digests."""
    out: list[int] = []
    block = seed.encode()
    while len(out) < count:
        block = hashlib.md5(block).digest()
        out += block
    return out[:count]


def alternating(word: str, seed: str, length: int | None = None) -> str:
    """A word of consonants and vowels in turn, as long as the original unless told otherwise."""
    n = length or max(2, len(word))
    return "".join((CONSONANTS if k % 2 == 0 else VOWELS)[d % (len(CONSONANTS) if k % 2 == 0 else len(VOWELS))] for k, d in enumerate(digits(f"{seed}:{word}", n)))


def made_up(kind: str, word: str, seed: str, rank: int) -> str:
    """The word's form in a language of that kind; rank is its place by frequency, from 0."""
    if kind == "substitution":
        return word.translate(str.maketrans(LOWER, LOWER[13:] + LOWER[:13]))
    if kind == "phonetic":
        return word.replace("ph", "f").replace("th", "z").replace("ch", "k")
    if kind == "scrambled":
        return "".join(c for _, c in sorted(zip(digits(f"{seed}:{word}", len(word)), word)))
    if kind == "synthetic":
        return alternating(word, seed) + ENDINGS[digits(f"{seed}!{word}", 1)[0] % len(ENDINGS)]
    if kind == "english_like":
        return alternating(word, seed) + ("ing" if word.endswith("ing") else "s" if word.endswith("s") else "")
    if kind == "random_frequency":
        return alternating(word, seed, 2 + min(rank // 5, 8))
    raise ValueError(f"no language of kind {kind}")


def vocabulary(kind: str, words: list[str], seed: str) -> dict[str, str]:
    """A map for the words in order of frequency. Forms that are taken get a number of letters more."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for rank, word in enumerate(words):
        form, extra = made_up(kind, word, seed, rank), 0
        while form in taken and kind not in ("substitution", "phonetic"):
            extra += 1
            form = alternating(word, f"{seed}+{extra}", len(word) + extra)
        taken.add(form)
        out[word] = form
    return out
