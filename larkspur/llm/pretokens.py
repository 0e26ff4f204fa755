"""Pre-tokenisation without regular expressions.

Code points become class codes with the lookahead that the split rule needs (which
code points are letters, numbers or white space, the library whose split is to be
met is asked once, for all of them), and token boundaries follow from a small automaton over those codes. The automaton's
transition functions compose associatively, so a run of text is cut into blocks,
the function of every block is found for all blocks at once, a scan over blocks
gives the state in which each begins, and a second sweep marks the boundaries.

The rule is that of ``public_tokenizers.PATTERN``: contractions, then runs of
letters, numbers or other signs with an optional blank before them, then white
space, of which the last character before a word stands apart.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, LONE, WHITE = range(8)
CLASSES = 8
#: States: fresh (a token must start), within letters, numbers, signs or white space, after a leading blank, one or two letters of a contraction left.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, LED, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8
POINTS = 0x110000


ANCHORS = {OTHER: "!", LETTER: "a", NUMBER: "1"}
#: Code points that a library is asked about at once.
TOGETHER = 512


def _ask(whole: Callable[[list[str]], list[bool]]) -> bytes:
    """The class of every code point, as a library has it: where runs of one class begin, and their classes.

    whole: whether the library keeps each of some strings as one slice. Behind a letter, number or sign it does so only
    for further ones of its kind, so Python's Unicode table is put to it in strings of one kind; where one is cut, and
    for white space, each code point is asked about by itself.
    """
    kinds = {"L": LETTER, "N": NUMBER}
    guess = np.array([WHITE if chr(c).isspace() else kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(POINTS)], np.uint8)
    table = np.full(POINTS, WHITE, np.uint8)
    table[0xD800:0xE000] = OTHER  # a text holds no lone surrogate
    guess[0xD800:0xE000] = CLASSES
    members = {kind: np.flatnonzero(guess == kind) for kind in ANCHORS}
    groups = [(kind, own[at : at + TOGETHER]) for kind, own in members.items() for at in range(0, len(own), TOGETHER)]
    alone = [np.flatnonzero(guess == WHITE)]
    for (kind, part), sure in zip(groups, whole([ANCHORS[kind] + "".join(map(chr, part.tolist())) for kind, part in groups])):
        if sure:
            table[part] = kind
        else:
            alone.append(part)
    points = np.concatenate(alone)
    for kind, anchor in ANCHORS.items():
        table[points[np.array(whole([anchor + chr(c) for c in points.tolist()]))]] = kind
    edges = np.flatnonzero(np.append(True, table[1:] != table[:-1]))
    return np.stack([edges, table[edges]]).astype("<i4").tobytes()


@lru_cache(1)
def classes_of_tiktoken() -> bytes:
    """Classes as tiktoken has them for public_tokenizers.PATTERN. Called on the driver; workers get the result."""
    import public_tokenizers
    import tiktoken

    def whole(strings: list[str]) -> list[bool]:
        # A slice that is in the vocabulary becomes one id.
        ranks = {bytes([b]): b for b in range(256)} | {s.encode(): 256 + k for k, s in enumerate(strings)}
        encoding = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return [len(encoding.encode_ordinary(s)) == 1 for s in strings]

    return _ask(whole)


@lru_cache(2)
def classes_of_file(path: str) -> bytes:
    """Classes as the tokenizers library has them for the pre-tokenizer of a file. Called on the driver; workers get the result."""
    from tokenizers import Tokenizer

    slices = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    return _ask(lambda strings: [len(slices(s)) == 1 for s in strings])


@lru_cache(2)
def base_classes(runs: bytes) -> np.ndarray:
    """Class of each code point without lookahead."""
    edges, kinds = np.frombuffer(runs, "<i4").reshape(2, -1)
    return np.repeat(kinds.astype(np.uint8), np.diff(np.append(edges, POINTS)))


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this character."""
    if kind == LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (FRESH if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, state not in (IN_LETTERS, LED)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, LED)
    if kind in (OTHER, SHORT, LONG):
        if state in (IN_OTHER, LED):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SHORT: ONE_LEFT, LONG: TWO_LEFT}[kind], True
    if kind == BLANK:
        return LED, True
    if kind == LONE:
        return FRESH, True
    return IN_WHITE, state != IN_WHITE


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Flat tables over code * STATES + state. Codes from CLASSES on are first characters of a text: they act as from FRESH."""
    move = np.empty((2 * CLASSES, STATES), np.intp)
    mark = np.empty((2 * CLASSES, STATES), bool)
    for kind in range(CLASSES):
        for state in range(STATES):
            move[kind, state], mark[kind, state] = _step(state, kind)
        move[CLASSES + kind] = _step(FRESH, kind)[0]
        mark[CLASSES + kind] = True
    return move.ravel(), mark.ravel()


def codes(points: np.ndarray, starts: np.ndarray, classes: bytes) -> np.ndarray:
    """Class codes with lookahead. starts: where non-empty texts begin."""
    n = len(points)
    kind = base_classes(classes)[points]
    final = np.zeros(n + 2, bool)  # last character of a text
    final[starts[1:] - 1] = True
    final[n - 1 :] = True
    white = kind == WHITE
    follow = np.zeros(n, bool)  # a character follows in the text, and it is not white
    follow[:-1] = ~white[1:] & ~final[: n - 1]
    led = white & follow
    out = kind - led.view(np.uint8)  # LONE comes before WHITE, and BLANK before that
    out -= (led & (points == 32)).view(np.uint8)
    at = np.flatnonzero(points == 39)
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one = np.where(final[at], 0, padded[at + 1])
        two = np.where(final[at] | final[at + 1], 0, padded[at + 2])
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        is_long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[at[is_long]] = LONG
    out[starts] += CLASSES
    return out


def scan(code: np.ndarray, width: int = 512, lead: int = 16) -> np.ndarray:
    """Where tokens start, by composing the transition functions of blocks.

    The function of a block is a vector: the state after the block for each state
    before it. After ``lead`` characters nearly every such vector is constant, so
    that from there on one number stands for it; the others go on in full.
    """
    n = len(code)
    move, mark = tables()
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.uint8)
    np.multiply(code, STATES, out=padded[:n])
    sweep = np.ascontiguousarray(padded.reshape(blocks, width).T)
    function = np.broadcast_to(np.arange(STATES), (blocks, STATES)).copy()
    for row in sweep[:lead]:
        np.add(function, row[:, None], out=function)
        function = move.take(function)
    open_ = np.flatnonzero((function != function[:, :1]).any(1))
    constant = function[:, 0].copy()
    for row in sweep[lead:]:
        np.add(constant, row, out=constant)
        constant = move.take(constant)
    if len(open_):
        full = function[open_]
        for row in sweep[lead:]:
            full = move.take(full + row[open_][:, None])
        function = np.repeat(constant[:, None], STATES, 1)
        function[open_] = full
        state, now = np.empty(blocks, np.intp), FRESH
        for b, f in enumerate(function.tolist()):  # the state in which each block begins
            state[b] = now
            now = f[now]
    else:
        state = np.concatenate([[FRESH], constant[:-1]])
    found = np.empty((width, blocks), bool)
    for k, row in enumerate(sweep):
        at = state + row
        mark.take(at, out=found[k])
        state = move.take(at)
    return np.ascontiguousarray(found.T).ravel()[:n]


def split(buf: np.ndarray, offsets: np.ndarray, classes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which tokens start (and the end), and for each text the index of its first token (one more entry than texts)."""
    n = len(buf)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.flatnonzero((buf & 0xC0) != 0x80)  # first byte of each character
    texts = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts = np.searchsorted(heads, texts)
    bounds = heads[np.flatnonzero(scan(codes(points, starts, classes)))]
    return np.append(bounds, n), np.searchsorted(bounds, offsets)
