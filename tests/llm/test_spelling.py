import random
import re
import zlib
from collections import Counter

from larkspur.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {ord(c): c.lower() for c in spelling.UPPER}


def counted(rows):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[at + 1 :] == b[at + 1 :]
    return a[at + 1 :] == b[at:] if len(a) > len(b) else a[at:] == b[at + 1 :]


def brute(rows):
    n = counted(rows)
    out = {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= 10 * n[w] else None, len(others))
    root = lambda w: w if out[w][0] is None else root(out[w][0])
    return sorted((w, form or "", root(w), n[w], count, n[form] if form else -1) for w, (form, count) in out.items())


def corpus(seed=1):
    rng = random.Random(seed)
    letters = "abcdeXYZéÉß×÷ÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(60)]
    long = "".join(rng.choice("abc") for _ in range(3000))
    rows = []
    for i in range(160):
        run = []
        for _ in range(rng.choice([0, 3, 200])):
            w = rng.choice(base[: rng.choice([3, 20, 60])])
            if rng.random() < 0.1:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            run.append(w)
        rows.append((i, rng.choice([" ", "1", "中", "-"]).join(run)))
    rows += [(None, " ".join(base)), (None, None), (160, ""), (161, f"{long} {long} {long[:-1]}"), (162, f"{long[:-1]} {'b' + long[1:]} {'b' + long[1:]} aabbccd abbccdd " * 12)]
    return rows + rows[:20]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 2, "y") for i, t in rows], "doc_id bigint, text string, word string, n int, form string")
    out = spelling.variants(df)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in out.collect())


def test_against_brute_force(spark):
    rows = corpus()
    expected = brute(rows)
    assert sum(x[2] != x[0] for x in expected) > 50 and sum(x[4] > 0 and len(x[0]) > 2000 for x in expected) == 3
    assert run(spark, rows) == expected


def test_passes_of_small_filters_find_the_same(spark):
    df = spark.createDataFrame(list(counted(corpus()).items()), "word string, n bigint").repartition(3)
    pairs = lambda size: sorted(tuple(r) for r in spelling.near_pairs(df, size).collect())
    whole = pairs(spelling.FILTER_BYTES)
    words = counted(corpus())
    assert whole == sorted((a, words[a], b, words[b]) for a in words for b in words if near(a, b))
    assert pairs(4096) == whole


def test_chains_of_forms_reach_the_last(spark):
    tens = {"abcdefghi": 1, "abcdefgh": 20, "abcdefg": 300, "xbcdefg": 4000, "xycdefg": 50_000, "xyzdefg": 600_000}
    chain = spark.createDataFrame(list(zip(tens, list(tens)[1:])), "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(chain).collect()} == {(w, "xyzdefg") for w in list(tens)[:-1]}


def test_edits_of_a_word():
    letters = spelling._Letters(["abcabca", "ébcdefgh"])
    found = [set(), set()]
    for word, _, keys in letters.edits():
        for w, k in zip(word.tolist(), keys.tolist()):
            found[w].add(k)
    for w, edits in zip(["abcabca", "ébcdefgh"], found):
        alphabet = [chr(c) for c in spelling.ALPHABET]
        real = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet if c > w[i]}
        assert edits == set(spelling._Letters(sorted(real)).keys().tolist())


def test_without_words(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "short words 1234567890")]) == []
