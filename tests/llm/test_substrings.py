import hashlib
import random

import numpy as np

from larkspur.llm import substrings


def brute(rows, window=20):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in sorted((r for r in split if r[0] is not None), key=lambda r: r[0]):
        for s in range(len(words) - window + 1):
            first.setdefault(tuple(words[s : s + window]), (i, s))
    out = {}
    for i, words in split:
        own, gone = {}, set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if (i is not None and first[key] != (i, s)) or own.setdefault(key, s) != s:
                gone.update(range(s, s + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rng = random.Random(2)
    words = ["a", "b", "é", "Wort", "x", "yy", "zzz", *[f"w{k}" for k in range(60)]]
    passages = [[rng.choice(words) for _ in range(rng.choice([19, 20, 21, 55, 90]))] for _ in range(8)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p)) if rng.random() < 0.4 else 0
            text += p[cut:] + [rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(text)))
    rows += [(200, rows[4][1]), (1, rows[5][1]), (201, "x " * 100), (202, "x " * 100), (203, "a b " * 50), (204, None), (205, ""), (206, " \n"), (207, "one"), (None, "q " * 40), (208, "longword" * 50 + " y" * 40_000)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, first int, w string")
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(df).collect()}
    assert out == brute(rows)
    beyond = substrings.remove_repeats(df, broadcast_anchors=0).collect()  # the way for anchors that are too many to broadcast
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in beyond} == out


def test_periodic_text_breaks_passages(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(15, 4000)))) for k in range(8)]
    rows += [(k, " ".join((["a"] * rng.randint(10, 30) + ["b"]) * 4)) for k in range(10, 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(df).collect()} == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id bigint, text string")
    assert [r.n_removed for r in substrings.remove_repeats(df).collect()] == [0, 0]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_rows_of_one_id(spark):
    t, u = (" ".join(f"{c}{k}" for k in range(40)) for c in "tu")
    rows = [(1, t), (2, t), (2, u), (3, u), (4, f"{t} {u}"), (2, t)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), keep_text=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in out) == [(1, 40, 0), (2, 40, 0), (2, 40, 40), (2, 40, 40), (3, 40, 40), (4, 80, 80)]
    assert [r.kept for r in out if r.doc_id == 2 and not r.n_removed] == [u]


def test_words_of_like_structure(spark):
    x, y = ("".join(p[bin(k).count("1") % 2] for k in range(1024)) for p in ("ab", "ba"))
    shared = " ".join(f"w{k}" for k in range(19))
    df = spark.createDataFrame([(1, f"{shared} {x}"), (2, f"{shared} {y}")], "doc_id bigint, text string")
    assert [r.n_removed for r in substrings.remove_repeats(df).collect()] == [0, 0]


def test_many_repeaters_of_parts(spark):
    """Passages of one document that different sets of later ones repeat, in other orders and in part."""
    rng = random.Random(9)
    source = [f"s{k}" for k in range(400)]
    rows = [(0, " ".join(source))]
    for i in range(1, 40):
        text = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(380)
            text += source[a : a + rng.randint(5, 120)] + [f"u{i}"] * rng.randint(0, 3)
        rows.append((i, " ".join(text)))
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute(rows)


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    out = substrings.remove_repeats(df, keep_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute(rows)
    texts = dict(rows)
    for r in out:
        assert r.kept == texts[r.doc_id] if not r.n_removed else len(r.kept.encode().split()) == r.n_words - r.n_removed


def test_least_places():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 9, 200).astype(np.uint64)
    assert substrings.least_places(g, 13).tolist() == [i + int(np.argmin(g[i : i + 13])) for i in range(188)]
