import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from larkspur.llm import bpe
from larkspur.llm.common import materialise
from tests.llm import test_dedup, test_mixing, test_substrings


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "MinHash near-dedup", "substring dedup", "mixing", "byte-level BPE"]

    good = materialise(stages["quality classifier"](spark, docs, sf), "t1")
    kept = {r.doc_id for r in good.collect()}
    known = [i for i in labels if labels[i] is not None]
    assert good.columns == docs.columns and sum((i in kept) == bool(labels[i]) for i in known) >= 0.95 * len(known)

    single = materialise(stages["MinHash near-dedup"](spark, good, sf), "t2")
    expected = test_dedup.brute([(r.doc_id, r.text) for r in good.collect()], percent=80)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {i for i, (_, _, k) in expected.items() if k}

    cut = materialise(stages["substring dedup"](spark, single, sf), "t3")
    before = {r.doc_id: r.text for r in single.collect()}
    expected = test_substrings.brute(list(before.items()))
    after = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and set(after) == set(before)
    for i, (_, removed, digest) in expected.items():
        assert hashlib.sha256(b" ".join(after[i].text.encode().split())).hexdigest() == digest
        assert removed or after[i].text == before[i]
        assert after[i].n_chars == len(after[i].text)

    mixed = materialise(stages["mixing"](spark, cut, sf), "t4")
    goal, taken, out = test_mixing.check(spark, cut)
    copies = {r.doc_id: r.copies for r in out if r.copies}
    rows = mixed.collect()
    assert mixed.columns == docs.columns and len(rows) == sum(copies.values()) and {r.doc_id for r in rows} == set(copies)

    ids = stages["byte-level BPE"](spark, mixed, sf).collect()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks, special_tokens={})
    assert len(ids) == len(rows)
    for r in ids:
        text = after[r.doc_id].text
        assert r.ids == encoding.encode_ordinary(text) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


ODD = [
    (1, "a b c d e f g h", None, "s", 15, "x", 1),
    (1, "a b c d e f g h", None, "s", 15, "x", 1),  # a repeated row
    (1, "another text of this id entirely, nothing like it", "en", "s", 15, "y", 2),
    (2, "a B c d e f g h", "en", None, 15, None, None),  # a copy of the first
    (3, None, None, None, None, None, None),
    (4, "", "en", "t", 0, "", 0),
    (None, "no id at all but some words in it", "en", "t", 1, "", 0),
    (5, "long " * 40_000, "en", "t", 200_000, "", 0),
    (6, " ".join(f"w{k}" for k in range(60)), "en", "t", 1, "", 0),
    (7, " ".join(f"w{k}" for k in range(60)) + " " + " ".join(f"v{k}" for k in range(60)), "en", "t", 1, "", 0),
]
CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, version string, size int"


def test_odd_rows_in_every_stage(spark, sf):
    """Nulls, empty and very long texts, repeated rows, an id with two texts, columns named like a stage's own, and no rows."""
    docs = spark.createDataFrame(ODD, CLASHING)
    rows = lambda df: sorted((str(r.doc_id), str(r.text)[:20], r.version or "") for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, sf)
        assert out.columns == docs.columns and stages[name](spark, docs.limit(0), sf).count() == 0, name
        assert set(rows(out)) <= set(rows(docs)) or name == "substring dedup"

    single = stages["MinHash near-dedup"](spark, docs, sf)
    assert rows(single) == [r for r in rows(docs) if r[0] != "2"]  # the copy goes, the other text of id 1 stays
    cut = {(r.doc_id, r.version): r for r in stages["substring dedup"](spark, docs, sf).collect()}
    assert cut[7, ""].text == " ".join(f"v{k}" for k in range(60)) and cut[7, ""].n_chars == len(cut[7, ""].text)
    assert cut[1, "x"].text == ODD[0][1] and cut[1, "y"].text == ODD[2][1] and cut[3, None].text is None
    assert stages["mixing"](spark, docs, sf).filter("text is not null and length(text) > 0").count() > 0
    ids = stages["byte-level BPE"](spark, docs, sf).collect()
    assert len(ids) == len(ODD) and sorted(r.n_tokens for r in ids)[:2] == [0, 0]
    assert stages["byte-level BPE"](spark, docs.limit(0), sf).count() == 0


def test_pairs_near_the_threshold(spark, sf):
    """Pairs of similarity 0.80 to 0.85 are linked, pairs just below are not."""
    rows, expected = [], set()
    for k in range(40):
        words = [f"{k}w{j}" for j in range(210)]
        at = 100 + k  # one changed word in the middle and a cut at the end set the similarity
        other = [*words[:at], "changed", *words[at + 1 : 170 + k]]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    brute = test_dedup.brute(rows, percent=80)
    expected = {i for i, (_, _, kept) in brute.items() if kept}
    assert len(rows) // 2 < len(expected) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, docs, sf).collect()} == expected
