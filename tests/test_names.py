"""Proper nouns, their stand-ins and blank-line sections against plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from larkspur import registry
from larkspur.functions import text as T
from larkspur.functions import transform as X


def nouns(text):
    words = re.findall(r"\b[A-Z][a-zA-Z]+\b", text)
    starters = {m.group() for s in re.split("[.!?]+", text) if (m := re.match(r"[A-Z][a-zA-Z]+\b", s.strip()))}
    single = {w for w in words if w not in starters and w not in T.FUNCTION_WORDS and len(w) >= 3}
    return sorted(single | set(re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", text)))


ODD = ["", "I saw Bob. Then Ann Lee\nsmiled! The Dog", "Ño Éa XyZ ABC Ñab Zoë O'Neil", "Al went. Al stayed? so Al", "A. B. Cat dog Cat", None]


def test_proper_nouns_of_all_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.nouns for r in registry.QUERIES["f32_proper_nouns"](spark, sf).collect()}
    assert got == {i: "|".join(nouns(t)) for i, t in texts.items()} and any(got.values())
    out = spark.createDataFrame([(t,) for t in ODD], "t string").coalesce(1).select(T.proper_nouns(F.col("t"))).collect()
    assert [r[0] for r in out] == [None if t is None else nouns(t) for t in ODD]


def kind(noun):
    if re.fullmatch("[A-Z][a-z]{2,11}", noun) or re.fullmatch("[A-Z][a-z]{1,11} [A-Z][a-z]{1,11}", noun):
        return "person"
    return "place" if re.search("(land|burg|ville|ton|ford)$", noun) else "other"


def test_stand_ins(spark, sf):
    seen = {s: {} for s in ("random", "thematic", "phonetic")}
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for r in registry.QUERIES["t13_noun_swap"](spark, sf).collect():
        text, own = texts[r.item_id], nouns(texts[r.item_id])
        pieces = re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b|\w+|\W+", text)
        for s in seen:
            # take the text apart along what must not have changed
            form = "".join("(.+?)" if p in own else re.escape(p) for p in pieces)
            found = re.fullmatch(form, r[s], re.S)
            assert found, (text, r[s])
            if found.lastindex == 1:
                seen[s].setdefault(next(p for p in pieces if p in own), set()).add(found.group(1))
    assert all(len(v) == 1 for s in seen.values() for v in s.values())
    asked = ["Bob", "Ann Lee", "Northumberlandshireford", "Quite Long Business Name", "Gustav", "Fern", "Xyzzy"]
    rows = spark.createDataFrame([(a,) for a in asked], "n string").select("n", *[X.stand_in(F.col("n"), s).alias(s) for s in seen]).collect()
    for r in rows:
        k = kind(r.n)
        assert r.random == X.STAND_INS[k][int(hashlib.md5(f"n:{r.n}".encode()).hexdigest()[:4], 16) % len(X.STAND_INS[k])]
        assert r.thematic in [*X.STAND_INS.values()][ord(r.n[0]) % 3]
        near = [x for x in X.STAND_INS[k] if abs(len(x) - len(r.n)) <= X.BANDS[k]] or X.STAND_INS[k]
        assert r.phonetic in near
    assert {r.n: r.phonetic for r in rows}["Gustav"] in ("Gus", *[x for x in X.STAND_INS["person"] if abs(len(x) - 6) <= 2])


def test_document_forms(spark, tmp_path):
    """Sections between blank lines, some with more than one line; headings stay, the others change places, and the hybrid is the translation of that."""
    said = [("# Title\n\nfirst part\nof two lines\n \n- a list", "Answer one\n\n\nthe last"), ("only", "two"), ("x\n\n", "HEAD\n\ny")]
    turns = [(k, t, role, text) for k, pair in enumerate(said) for t, (role, text) in enumerate(zip(("user", "assistant"), pair))]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: {r.conv_id: r for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    moved = {0: ["# Title", "the last", "Answer one", "- a list", "first part\nof two lines"], 1: ["two", "only"], 2: ["y", "HEAD", "x"]}
    out = run("t15_document_forms")
    assert {k: r.structural for k, r in out.items()} == {k: md5("\n\n".join(x)) for k, x in moved.items()}
    assert {k: r.moved for k, r in out.items()} == {0: 4, 1: 2, 2: 2}
    shifted = lambda t: spark.createDataFrame([(t,)], "t string").select(X.phonetic(F.col("t"), registry_language())).first()[0]
    for k, (a, b) in enumerate(said):
        assert out[k].translation == md5(shifted(f"{a}\n\n{b}")) and out[k].hybrid == md5(shifted("\n\n".join(moved[k])))
    assert {k: r.result for k, r in run("t16_blank_line_reconstruct").items()} == {0: md5("# Title\n\nfirst part\nof two lines\n\n- a list\n\nAnswer one\n\nthe last"), 1: md5("only\n\ntwo"), 2: md5("x\n\nHEAD\n\ny")}


def registry_language():
    from larkspur.plans.rewriting import PHONETIC_LANGUAGE

    return PHONETIC_LANGUAGE
