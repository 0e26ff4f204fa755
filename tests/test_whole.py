"""Queries reach every document: tables of their own that are larger than any cut the plans once had."""

import hashlib
import random
import re

import duckdb
import pytest

from larkspur import registry
from larkspur.operators import models
from larkspur.plans import bridge
from tests.test_oracles import rows

N = 300
LINES = ["A HEADING", "# marked", "- an item", "12. numbered item", "> quoted by Ada Lovelace", "plain words", "", "  ", "Jane Doe has 3 of them " + "and so on " * 30]


def texts():
    """Documents of several lines; the first word names the document."""
    rng = random.Random(5)
    return [(k, "\n".join([f"word{k} and the rest", *(rng.choice(LINES) for _ in range(rng.randint(0, 12)))])) for k in range(N)]


TEXTS = texts()


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    """300 documents and 600 events."""
    d = str(tmp_path_factory.mktemp("own"))
    spark.createDataFrame(TEXTS, "doc_id bigint, text string").selectExpr("*", "element_at(array('de', 'en', 'es', 'fr'), int(doc_id % 4) + 1) AS lang", "concat('src', doc_id % 30) AS source", "length(text) AS n_chars").write.parquet(f"{d}/documents.parquet")
    spark.range(2 * N).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 16 AS user_id", "element_at(array('view', 'click', 'purchase', 'signup', 'error'), int(id % 5) + 1) AS event_type", "id % 90 / 1.0D AS value", "concat('{\"k\": ', id % 100, '}') AS props"
    ).write.parquet(f"{d}/events.parquet")
    return d


@pytest.fixture(scope="module")
def duck(own):
    c = duckdb.connect()
    for t in ("documents", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{own}/{t}.parquet/*.parquet'")
    return c


def same(spark, duck, own, name):
    df = registry.QUERIES[name](spark, own)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_items_are_all_documents(spark, own):
    v = bridge.views(spark, own)
    ids = {f"i{k}" for k in range(N)}
    assert {r.item_id for r in v.items.select("item_id").collect()} == ids
    assert {r.item_id for r in v.evals.select("item_id").collect()} == ids
    assert v.questions.count() == N and v.scrambled.count() == 3 * N
    assert {r.question_id for r in v.levels.select("question_id").collect()} == {f"i{k % N}" for k in range(2 * N) if k % 5 != 1}
    assert registry.QUERIES["j14_tasks"](spark, own).select("item_id").distinct().count() == N
    assert len(registry.QUERIES["io26_csv_lines"](spark, own).collect()) == N


@pytest.mark.parametrize("name", ["a2_metrics_by_domain", "j1_evals_items", "j14_tasks", "u3_distinct", "w8_stratified_sample", "io26_csv_lines", "x2_benchmark_run", "canonical_metrics", "st8_thresholds", "j5_left_outer"])
def test_items_against_sql(spark, duck, own, name):
    same(spark, duck, own, name)


def kind(line):
    if line[0] == "#" or (re.search("[^\\W\\d_]", line) and line.upper() == line and len(line) < 100):
        return "heading"
    if re.match("[-*•] ", line):
        return "list"
    if re.match("[0-9]+\\. ", line):
        return "numbered_list"
    return "quote" if line[0] in '>"' else "paragraph"


def sections(text):
    return [(i, x.strip(" ")) for i, x in enumerate(text.split("\n")) if x.strip(" ")]


def weight(line):
    base = {"heading": 0.8, "list": 0.6, "numbered_list": 0.6, "quote": 0.4, "paragraph": 0.5}[kind(line)]
    return min(1, base + 0.2 * min(1, len(line.split()) / 50) + 0.1 * bool(re.search("[0-9]", line)) + 0.1 * bool(re.search("[A-Z][a-z]+ [A-Z][a-z]+", line)))


def test_sections_of_all_documents(spark, own):
    run = lambda name: registry.QUERIES[name](spark, own).collect()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    lines = {(k, i): x for k, t in TEXTS for i, x in sections(t)}
    assert {(r.doc_id, r.position): r.content for r in run("f27_sections")} == {at: md5(x) for at, x in lines.items()}
    assert {(r.doc_id, r.position): r.kind for r in run("f28_section_types")} == {at: kind(x) for at, x in lines.items()}
    assert {(r.doc_id, r.position): round(r.importance, 9) for r in run("f29_importance")} == {at: round(weight(x), 9) for at, x in lines.items()}
    whole = {k: [x for _, x in sections(t)] for k, t in TEXTS}
    assert {r.doc_id: r.result for r in run("t16_reconstruct")} == {k: md5("\n\n".join(x)) for k, x in whole.items()}
    assert {r.doc_id: (r.sections, r.chars) for r in run("a67_section_stats")} == {k: (len(x), sum(map(len, x))) for k, x in whole.items()}
    others = {k: [x for x in own_lines if kind(x) != "heading"] for k, own_lines in whole.items()}
    moved = {k: "\n\n".join(x if kind(x) == "heading" else others[k].pop() for x in own_lines) for k, own_lines in whole.items()}
    assert {r.doc_id: r.result for r in run("t15_structure")} == moved


def test_normalized_in_every_language(spark, tmp_path):
    texts = [("de", "  Über  GRÖẞE, Maß\nund Ähre! "), ("es", "¿Qué AÑO? _Él_"), ("fr", "L'ÉTÉ à Nîmes:  Œuvre"), (None, "No Language."), ("en", "A b, C")]
    spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    clean = lambda t: re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", t.strip().lower()))
    got = {r.doc_id: r.normalized for r in registry.QUERIES["f7_normalized"](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5(clean(t).encode()).hexdigest() for k, (_, t) in enumerate(texts)}


def test_whole_text_is_looked_for(spark, tmp_path):
    said = [("the cat", "I saw The Cat there"), ("the cat", "the dog"), (" what ", "so what?"), ("what is it", "what else")]
    turns = [(k, t, role, text) for k, pair in enumerate(said) for t, (role, text) in enumerate(zip(("user", "assistant"), pair))]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.correct for r in registry.QUERIES["f2_substring_match"](spark, str(tmp_path)).collect()}
    assert got == {k: a.strip().lower() in b.strip().lower() for k, (a, b) in enumerate(said)}


def test_rounds_of_the_reference(spark, own, monkeypatch):
    asked = {}
    for name in ("permutation_test", "bootstrap_mean"):
        monkeypatch.setattr(models, name, lambda df, *rest, name=name: asked.update({name: rest[-1]}) or df)
    for name in ("st11_permutation", "st12_bootstrap"):
        registry.QUERIES[name](spark, own)
    assert asked == {"permutation_test": 2000, "bootstrap_mean": 2000}


def test_resampling_against_known_figures(spark):
    values = [("a", float(k < 400)) for k in range(1000)] + [("b", float(k < 480)) for k in range(1000)] + [("b", None), ("c", 1.0)]
    df = spark.createDataFrame(values, "g string, x double")
    far = models.permutation_test(df, "a", "b", 2000).first()
    assert far.observed == pytest.approx(-0.08) and 0 < far.p < 0.004
    assert models.permutation_test(df.filter("g = 'a' or x is null or x = 1"), "a", "b", 2000).first().p == 1 / 2001
    few = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)], "g string, x double")
    assert models.permutation_test(few, "a", "b", 2000).first().p == pytest.approx(1 / 3, abs=0.05)
    got = {r.g: r for r in models.bootstrap_mean(df, "g", 2000).collect()}
    error = (0.4 * 0.6 / 1000) ** 0.5
    assert got["a"].mean == pytest.approx(0.4, abs=0.002)
    assert (got["a"].low, got["a"].high) == (pytest.approx(0.4 - 1.96 * error, abs=0.003), pytest.approx(0.4 + 1.96 * error, abs=0.003))
    assert (got["c"].mean, got["c"].low, got["c"].high) == (1, 1, 1)
    assert models.permutation_test(df.limit(0), "a", "b", 9).collect() == [] == models.bootstrap_mean(df.limit(0), "g", 9).collect()
