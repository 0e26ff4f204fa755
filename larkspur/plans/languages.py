"""Constructed languages, proper nouns, answers in perturbed documents and stand-in models (inventory T, F, X, V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import languages as L
from larkspur.functions import text as T
from larkspur.functions import transform as X
from larkspur.functions.answers import transformed_answer
from larkspur.functions.text import mapped_tokens
from larkspur.operators import vocabulary
from larkspur.registry import query

#: Frequent words of the languages in the test data.
FREQUENT = ["the", "and", "of", "to", "in", "that", "is", "for", "with", "der", "die", "und", "la", "de", "el", "le"]


def _literal(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in table.items()) + "}"


def _sql(kind: str) -> str:
    table = _literal(L.vocabulary(kind, FREQUENT, "s"))
    return f"SELECT item_id, list_aggregate(list_transform(regexp_extract_all(text, '([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+)'), lambda t: coalesce({table}[lower(t)], t)), 'string_agg', '') result FROM benchmark"


def _language(name: str, kind: str) -> None:
    @query(name, _sql(kind))
    def translated(v):
        return v.raw("benchmark").select("item_id", mapped_tokens(F.col("text"), L.vocabulary(kind, FREQUENT, "s")).alias("result"))


for _name, _kind in (("t7_synthetic", "synthetic"), ("t8_english_like", "english_like"), ("t9_random_frequency", "random_frequency"), ("t6_scrambled_words", "scrambled")):
    _language(_name, _kind)


LETTER = "substr('{0}', CAST(CAST('0x' || substr(md5('s:' || word || ':' || i), 1, 4) AS INTEGER) % {1} AS INTEGER) + 1, 1)"


def counted(v):
    """Words of all documents with their occurrences and a class: how often their number doubles until that of the most frequent word."""
    w = v.raw("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    times = F.floor(w.agg(F.max("n")).scalar() / F.col("n")).cast("bigint")
    return w.withColumn("class", (F.length(F.bin(times)) - 1).cast("bigint"))


def by_frequency(word, class_, nth: int = 0):
    """A made-up word of two letters and one for each class, so that frequent words are short, and one more in each round."""
    return X.pseudo_word(F.concat(word, F.lit("+" * nth)), "s", L.CONSONANTS, L.VOWELS, (class_ + 2 + nth).cast("int"))


@query("t21_pseudo_words", f"""WITH w AS (SELECT word, count(*) n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) word FROM documents) GROUP BY word),
c AS (SELECT word, n, CAST(floor(log2((SELECT max(n) FROM w) // n + 0.5)) AS BIGINT) AS class FROM w)
SELECT word, n, class, array_to_string(list_transform(range(1, class + 3), lambda i: CASE WHEN i % 2 = 1 THEN {LETTER.format(L.CONSONANTS, len(L.CONSONANTS))} ELSE {LETTER.format(L.VOWELS, len(L.VOWELS))} END), '') form FROM c""")
def pseudo_words(v):
    return counted(v).withColumn("form", by_frequency(F.col("word"), F.col("class")))


@query("t9_frequency_forms")
def frequency_forms(v):
    """A form for every word of the documents, as long as its frequency tells, longer where shorter ones are taken; no form for two words."""
    w = counted(v).select("word", "class")
    return vocabulary.unique_forms(w, lambda word, nth: by_frequency(word, F.col("class"), nth))


COMMON = FREQUENT[:9]


@query("t4_common_words", f"""SELECT doc_id, md5(list_aggregate(list_transform(p, lambda t, i: CASE WHEN regexp_full_match(t, '[0-9]+') OR (i > 1 AND regexp_full_match(t, '\\p{{Lu}}\\p{{Ll}}+')) THEN t
 ELSE coalesce({_literal(L.vocabulary("english_like", COMMON, "s"))}[lower(t)], translate(t, '{X.LOWER + X.LOWER.upper()}', '{X.rotated(13) + X.rotated(13).upper()}')) END), 'string_agg', '')) result FROM (SELECT doc_id, regexp_extract_all(text, '([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+)') p FROM documents)""")
def common_words(v):
    """The substitution language: common words have made-up forms, all others are enciphered; numbers and names stay."""
    return v.raw("documents").select("doc_id", F.md5(X.translated(F.col("text"), L.vocabulary("english_like", COMMON, "s"), 13)).alias("result"))


@query("f32_proper_nouns")
def proper_nouns(v):
    """No SQL: DuckDB's word boundaries know ASCII letters only."""
    nouns = T.proper_nouns(F.col("text"))
    return v.raw("documents").select("doc_id", F.size(nouns).alias("n"), F.array_join(nouns, "|").alias("nouns"))


@query("f33_person_or_place", r"""WITH n AS (SELECT item_id, unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?')) AS name FROM benchmark)
SELECT name, CASE WHEN regexp_full_match(name, '\p{Lu}\p{Ll}{2,11}') OR regexp_full_match(name, '\p{Lu}\p{Ll}{1,11} \p{Lu}\p{Ll}{1,11}') THEN 'person' WHEN regexp_matches(name, '(land|burg|ville|ton|ford)$') THEN 'place' ELSE 'other' END kind, count(*) n FROM n GROUP BY ALL""")
def person_or_place(v):
    """Capitalised words and pairs of them in all items: persons are tested first."""
    names = v.raw("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?)"), 1)).alias("name"))
    person = F.rlike("name", F.lit(r"^\p{Lu}\p{Ll}{2,11}$")) | F.rlike("name", F.lit(r"^\p{Lu}\p{Ll}{1,11} \p{Lu}\p{Ll}{1,11}$"))
    place = F.rlike("name", F.lit("(land|burg|ville|ton|ford)$"))
    return names.groupBy("name", F.when(person, "person").when(place, "place").otherwise("other").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("t13_noun_swap")
def noun_swap(v):
    """Every item under the three strategies; a noun has one stand-in for each throughout."""
    found = v.raw("benchmark").select("item_id", "text", T.proper_nouns(F.col("text")).alias("nouns"))
    return found.select("item_id", F.size("nouns").alias("n"), *[X.noun_swap(F.col("text"), F.col("nouns"), s).alias(s) for s in ("random", "thematic", "phonetic")])


@query("t17_answer_by_type", f"""SELECT conv_id, turn, CASE WHEN lower(trim(predicted)) IN ('yes', 'no') THEN predicted WHEN regexp_full_match(trim(predicted), '[0-9.]+') THEN predicted ELSE translate(predicted, '{X.LOWER + X.LOWER.upper()}', '{X.rotated(3) + X.rotated(3).upper()}') END result FROM qa_pairs""")
def answer_by_type(v):
    keep = F.lower(F.trim("predicted")).isin("yes", "no") | F.rlike(F.trim("predicted"), F.lit("^[0-9.]+$"))
    return v.qa_pairs.select("conv_id", "turn", F.when(keep, F.col("predicted")).otherwise(X.caesar(F.col("predicted"), 3)).alias("result"))


@query("t17_answer_kinds")
def answer_kinds(v):
    """Answers of all turns by kind, in a question whose words were exchanged, and in the language of the cipher."""
    mapping = L.vocabulary("english_like", FREQUENT, "s")
    asked = v.qa_pairs.withColumns({"kind": T.answer_type(F.col("predicted")), "changed": mapped_tokens(F.col("question"), mapping)})
    made = transformed_answer(F.col("predicted"), F.col("kind"), F.col("question"), F.col("changed"), mapping, lambda c: X.translated(c, mapping, 3))
    return asked.select("conv_id", "turn", "kind", made.alias("made")).select("conv_id", "turn", "kind", F.md5("made.answer").alias("answer"), "made.confidence")


@query("f48_answer_span", f"SELECT doc_id, position(translate(regexp_extract(text, '^\\s*([^\\n]*[^\\s])', 1), '{X.LOWER}', '{X.rotated(3)}') IN translate(text, '{X.LOWER}', '{X.rotated(3)}')) AS place, length(regexp_extract(text, '^\\s*([^\\n]*[^\\s])', 1)) AS n FROM documents")
def answer_span(v):
    """Where the whole answer, here a text's first line, stands in the text, both in the other language, and its length."""
    moved = lambda c: F.translate(c, X.LOWER, X.rotated(3))
    answer = T.first_line(F.col("text"))
    return v.raw("documents").select("doc_id", F.position(moved(answer), moved(F.col("text"))).cast("bigint").alias("place"), F.length(answer).cast("bigint").alias("n"))


def confidence_of(answer: str, text: str):
    """0.9 for an abstractive answer; else 1 where the whole answer stands in the text, and half of that times 0.7 where it has no span."""
    return F.when(T.answer_type(F.col(answer)) == "abstractive", 0.9).when(F.contains(F.lower(text), F.lower(answer)), 1.0).otherwise(0.35)


@query("f39_confidence", r"SELECT conv_id, turn, CAST(CASE WHEN NOT contains(question, ',') AND NOT contains(question, ';') AND len(list_filter(regexp_split_to_array(question, '\s+'), lambda w: w <> '')) > 10 THEN 0.9 WHEN contains(lower(predicted), lower(question)) THEN 1.0 ELSE 0.35 END AS DOUBLE) confidence FROM qa_pairs")
def confidence(v):
    return v.qa_pairs.select("conv_id", "turn", confidence_of("question", "predicted").alias("confidence"))


@query("f40_qa_flags", "SELECT conv_id, turn, length(trim(question)) > 0 AS has_question, length(trim(predicted)) > 0 AS has_answer, question <> predicted AS changed FROM qa_pairs")
def qa_flags(v):
    return v.qa_pairs.select("conv_id", "turn", (F.length(F.trim("question")) > 0).alias("has_question"), (F.length(F.trim("predicted")) > 0).alias("has_answer"), (F.col("question") != F.col("predicted")).alias("changed"))


@query("v1_sql_function", "SELECT model_id, round(greatest(0, least(1, 1 - s / nullif(a, 0))), 6) ldc FROM (SELECT model_id, avg(CASE WHEN transform = 'original' THEN CAST(is_correct AS INTEGER) END) a, avg(CASE WHEN transform = 'scramble' THEN CAST(is_correct AS INTEGER) END) s FROM evals GROUP BY model_id)")
def sql_function(v):
    v.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dependency(base DOUBLE, scrambled DOUBLE) RETURNS DOUBLE RETURN greatest(0.0D, least(1.0D, 1 - try_divide(scrambled, base)))")
    means = v.evals.groupBy("model_id").agg(*[F.avg(F.when(F.col("transform") == t, F.col("is_correct").cast("double"))).alias(n) for t, n in (("original", "a"), ("scramble", "s"))])
    return means.select("model_id", F.round(F.expr("dependency(a, s)"), 6).alias("ldc"))


@query("x2_benchmark_run", "SELECT item_id, substr('ABCD', CAST(CAST('0x' || substr(md5('Q: ' || question), 1, 2) AS INTEGER) % 4 AS INTEGER) + 1, 1) response FROM items")
def benchmark_run(v):
    from larkspur.functions.responder import answered

    prompts = v.items.select("item_id", F.concat(F.lit("Q: "), "question").alias("prompt"))
    return answered(prompts).select("item_id", "response")
