"""Text perturbations and document structure (inventory T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import transform as X
from larkspur.registry import query

ALPHABET = X.LOWER + X.LOWER.upper()
#: Letter groups and what replaces them, in order.
PHONETIC = [("ch", "kh"), ("sh", "sh"), ("th", "dh"), ("ph", "f"), ("tion", "sion"), ("ck", "k"), ("qu", "kw")]
SYNONYMS = {"the": "this", "and": "plus", "of": "from", "to": "towards", "is": "equals"}
PIECES = r"'([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)'"


def scramble_sql(level: str) -> str:
    return f"""SELECT item_id, {level} AS level, list_aggregate(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN list_contains(chosen, i) THEN substr('{X.SYMBOLS}', CAST(i % {len(X.SYMBOLS)} AS INTEGER) + 1, 1) ELSE substr(text, i, 1) END), 'string_agg', '') AS scrambled
 FROM (SELECT item_id, text, list_transform(list_slice(list_sort(list_transform(places, lambda i: {{'h': md5('s:' || item_id || ':' || i), 'i': i}})), 1, CAST(floor(len(places) * {level}) AS BIGINT)), lambda s: s.i) chosen
 FROM (SELECT item_id, text, list_filter(range(1, length(text) + 1), lambda i: regexp_full_match(substr(text, i, 1), '[A-Za-z0-9]')) places FROM benchmark))"""


@query("t1_original", "SELECT item_id, text AS result, 'original' AS transform FROM benchmark")
def original(v):
    return v.raw("benchmark").select("item_id", F.col("text").alias("result"), F.lit("original").alias("transform"))


@query("t2_scramble", scramble_sql("0.3"))
def scramble(v):
    return v.raw("benchmark").select("item_id", F.expr("0.3BD").alias("level"), X.scramble(F.col("text"), 0.3, "s", F.col("item_id").cast("string")).alias("scrambled"))


@query("t3_scramble_levels", " UNION ALL ".join(scramble_sql(x) for x in ("0.1", "0.5")))
def scramble_levels(v):
    out = [v.raw("benchmark").select("item_id", F.expr(f"{x}BD").alias("level"), X.scramble(F.col("text"), x, "s", F.col("item_id").cast("string")).alias("scrambled")) for x in (0.1, 0.5)]
    return out[0].unionAll(out[1])


@query("f24_scramble_validation", f"WITH x AS ({scramble_sql('0.3')}) SELECT x.item_id, length(text) = length(scrambled) AS same_length, CAST(len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) <> substr(scrambled, i, 1))) AS BIGINT) changed FROM x JOIN benchmark USING (item_id)")
def scramble_validation(v):
    b = v.raw("benchmark").withColumn("scrambled", X.scramble(F.col("text"), 0.3, "s", F.col("item_id").cast("string")))
    return b.select("item_id", (F.length("text") == F.length("scrambled")).alias("same_length"), T.differences(F.col("text"), F.col("scrambled")).alias("changed"))


@query("t4_substitution", f"SELECT doc_id, translate(text, '{ALPHABET}', '{X.rotated(13) + X.rotated(13).upper()}') result FROM documents")
def substitution(v):
    return v.raw("documents").select("doc_id", X.caesar(F.col("text"), 13).alias("result"))


def _chain(rules, text="text"):
    for a, b in rules:
        text = f"replace({text}, '{a}', '{b}')"
    return text


@query("t4_substitution_in_sequence", f"SELECT item_id, {_chain(list(zip(X.LOWER, X.rotated(13))))} result FROM benchmark")
def substitution_in_sequence(v):
    return v.raw("benchmark").select("item_id", X.caesar_in_sequence(F.col("text"), 13).alias("result"))


@query("t5_phonetic", f"SELECT doc_id, {_chain(PHONETIC)} result FROM documents")
def phonetic(v):
    return v.raw("documents").select("doc_id", X.phonetic(F.col("text"), PHONETIC).alias("result"))


@query("t6_caesar", f"SELECT doc_id, translate(lower(text), '{X.LOWER}', '{X.rotated(3)}') result FROM documents")
def caesar(v):
    return v.raw("documents").select("doc_id", F.translate(F.lower("text"), X.LOWER, X.rotated(3)).alias("result"))


MAP_SQL = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in SYNONYMS.items()) + "}"


@query("t11_translate_text", f"""SELECT item_id, list_aggregate(list_transform(p, lambda t, i: CASE WHEN regexp_full_match(t, '[0-9]+') OR (i > 1 AND regexp_full_match(t, '\\p{{Lu}}\\p{{Ll}}+')) THEN t
 ELSE coalesce({MAP_SQL}[lower(t)], translate(t, '{ALPHABET}', '{X.rotated(5) + X.rotated(5).upper()}')) END), 'string_agg', '') result FROM (SELECT item_id, regexp_extract_all(text, {PIECES}) p FROM benchmark)""")
def translate_text(v):
    return v.raw("benchmark").select("item_id", X.translated(F.col("text"), SYNONYMS, 5).alias("result"))


@query("t14_synonyms", f"""SELECT item_id, list_aggregate(list_transform(p, lambda t, i: CASE WHEN {MAP_SQL}[lower(t)] IS NOT NULL AND CAST('0x' || substr(md5('q' || t || (i - 1)), 1, 4) AS INTEGER) / 65536 < 0.5
 THEN CASE WHEN regexp_matches(t, '^\\p{{Lu}}') THEN upper(substr({MAP_SQL}[lower(t)], 1, 1)) || substr({MAP_SQL}[lower(t)], 2) ELSE {MAP_SQL}[lower(t)] END ELSE t END), 'string_agg', '') result FROM (SELECT item_id, regexp_extract_all(text, {PIECES}) p FROM benchmark)""")
def synonyms(v):
    return v.raw("benchmark").select("item_id", X.synonyms(F.col("text"), SYNONYMS, 0.5, "q").alias("result"))


@query("f37_back_translation", f"SELECT item_id, list_aggregate(list_transform(regexp_extract_all(text, {PIECES}), lambda t: coalesce({MAP_SQL}[lower(t)], t)), 'string_agg', '') result FROM benchmark")
def back_translation(v):
    return v.raw("benchmark").select("item_id", T.mapped_tokens(F.col("text"), SYNONYMS).alias("result"))


@query("t15_structure")
def structure(v):
    parts = F.transform(T.sections(F.col("text"), "\n"), lambda s: F.struct(T.section_type(s["content"]).alias("kind"), s["content"].alias("content")))
    return v.raw("documents").select("doc_id", F.array_join(F.transform(X.reordered(parts), lambda s: s["content"]), "\n\n").alias("result"))


@query("t16_reconstruct", "SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10))) result FROM documents")
def reconstruct(v):
    sections = v.raw("documents").select("doc_id", F.inline(T.sections(F.col("text"), "\n")))
    ordered = F.array_sort(F.collect_list(F.struct("position", "content")))
    return sections.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(ordered, lambda s: s["content"]), "\n\n")).alias("result"))


@query("t18_fan_out", f"SELECT item_id, t AS transform, CASE t WHEN 'original' THEN text WHEN 'caesar' THEN translate(text, '{ALPHABET}', '{X.rotated(3) + X.rotated(3).upper()}') END result, t <> 'paraphrase' AS success FROM benchmark, (VALUES ('original'), ('caesar'), ('paraphrase')) x(t)")
def fan_out(v):
    kinds = F.array(
        F.struct(F.lit("original").alias("transform"), F.col("text").alias("result"), F.lit(True).alias("success")),
        F.struct(F.lit("caesar").alias("transform"), X.caesar(F.col("text"), 3).alias("result"), F.lit(True).alias("success")),
        F.struct(F.lit("paraphrase").alias("transform"), F.lit(None).cast("string").alias("result"), F.lit(False).alias("success")),
    )
    return v.raw("benchmark").select("item_id", F.inline(kinds))


@query("a67_section_stats", "WITH s AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) content FROM documents) SELECT doc_id, count(*) sections, CAST(sum(length(content)) AS BIGINT) chars FROM s WHERE content <> '' GROUP BY doc_id")
def section_stats(v):
    s = v.raw("documents").select("doc_id", F.inline(T.sections(F.col("text"), "\n")))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.length("content")).alias("chars"))


@query("v10_length_ratio", f"SELECT item_id, round(length(x) / length(text), 6) ratio, length(x) / length(text) BETWEEN 0.5 AND 2 AS within FROM (SELECT item_id, text, {_chain(PHONETIC)} x FROM benchmark)")
def length_ratio(v):
    ratio = F.length(X.phonetic(F.col("text"), PHONETIC)) / F.length("text")
    return v.raw("benchmark").select("item_id", ratio.alias("r")).select("item_id", F.round("r", 6).alias("ratio"), F.col("r").between(0.5, 2.0).alias("within"))
