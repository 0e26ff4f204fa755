"""Sections between blank lines (inventory F27 to F29, T15, T16, A67): a question and its answer make one text of sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import transform as X
from larkspur.plans.rewriting import PHONETIC_LANGUAGE
from larkspur.registry import query

SECTIONS = r"""WITH parts AS (SELECT conv_id, turn, regexp_split_to_array(question || chr(10) || chr(10) || predicted, '\n\s*\n') AS p FROM qa_pairs),
s AS (SELECT conv_id, turn, CAST(nth - 1 AS INTEGER) AS position, trim(p[nth]) AS content FROM (SELECT *, unnest(range(1, len(p) + 1)) AS nth FROM parts)) """
KIND = r"""CASE WHEN starts_with(content, '#') OR (regexp_matches(content, '\p{L}') AND upper(content) = content AND length(content) < 100) THEN 'heading' WHEN regexp_matches(content, '(^|\n)\s*[-*•] ') THEN 'list' WHEN regexp_matches(content, '(^|\n)\s*[0-9]+\. ') THEN 'numbered_list' WHEN starts_with(content, '>') OR starts_with(content, '"') THEN 'quote' ELSE 'paragraph' END"""


def threads(v):
    return v.qa_pairs.select("conv_id", "turn", F.concat("question", F.lit("\n\n"), "predicted").alias("text"))


def sections(v):
    return threads(v).select("conv_id", "turn", F.inline(T.sections(F.col("text"))))


@query("f27_blank_line_sections", SECTIONS + "SELECT conv_id, turn, position, md5(content) content FROM s WHERE content <> ''")
def blank_line_sections(v):
    return sections(v).select("conv_id", "turn", "position", F.md5("content").alias("content"))


@query("f28_blank_line_types", SECTIONS + f"SELECT conv_id, turn, position, {KIND} kind FROM s WHERE content <> ''")
def blank_line_types(v):
    return sections(v).select("conv_id", "turn", "position", T.section_type(F.col("content")).alias("kind"))


@query("f29_blank_line_importance")
def blank_line_importance(v):
    return sections(v).select("conv_id", "turn", "position", T.importance(T.section_type(F.col("content")), F.col("content")).alias("importance"))


@query("t16_blank_line_reconstruct", SECTIONS + "SELECT conv_id, turn, md5(string_agg(content, chr(10) || chr(10) ORDER BY position)) result FROM s WHERE content <> '' GROUP BY ALL")
def reconstruct(v):
    contents = F.transform(T.sections(F.col("text")), lambda s: s["content"])
    return threads(v).select("conv_id", "turn", F.md5(F.array_join(contents, "\n\n")).alias("result"))


@query("a67_blank_line_stats", SECTIONS + ", t AS (SELECT conv_id, turn, count(*) n, CAST(sum(length(content)) AS BIGINT) chars, max(length(content)) longest FROM s WHERE content <> '' GROUP BY ALL) SELECT n AS sections, count(*) texts, round(avg(chars), 4) chars, max(longest) longest FROM t GROUP BY n")
def stats(v):
    """Texts by number of sections, with mean length and the longest section."""
    lengths = F.transform(T.sections(F.col("text")), lambda s: F.length(s["content"]).cast("bigint"))
    each = threads(v).select(F.size(lengths).cast("bigint").alias("sections"), F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("chars"), F.array_max(lengths).alias("longest"))
    return each.filter("sections > 0").groupBy("sections").agg(F.count(F.lit(1)).alias("texts"), F.round(F.avg("chars"), 4).alias("chars"), F.max("longest").alias("longest"))


def translated(c):
    """A text in the phonetic language; what stands between its sections is kept."""
    return X.phonetic(c, PHONETIC_LANGUAGE)


@query("t15_document_forms")
def document_forms(v):
    """Every text restructured, translated and both in turn (hybrid), with how many sections moved and the ratio of lengths."""
    parts = F.transform(T.sections(F.col("text")), lambda s: F.struct(T.section_type(s["content"]).alias("kind"), s["content"].alias("content")))
    joined = lambda sections: F.array_join(F.transform(sections, lambda s: s["content"]), "\n\n")
    d = threads(v).withColumn("parts", parts).withColumn("structural", joined(X.reordered(F.col("parts"))))
    d = d.withColumns({"translation": translated(F.col("text")), "hybrid": translated(F.col("structural"))})
    moved = F.size(F.filter(F.zip_with("parts", X.reordered(F.col("parts")), lambda a, b: a["content"] != b["content"]), lambda x: x))
    return d.select("conv_id", "turn", *[F.md5(c).alias(c) for c in ("structural", "translation", "hybrid")], moved.alias("moved"), (F.length("hybrid") / F.length("text")).alias("ratio"))
