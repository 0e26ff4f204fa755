"""Scalar functions over questions, answers and documents (inventory F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import score as S
from larkspur.functions import text as T
from larkspur.plans.candidates import candidates, one_byte
from larkspur.registry import query

R = lambda c: F.round(c, 6)
PAIRS = """WITH pairs AS (SELECT a.item_id, a.text x, b.text y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
"""


def pairs(v):
    b = v.raw("benchmark")
    return b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id"), F.col("a.text").alias("x"), F.col("b.text").alias("y"))


@query("f1_exact_match", r"SELECT conv_id, turn, lower(regexp_replace(predicted, '^\s+|\s+$', '', 'g')) = lower(regexp_replace(question, '^\s+|\s+$', '', 'g')) AS correct FROM qa_pairs")
def exact_match(v):
    return v.qa_pairs.select("conv_id", "turn", S.exact_match(F.col("predicted"), F.col("question")).alias("correct"))


@query("f2_substring_match", r"SELECT conv_id, turn, contains(lower(regexp_replace(predicted, '^\s+|\s+$', '', 'g')), lower(regexp_replace(question, '^\s+|\s+$', '', 'g'))) AS correct FROM qa_pairs")
def substring_match(v):
    return v.qa_pairs.select("conv_id", "turn", S.substring_match(F.col("predicted"), F.col("question")).alias("correct"))


@query("f3_fuzzy_match")
def fuzzy_match(v):
    from larkspur.functions.python import sequence_ratio

    return v.qa_pairs.select("conv_id", "turn", F.round(sequence_ratio("predicted", "question"), 6).alias("ratio")).withColumn("correct", F.col("ratio") >= 0.8)


@query("f6_stated_answer", r"SELECT item_id, coalesce(nullif(trim(regexp_extract(a, '(?i)(?:answer|solution):[ \t]*([^\n]+)', 1)), ''), trim(a)) answer FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'So. Answer: ' || split_part(text, ' ', 2) || chr(10) || 'end' ELSE text END a FROM benchmark)")
def stated_answer(v):
    a = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("So. Answer: "), F.split_part("text", F.lit(" "), F.lit(2)), F.lit("\nend"))).otherwise(F.col("text"))
    return v.raw("benchmark").select("item_id", T.stated_answer(a).alias("answer"))


@query("f7_normalized", r"SELECT doc_id, md5(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^\p{L}\p{N}_\s]', '', 'g')) normalized FROM documents")
def normalized(v):
    return v.raw("documents").select("doc_id", F.md5(T.normalized(F.col("text"))).alias("normalized"))


@query("f8_first_line", r"SELECT doc_id, regexp_extract(text, '^\s*([^\n]*[^\s])', 1) line FROM documents")
def first_line(v):
    return v.raw("documents").select("doc_id", T.first_line(F.col("text")).alias("line"))


def choice_sql(c):
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '{form}', 1), '')" for form in S.CHOICES) + ")"


def verdict_sql(p, e):
    return f"CASE WHEN {p} = {e} THEN 'equal' WHEN contains({p}, {e}) THEN 'contains' WHEN {choice_sql(p)} = {choice_sql(e)} THEN 'choice' ELSE 'none' END"


#: Questions and answers, lowered and without blanks around them.
SAID = r"""WITH said AS (SELECT conv_id, turn, lower(regexp_replace(predicted, '^\s+|\s+$', '', 'g')) p, lower(regexp_replace(question, '^\s+|\s+$', '', 'g')) e, predicted, question FROM qa_pairs) """


@query("f9_accuracy_cascade", SAID + f"SELECT conv_id, turn, {verdict_sql('p', 'e')} verdict FROM said")
def accuracy_cascade(v):
    return v.qa_pairs.select("conv_id", "turn", S.verdict(F.col("predicted"), F.col("question")).alias("verdict"))


@query("f10_choice", f"SELECT conv_id, turn, {choice_sql('text')} choice FROM conversations")
def choice(v):
    return v.raw("conversations").select("conv_id", "turn", S.choice(F.col("text")).alias("choice"))


@query("f11_edit_ratio", PAIRS + f"SELECT item_id, round(levenshtein({one_byte('x')}, {one_byte('y')}) / greatest(length(x), length(y)), 6) ratio FROM pairs")
def edit_ratio(v):
    return pairs(v).select("item_id", R(S.edit_ratio(F.col("x"), F.col("y"))).alias("ratio"))


@query("f12_jaccard", PAIRS + r"SELECT item_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) jaccard FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(x), '\s+'), lambda w: w <> '') a, list_filter(regexp_split_to_array(lower(y), '\s+'), lambda w: w <> '') b FROM pairs)")
def jaccard(v):
    return pairs(v).select("item_id", R(S.jaccard(F.col("x"), F.col("y"))).alias("jaccard"))


@query("f13_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(v):
    e = v.raw("embeddings").select("vec_id", "embedding")
    return e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id"), R(S.cosine(F.col("a.embedding"), F.col("b.embedding"))).alias("cosine"))


@query("f14_bleu")
def bleu(v):
    return pairs(v).select("item_id", R(S.bleu(F.col("x"), F.col("y"))).alias("bleu"), R(S.bleu(F.col("x"), F.col("x"))).alias("own"))


@query("f15_acceptance")
def acceptance(v):
    """The rule over real pairs of texts: likeness, edit ratio and BLEU decide. No SQL states BLEU."""
    return candidates(v).select("item_id", "candidate_id", "cos_sim", "edit_ratio", R(F.col("bleu")).alias("bleu"), "accepted", S.rejection(F.col("cos_sim"), F.col("edit_ratio"), F.col("bleu")).alias("rejection"))


@query("f17_field_priority", "SELECT page_id, coalesce(nullif(url, ''), html, 'unknown') found FROM pages")
def field_priority(v):
    return v.raw("pages").select("page_id", F.coalesce(F.nullif(F.col("url"), F.lit("")), "html", F.lit("unknown")).alias("found"))


@query("f20_qa_zip", "SELECT conv_id, n, q, a FROM (SELECT conv_id, unnest(range(1, 1 + least(coalesce(len(q), 0), coalesce(len(a), 0)))) n, q, a FROM (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') q, list(text ORDER BY turn) FILTER (role = 'assistant') a FROM conversations GROUP BY conv_id)) x, LATERAL (SELECT x.q[x.n] AS q2, x.a[x.n] AS a2) y".replace("SELECT conv_id, n, q, a FROM", "SELECT conv_id, n, y.q2 AS question, y.a2 AS answer FROM"))
def qa_zip(v):
    texts = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda s: s["text"])
    g = v.raw("conversations").groupBy("conv_id").agg(texts("user").alias("q"), texts("assistant").alias("a"))
    n = F.least(F.size("q"), F.size("a"))
    return g.filter(n > 0).select("conv_id", F.posexplode(F.arrays_zip(F.slice("q", F.lit(1), n).alias("q"), F.slice("a", F.lit(1), n).alias("a"))).alias("i", "s")).select("conv_id", (F.col("i") + 1).cast("bigint").alias("n"), F.col("s.q").alias("question"), F.col("s.a").alias("answer"))


@query("f21_answer_type", r"""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'instruction' WHEN t IN ('yes', 'no', 'true', 'false') THEN 'yes_no' WHEN regexp_full_match(t, '-?[0-9]+([.,][0-9]+)?%?') THEN 'numeric' WHEN regexp_full_match(t, '\(?[a-d]\)?[.)]?') THEN 'multiple_choice'
WHEN contains(t, ',') OR contains(t, ';') THEN 'list' WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 10 THEN 'extractive' ELSE 'abstractive' END kind FROM (SELECT *, lower(trim(text)) t FROM conversations)""")
def answer_type(v):
    """What the record says comes first: a system's message is an instruction."""
    stated = F.when(F.col("role") == "system", "instruction")
    return v.raw("conversations").select("conv_id", "turn", T.answer_type(F.col("text"), stated).alias("kind"))


@query("f22_prompt", "SELECT item_id, md5('Question: ' || question || chr(10) || concat_ws(chr(10), 'A. ' || dataset, 'B. ' || domain)) AS prompt, length(question) AS n_question FROM items")
def prompt(v):
    """Whole questions with their options, by digest."""
    options = F.transform(F.array("dataset", "domain"), lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x))
    whole = F.concat(F.lit("Question: "), "question", F.lit("\n"), F.array_join(options, "\n"))
    return v.items.select("item_id", F.md5(whole).alias("prompt"), F.length("question").cast("bigint").alias("n_question"))


@query("f23_differences", PAIRS + "SELECT item_id, greatest(length(x), length(y)) - len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: substr(x, i, 1) = substr(y, i, 1))) AS differences FROM pairs")
def differences(v):
    return pairs(v).select("item_id", T.differences(F.col("x"), F.col("y")).alias("differences"))


@query("f25_identifiers", "SELECT doc_id, substr(sha256(text), 1, 16) id, CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 2147483648 AS seed FROM documents")
def identifiers(v):
    h = F.sha2("text", 256)
    return v.raw("documents").select("doc_id", F.substring(h, 1, 16).alias("id"), (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % 2147483648).alias("seed"))


@query("f26_token_estimate", "SELECT doc_id, greatest(1, length(text) // 4) tokens FROM documents")
def token_estimate(v):
    return v.raw("documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


LINES = "WITH s AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS position, trim(unnest(p)) AS content FROM (SELECT doc_id, string_split(text, chr(10)) p FROM documents)) "


def lines(v):
    return v.raw("documents").select("doc_id", F.inline(T.sections(F.col("text"), "\n")))


@query("f27_sections", LINES + "SELECT doc_id, CAST(position AS INTEGER) AS position, md5(content) content FROM s WHERE content <> ''")
def sections(v):
    return lines(v).select("doc_id", "position", F.md5("content").alias("content"))


@query("f28_section_types", LINES + r"""SELECT doc_id, CAST(position AS INTEGER) AS position, CASE WHEN starts_with(content, '#') OR (regexp_matches(content, '\p{L}') AND upper(content) = content AND length(content) < 100) THEN 'heading' WHEN regexp_matches(content, '(^|\n)\s*[-*•] ') THEN 'list'
 WHEN regexp_matches(content, '(^|\n)\s*[0-9]+\. ') THEN 'numbered_list' WHEN starts_with(content, '>') OR starts_with(content, '"') THEN 'quote' ELSE 'paragraph' END kind FROM s WHERE content <> ''""")
def section_types(v):
    return lines(v).select("doc_id", "position", T.section_type(F.col("content")).alias("kind"))


@query("f30_word_count", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) words FROM documents")
def word_count(v):
    return v.raw("documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("f31_list_items", r"""SELECT conv_id, turn, list_filter(list_transform(CASE WHEN contains(text, ',') THEN string_split(text, ',') WHEN contains(text, ';') THEN string_split(text, ';') WHEN contains(text, ' and ') THEN string_split(text, ' and ')
WHEN regexp_matches(text, '[0-9]+\.\s*') THEN regexp_split_to_array(text, '[0-9]+\.\s*') WHEN regexp_matches(text, '(?m)^\s*[-*•]\s*') THEN regexp_split_to_array(text, '(?m)^\s*[-*•]\s*') ELSE [text] END, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') items FROM conversations""")
def list_items(v):
    return v.raw("conversations").select("conv_id", "turn", T.list_items(F.col("text")).alias("items"))


@query("f34_vocabulary", r"WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) w FROM documents) SELECT w, count(*) n FROM t WHERE length(w) >= 3 AND NOT regexp_matches(w, '[0-9_]') GROUP BY w HAVING count(*) >= 5")
def vocabulary(v):
    # words are chosen within the array, so that only those that count become rows
    long = lambda w: (F.length(w) >= 3) & ~F.rlike(w, F.lit("[0-9_]"))
    w = v.raw("documents").select(F.explode(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(f"({T.WORD})"), 1), long)).alias("w"))
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query("a63_top_words", r"WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) w, lang FROM documents) SELECT lang, w, n FROM (SELECT lang, w, count(*) n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) k FROM t GROUP BY lang, w) WHERE k <= 10")
def top_words(v):
    from pyspark.sql import Window

    w = v.raw("documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({T.WORD})"), 1)).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).filter("k <= 10").drop("k")


@query("f36_consistency", "SELECT lower(role) AS original, count(DISTINCT lower(text)) > 1 AS inconsistent FROM conversations GROUP BY lower(role)")
def consistency(v):
    # two hashes of each text in place of a shuffle of distinct texts; they differ somewhere just where texts do
    text = F.lower("text")
    differ = [F.min(h) != F.max(h) for h in (F.when(text.isNotNull(), F.xxhash64(text)), F.when(text.isNotNull(), F.xxhash64(F.lit("again"), text)))]
    return v.raw("conversations").groupBy(F.lower("role").alias("original")).agg(F.coalesce(differ[0] | differ[1], F.lit(False)).alias("inconsistent"))


@query("f38_cache_key", "SELECT item_id, md5(concat_ws('|', item_id, dataset, domain)) key FROM items")
def cache_key(v):
    return v.items.select("item_id", F.md5(F.concat_ws("|", "item_id", "dataset", "domain")).alias("key"))


@query("f41_stars", "SELECT event_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END stars FROM (SELECT event_id, (event_id % 100) / 1000.0 p FROM events)")
def stars(v):
    p = (F.col("event_id") % 100) / 1000.0
    return v.raw("events").select("event_id", F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("").alias("stars"))


@query("f43_backoff", "SELECT event_id % 5 attempts, CAST(pow(2, event_id % 5) AS BIGINT) AS minutes, event_id % 5 < 3 AS can_retry FROM events GROUP BY ALL")
def backoff(v):
    a = (F.col("event_id") % 5).alias("attempts")
    return v.raw("events").select(a).distinct().select("attempts", F.pow(F.lit(2.0), "attempts").cast("bigint").alias("minutes"), (F.col("attempts") < 3).alias("can_retry"))


@query("f45_masked_url", "SELECT page_id, regexp_replace('http://u:secret@' || page_id || '.x/y', '(://[^:/@]+):[^@/]+@', '\\1:***@') url FROM pages")
def masked_url(v):
    return v.raw("pages").select("page_id", T.masked_url(F.concat(F.lit("http://u:secret@"), "page_id", F.lit(".x/y"))).alias("url"))


@query("f46_stage_weights", "SELECT event_type, CASE event_type WHEN 'signup' THEN 0.1 WHEN 'view' THEN 0.4 WHEN 'click' THEN 0.7 WHEN 'purchase' THEN 1.0 ELSE 0.0 END::DOUBLE weight FROM events GROUP BY event_type")
def stage_weights(v):
    table = F.create_map(*[F.lit(x) for pair in (("signup", 0.1), ("view", 0.4), ("click", 0.7), ("purchase", 1.0)) for x in pair])
    return v.raw("events").select("event_type").distinct().select("event_type", F.coalesce(F.element_at(table, F.col("event_type")), F.lit(0.0)).alias("weight"))


@query("f47_effect_label", "SELECT k, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END label FROM (SELECT DISTINCT k, (k - 50) / 40.0 d FROM evals)")
def effect_label(v):
    d = F.abs((F.col("k") - 50) / 40.0)
    return v.evals.select("k").distinct().select("k", F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").otherwise("large").alias("label"))
