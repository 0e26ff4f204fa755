"""Rewriting of words, records and documents by fixed rules and md5 draws (inventory T). The SQL states each rule by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import transform as X
from larkspur.plans.records import per_field
from larkspur.plans.transforms import PHONETIC
from larkspur.operators import vocabulary
from larkspur.registry import query

ALPHABET = X.LOWER + X.LOWER.upper()
# Vowel shifts; letters of made-up words; endings of words in the synthetic grammar; shifts of affixes; words of the paraphrase; synonyms.
VOWEL_SHIFTS = [("a", "æ"), ("e", "ə"), ("i", "ɪ"), ("o", "ɔ"), ("u", "ʊ")]
CONSONANTS, VOWELS = "bcdfghjklmnpqrstvwxyz", "aeiou"
SYNTHETIC_CONSONANTS = "ptkmnslrwj"
ENDINGS = [("ing", "an"), ("ed", "et"), ("s", "os"), ("ly", "al")]
SHIFTS = [("sh", "zh"), ("ch", "j"), ("th", "f"), ("ng", "nk"), ("ck", "k"), ("ph", "f"), ("gh", ""), ("tion", "shun"), ("sion", "zhun"), ("ough", "uf")]
PARAPHRASE = [
    ("said", "stated"), ("showed", "demonstrated"), ("because", "due to the fact that"), ("also", "additionally"), ("however", "nevertheless"),
    ("therefore", "consequently"), ("important", "significant"), ("large", "substantial"), ("small", "minimal"),
]
SYNONYMS = {
    "big": ["large", "huge", "enormous", "massive", "giant"],
    "small": ["tiny", "little", "mini", "petite", "minuscule"],
    "good": ["excellent", "great", "wonderful", "fantastic", "superb"],
    "bad": ["terrible", "awful", "horrible", "dreadful", "poor"],
    "fast": ["quick", "rapid", "swift", "speedy", "hasty"],
    "slow": ["sluggish", "gradual", "leisurely", "unhurried"],
    "happy": ["joyful", "cheerful", "delighted", "pleased", "glad"],
    "sad": ["unhappy", "sorrowful", "melancholy", "dejected"],
    "walk": ["stroll", "wander", "march", "hike", "pace"],
    "run": ["jog", "sprint", "dash", "race", "hurry"],
    "look": ["see", "view", "observe", "watch", "gaze"],
    "say": ["speak", "tell", "state", "declare", "mention"],
    "think": ["believe", "consider", "ponder", "contemplate"],
    "make": ["create", "build", "construct", "produce", "craft"],
    "take": ["grab", "seize", "acquire", "obtain", "get"],
    "give": ["provide", "offer", "present", "donate", "grant"],
    "find": ["discover", "locate", "uncover", "detect", "spot"],
    "know": ["understand", "realize", "recognize", "comprehend"],
    "want": ["desire", "wish", "crave", "need", "require"],
    "help": ["assist", "aid", "support", "serve", "back"],
}
PHONETIC_LANGUAGE = [*PHONETIC[::-1], *VOWEL_SHIFTS]
WORDS_SQL = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) word FROM documents)"


def words(v):
    return v.raw("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).distinct()


def _replaced(rules, text: str = "word") -> str:
    for a, b in rules:
        text = f"replace({text}, '{a}', '{b}')"
    return text


@query("t5_vowel_shifts", f"SELECT doc_id, md5({_replaced([*PHONETIC[::-1], *VOWEL_SHIFTS], 'text')}) result FROM documents")
def vowel_shifts(v):
    """The phonetic language above complexity 3: letter groups from the last rule to the first, then vowels."""
    return v.raw("documents").select("doc_id", F.md5(X.phonetic(F.col("text"), [*PHONETIC[::-1], *VOWEL_SHIFTS])).alias("result"))


@query("t6_letter_scramble", f"""WITH m AS (SELECT array_to_string(list_transform(list_sort(list_transform(string_split('{CONSONANTS}', ''), lambda c: md5('s:' || c) || c)), lambda x: x[33]), '') c, array_to_string(list_transform(list_sort(list_transform(string_split('{VOWELS}', ''), lambda c: md5('s:' || c) || c)), lambda x: x[33]), '') o)
SELECT doc_id, md5(translate(lower(text), '{CONSONANTS + VOWELS}', c || o)) result FROM documents, m""")
def letter_scramble(v):
    """The scrambled language above complexity 3: consonants and vowels each permuted among themselves, here in order of md5."""
    import hashlib

    order = lambda letters: "".join(sorted(letters, key=lambda c: hashlib.md5(f"s:{c}".encode()).hexdigest() + c))
    return v.raw("documents").select("doc_id", F.md5(F.translate(F.lower("text"), CONSONANTS + VOWELS, order(CONSONANTS) + order(VOWELS))).alias("result"))


def pseudo_sql(consonants: str) -> str:
    pick = lambda letters: f"substr('{letters}', CAST(CAST('0x' || substr(md5('s:' || word || ':' || i), 1, 4) AS INTEGER) % {len(letters)} AS INTEGER) + 1, 1)"
    return f"array_to_string(list_transform(range(1, length(word) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {pick(consonants)} ELSE {pick(VOWELS)} END), '')"


KNOWN = ("the", "and", "of", "to", "in")


@query("t10_unseen_words", f"WITH {WORDS_SQL} SELECT word, {pseudo_sql(CONSONANTS)} form FROM w WHERE word NOT IN {KNOWN}")
def unseen_words(v):
    """Forms for all words that a vocabulary lacks; each form depends on its word alone, so batches agree."""
    known = v.spark.createDataFrame([(w,) for w in KNOWN], "word string")
    return words(v).join(F.broadcast(known), "word", "left_anti").select("word", X.pseudo_word(F.col("word"), "s", CONSONANTS, VOWELS).alias("form"))


def forms(v):
    """A form for every word of the documents, and no form for two; short ones that are taken get longer."""
    return vocabulary.unique_forms(words(v), lambda word, nth: X.pseudo_word(F.concat(word, F.lit("+" * nth)), "s", CONSONANTS, VOWELS))


@query("t10_unique_forms")
def unique_forms(v):
    return forms(v)


@query("f37_round_trip")
def round_trip(v):
    """Every text in the made-up language, by digest, and whether the way back gives the lower-cased text again."""
    out = vocabulary.exchanged(v.raw("documents"), "doc_id", "text", forms(v), restore=True)
    return out.select(F.col("id").alias("doc_id"), F.md5("text").alias("other"), "restored")


@query("t7_synthetic_words", f"WITH {WORDS_SQL} SELECT word, {pseudo_sql(SYNTHETIC_CONSONANTS)} form, {'regexp_replace(' * 4}word, 'ing$', 'an'), 'ed$', 'et'), 's$', 'os'), 'ly$', 'al') AS grammar FROM w")
def synthetic_words(v):
    """Words of the synthetic language, and what its grammar makes of the endings of given ones."""
    grammar = F.col("word")
    for a, b in ENDINGS:
        grammar = F.regexp_replace(grammar, f"{a}$", b)
    return words(v).select("word", X.pseudo_word(F.col("word"), "s", SYNTHETIC_CONSONANTS, VOWELS).alias("form"), grammar.alias("grammar"))


@query("t8_affix_shifts", f"WITH {WORDS_SQL} SELECT word, CASE " + " ".join(f"WHEN contains(word, '{a}') THEN replace(word, '{a}', '{b}')" for a, b in SHIFTS) + " ELSE word END AS form FROM w")
def affix_shifts(v):
    return words(v).select("word", X.first_shift(F.col("word"), SHIFTS).alias("form"))


ROT5 = f"'{ALPHABET}', '{X.rotated(5) + X.rotated(5).upper()}'"


@query("t12_nested_problem", f"SELECT doc_id, md5(translate(text, {ROT5})) question, translate(source, {ROT5}) first_option, translate(lang, {ROT5}) last_option, CAST(coalesce(len(list_filter(string_split(text, ' '), lambda x: x <> '')), 0) + (source IS NOT NULL)::INTEGER + (lang IS NOT NULL)::INTEGER AS BIGINT) units FROM documents")
def nested_problem(v):
    """A nested problem translated leaf by leaf, with the number of words in all."""
    problem = F.struct(F.col("text").alias("question"), F.array("source", "lang").alias("options"))
    moved = lambda c: X.caesar(c, 5)
    d = v.raw("documents").select("doc_id", problem.alias("p"))
    d = d.withColumn("t", F.struct(moved(F.col("p.question")).alias("question"), F.transform("p.options", moved).alias("options")))
    units = F.coalesce(F.size(F.filter(F.split("p.question", " "), lambda w: w != "")), F.lit(0)) + F.size(F.filter("p.options", lambda x: x.isNotNull()))
    return d.select("doc_id", F.md5("t.question").alias("question"), F.get("t.options", 0).alias("first_option"), F.get("t.options", 1).alias("last_option"), units.cast("bigint").alias("units"))


@query("t14_synonym_choice", f"""WITH {WORDS_SQL}, s AS (SELECT * FROM (VALUES {', '.join(f"('{w}', {c})" for w, c in SYNONYMS.items())}) t(word, choices))
SELECT word, list_extract(choices, CAST(CAST('0x' || substr(md5('s:' || word), 1, 4) AS INTEGER) % len(choices) AS INTEGER) + 1) AS synonym FROM w JOIN s USING (word)""")
def synonym_choice(v):
    """The one synonym that stands for each word of the table throughout."""
    table = v.spark.createDataFrame(list(SYNONYMS.items()), "word string, choices array<string>")
    place = F.conv(F.substring(F.md5(F.concat(F.lit("s:"), "word")), 1, 4), 16, 10).cast("int") % F.size("choices")
    return words(v).join(F.broadcast(table), "word").select("word", F.get("choices", place).alias("synonym"))


def _paraphrase_sql(text: str) -> str:
    for a, b in PARAPHRASE:
        text = f"regexp_replace({text}, '\\b{a}\\b', '{b}', 'g')"
    return text


@query("t15_paraphrase", f"SELECT item_id, {_paraphrase_sql('text')} result FROM benchmark")
def paraphrase(v):
    text = F.col("text")
    for a, b in PARAPHRASE:
        text = F.regexp_replace(text, rf"\b{a}\b", b)
    return v.raw("benchmark").select("item_id", text.alias("result"))


@query("t19_best_paraphrase", f"""WITH c AS (SELECT item_id, text, k, CASE k WHEN 'paraphrase' THEN {_paraphrase_sql('text')} WHEN 'phonetic' THEN {_replaced(PHONETIC, 'text')} ELSE text END candidate FROM benchmark, (VALUES ('same'), ('paraphrase'), ('phonetic')) t(k)),
t AS (SELECT *, list_distinct(string_split(lower(text), ' ')) a, list_distinct(string_split(lower(candidate), ' ')) b FROM c), s AS (SELECT item_id, k, candidate, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) alike FROM t WHERE candidate <> text)
SELECT item_id, k AS kind, round(alike, 6) alike FROM s WHERE alike >= 0.5 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY alike DESC, k) = 1""")
def best_paraphrase(v):
    """Of the candidates of each item that differ and share half their words or more, the most alike."""
    from pyspark.sql import Window

    text = changed = F.col("text")
    for a, b in PARAPHRASE:
        changed = F.regexp_replace(changed, rf"\b{a}\b", b)
    made = [("same", text), ("paraphrase", changed), ("phonetic", X.phonetic(text, PHONETIC))]
    c = v.raw("benchmark").select("item_id", "text", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("candidate")) for k, x in made]))).filter("candidate <> text")
    split = lambda x: F.array_distinct(F.split(F.lower(x), " "))
    alike = F.size(F.array_intersect(split("text"), split("candidate"))) / F.size(F.array_union(split("text"), split("candidate")))
    order = Window.partitionBy("item_id").orderBy(F.desc("alike"), "kind")
    best = c.withColumn("alike", alike).filter("alike >= 0.5").withColumn("n", F.row_number().over(order)).filter("n = 1")
    return best.select("item_id", "kind", F.round("alike", 6).alias("alike"))


@query("t22_word_scramble", """WITH s AS (SELECT item_id, string_split(text, ' ') w FROM benchmark), c AS (SELECT item_id, w, list_transform(list_slice(list_sort(list_transform(range(1, len(w) + 1), lambda i: {'h': md5('s:' || item_id || ':' || (i - 1)), 'i': i})), 1, CAST(floor(len(w) * 0.5) AS BIGINT)), lambda x: x.i) chosen FROM s)
SELECT item_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN list_contains(chosen, i) AND length(x) > 3 THEN substr(x, 1, 1) || array_to_string(list_transform(list_sort(list_transform(range(2, length(x)), lambda j: {'h': md5('s:' || x || ':' || j), 'c': substr(x, j, 1)})), lambda y: y.c), '') || substr(x, length(x), 1) ELSE x END), ' ') result FROM c""")
def word_scramble(v):
    return v.raw("benchmark").select("item_id", X.inner_scrambled(F.col("text"), 0.5, "s", F.col("item_id").cast("string")).alias("result"))


@query("t23_per_field", f"SELECT c_custkey, translate(c_name, {ROT5}) c_name, translate(c_mktsegment, {ROT5}) c_mktsegment FROM customer")
def field_by_field(v):
    return per_field(v.raw("customer").select("c_custkey", "c_name", "c_mktsegment"), lambda c: X.caesar(c, 5))
