import random
import re
from collections import Counter

from larkspur.llm import rules

SPACE = re.compile("[\x20\x09-\x0d]+")


def measured(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["a", "bé", "c#", "𝒳y", "$", "na me", "e", "ff"]
    texts = [rng.choice([" ", "\n", "\t ", "\x0b", "\r\n"]).join(rng.choice(words[: rng.randint(1, 8)]) for _ in range(rng.choice([1, 2, 3, 4, 5, 30, 200]))) for _ in range(150)]
    texts += ["same line\n same line\nsame line\r\nsame line\n\n \n", "x y z x y z", "x x x", "x x x x", "w " * 40_000, "q" * 100_000, " \n ", "", None]
    texts += [" ".join(f"u{k}" for k in range(30_000)) + " u3 u4 u5"]
    return list(enumerate(texts)) + [(None, "lone"), (3, texts[3]), (3, "other text of one id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id bigint, text string, n_words int, failed string, kept string")


def test_measures_against_plain_python(spark):
    rows = corpus()
    got = sorted(tuple(r) for r in rules.measure(frame(spark, rows).filter("doc_id is not null")).collect())
    assert got == sorted((i, *measured(t)) for i, t in rows if i is not None)
    assert [tuple(r) for r in rules.measure(frame(spark, rows).filter("doc_id is null")).collect()] == [(None, *measured("lone"))]


def test_windows_whose_hashes_share_their_high_bits(spark, monkeypatch):
    """With all bits for places every window is a candidate, with hardly any the text is too long for them; words decide in either case."""
    rows = corpus()
    for bits in (62, 2):
        monkeypatch.setattr(rules, "PLACE_BITS", bits)
        got = {r.doc_id: r.n_repeat_words for r in rules.measure(frame(spark, rows[:160])).collect()}
        assert got == {i: measured(t)[-1] for i, t in rows[:160]}


def test_bits_policies_and_ablations(spark):
    stored = rules.ledger(frame(spark, corpus())).cache()
    rows = stored.collect()
    names = [name for name, _ in rules.RULES]
    fails = {
        "few_words": lambda r: r.n_words < 50,
        "repeated_words": lambda r: 100 * r.n_repeat_words > 50 * r.n_words,
        "symbols": lambda r: 100 * r.n_symbols > 5 * r.word_chars,
        "repeated_lines": lambda r: 100 * r.n_dup_lines > 60 * r.n_lines,
        "short_words": lambda r: r.word_chars < 2 * r.n_words,
        "long_words": lambda r: r.word_chars > 20 * r.n_words,
        "many_words": lambda r: r.n_words > 100000,
        "one_line": lambda r: r.n_lines == 1 and r.n_words > 1000,
    }
    failed = [{name for name in names if fails[name](r)} for r in rows]
    assert [r.failed for r in rows] == [sum(1 << names.index(x) for x in f) for f in failed]
    for policy in rules.POLICIES:
        mine = [f & set(policy.rules) for f in failed]
        out = stored.select(rules.kept(policy).alias("kept"), rules.decisive(policy).alias("rule"), rules.without(policy, ("symbols", "few_words")).alias("less")).collect()
        assert [r.kept for r in out] == [not f for f in mine]
        assert [r.rule for r in out] == [next(iter(f)) if len(f) == 1 else None for f in mine]
        assert [r.less for r in out] == [not f - {"symbols", "few_words"} for f in mine]
        table = {r["rule"]: r for r in rules.ablation(stored, policy).collect()}
        assert set(table) == set(policy.rules)
        for rule, r in table.items():
            assert (r["rows"], r.dropped, r.failing, r.alone) == (len(rows), sum(map(bool, mine)), sum(rule in f for f in mine), sum(f == {rule} for f in mine))
            assert r.words_alone == sum(x.n_words for x, f in zip(rows, mine) if f == {rule})
    by_id = {r.doc_id: r for r in rules.seen(stored, ("doc_id",)).collect()}
    assert by_id[3].any_fails & by_id[3].all_fail == by_id[3].all_fail


def test_empty_table(spark):
    empty = rules.ledger(frame(spark, []))
    assert empty.count() == 0 and rules.ablation(empty, rules.POLICIES[-1]).count() == 0
