import pytest
from pyspark.sql import functions as F

from larkspur.llm.sharding import Manifest, Run, Store


def test_compaction_keeps_rows_and_versions(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit("x").alias("__run"))
    store = Store(spark, f"file://{tmp_path}/store")
    store.append(df.drop("__run"), F.pmod("doc_id", F.lit(8)))
    now = store.manifest()
    assert sorted(r.name for r in now.runs) == ["L1-0", "L1-1"]
    assert store.versions() == list(range(1, 11))
    rows = store.read().select("doc_id", "text", "__arrival", "__run").collect()
    assert {(r.doc_id, r["__arrival"], r["__run"]) for r in rows} == {(k, k % 8, f"L1-{k % 8 // 4}") for k in range(4000)} and len(rows) == 4000
    assert store.read(3).count() == 1500  # three arrivals
    store.vacuum()
    assert store.read().count() == 4000


def test_a_version_is_taken_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.append(spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id bigint, text string"))
    assert not store.commit(Manifest(1, "", {}, []))
    assert store.read().count() == 3


def test_overtaken_writers_start_over(spark, tmp_path):
    """Another writer commits between a writer's look at the manifest and its commit, both for an append and for a merge."""
    root = f"file://{tmp_path}/store"
    lot = lambda k: spark.range(100 * k, 100 * k + 100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    store, other = Store(spark, root), Store(spark, root)
    commit, turns = store.commit, iter([True, False, True])

    def overtaken(new):
        if next(turns, False):
            other.append(lot(90 + new.version))
        return commit(new)

    store.commit = overtaken
    for k in range(5):
        store.append(lot(k))
    assert sorted(r.doc_id for r in store.read().collect())[:500] == list(range(500)) and store.read().count() == 700
    assert len({r.path for r in store.manifest().runs}) == len(store.manifest().runs)

    # a merge whose runs another writer has merged already is dropped
    store = Store(spark, f"file://{tmp_path}/second")
    other = Store(spark, f"file://{tmp_path}/second")
    store.compact = lambda: None
    for k in range(4):
        store.append(lot(k))
    del store.compact
    commit, turns = store.commit, iter([True])

    def beaten(new):
        if next(turns, False):
            other.compact()
        return commit(new)

    store.commit = beaten
    store.compact()
    assert [r.name for r in store.manifest().runs] == ["L1-0"] and store.read().count() == 400
    store.vacuum(lost_after_hours=-1)
    assert len(list((tmp_path / "second" / "data").iterdir())) == 1


def test_columns_named_like_the_store_s_own(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([(1, "t", "a", "b", "c"), (None, None, None, None, None)], "doc_id bigint, text string, __tier string, __run string, __arrival string")
    store.append(df, F.col("doc_id"))
    rows = {r.doc_id: r for r in store.read().collect()}
    assert (rows[1]["__tier_given"], rows[1]["__run_given"], rows[1]["__arrival_given"], rows[1]["__tier"], rows[1]["__arrival"]) == ("a", "b", "c", 0, 1)
    assert rows[None]["__arrival"] == 0


def test_empty_arrival(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.append(spark.createDataFrame([], "doc_id bigint, text string"))
    assert store.read().count() == 0


def test_due_takes_similar_sizes_of_one_tier():
    runs = [Run(f"r{k}", 0, "", size, 1) for k, size in enumerate([10, 100, 12, 15, 19, 400])]
    assert [r.bytes for r in Store.due(runs)] == [10, 12, 15, 19]
    assert Store.due(runs[:4]) == []


def test_batches_of_unlike_columns_across_merges_and_vacuum(spark, tmp_path):
    """Narrower, wider and reordered batches keep every value; merges that see an older schema do not drop what came later."""
    store = Store(spark, f"file://{tmp_path}/store")
    batches = [
        ("doc_id bigint, text string", [(1, "a"), (2, None)]),
        ("text string, doc_id bigint", [("c", 3)]),
        ("doc_id bigint", [(4,)]),
        ("doc_id bigint, text string, tags array<string>, meta struct<k:int,v:string>", [(5, "e" * 300_000, ["x"], (1, "y"))]),
        ("lang string", [("en",)]),
        ("doc_id bigint, lang string", [(7, "de")]),
        ("tags array<string>, doc_id bigint", [(["z", None], 8)]),
        ("doc_id bigint, text string", [(9, "i")]),
    ]
    expected = set()
    for schema, rows in batches:
        store.append(spark.createDataFrame(rows, schema))
        names = [c.split()[0] for c in schema.split(", ")]
        for row in rows:
            now = dict(zip(names, row))
            expected.add(tuple(str(now.get(c)) for c in ("doc_id", "text", "tags", "lang")))
        got = store.read()
        assert {tuple(str(r[c]) if c in got.columns else "None" for c in ("doc_id", "text", "tags", "lang")) for r in got.collect()} == expected
        store.vacuum(lost_after_hours=-1)
        assert store.read().count() == len(expected)
    assert len(store.manifest().runs) < len(batches)
    assert {tuple(str(r[c]) for c in ("doc_id", "text", "tags", "lang")) for r in store.read().collect()} == expected
    assert store.read().filter("doc_id = 5").first().meta.v == "y"


def test_clashes_of_type_are_refused_before_the_write(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.append(spark.createDataFrame([(1, "a", (1,))], "doc_id bigint, text string, meta struct<k:int>"))
    before = sorted(p.name for p in (tmp_path / "store" / "data").iterdir())
    for schema in ("doc_id int", "doc_id string", "text binary", "meta struct<k:bigint>", "meta struct<k:int,v:int>", "Text string"):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([], schema))
    assert sorted(p.name for p in (tmp_path / "store" / "data").iterdir()) == before and store.manifest().version == 1
    assert [tuple(r)[:2] for r in store.read().collect()] == [(1, "a")]


def test_a_writer_overtaken_by_one_with_other_columns(spark, tmp_path):
    """The schema is united with that of the manifest that the writer's change goes on top of, and a clash that came in between is refused."""
    root = f"file://{tmp_path}/store"
    store, other = Store(spark, root), Store(spark, root)
    commit, turns = store.commit, iter([True])

    def overtaken(new):
        if next(turns, False):
            other.append(spark.createDataFrame([(2, "de")], "doc_id bigint, lang string"))
        return commit(new)

    store.commit = overtaken
    store.append(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    assert {(r.doc_id, r.text, r.lang) for r in store.read().collect()} == {(1, "a", None), (2, None, "de")}
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(3, 1)], "doc_id bigint, lang int"))
    assert store.read().count() == 2
