import json

import pytest
from pyspark.sql import functions as F

from larkspur.sources import load
from larkspur.streaming import monitor

ROWS = [{"id": f"q{k}", "question": f"what, is {k}?", "meta": {"level": k}} for k in range(4)]


def test_json_layouts(spark, tmp_path):
    for name, body in {"list": ROWS, "held": {"data": ROWS, "version": 1}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        assert sorted(r.id for r in load.read_dataset(spark, name, folders=(str(tmp_path),)).collect()) == ["q0", "q1", "q2", "q3"]
    (tmp_path / "one.json").write_text(json.dumps(ROWS[0]))
    assert load.read_dataset(spark, str(tmp_path / "one.json")).count() == 1


def test_jsonl_skips_bad_lines_and_numbers_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join([json.dumps(ROWS[0]), "", "{broken", json.dumps(ROWS[1])]) + "\n")
    assert sorted(r.id for r in load.read_dataset(spark, str(path)).filter("id is not null").collect()) == ["q0", "q1"]
    lines = {r.line: r.value for r in load.numbered_lines(spark, str(path)).collect()}
    assert json.loads(lines[0])["id"] == "q0" and lines[2] == "{broken" and len(lines) == 4


@pytest.mark.parametrize("separator", [",", ";", "\t"])
def test_csv_delimiters_and_json_cells(spark, tmp_path, separator):
    path = tmp_path / "x.csv"
    path.write_text(separator.join(["id", "cell"]) + "\n" + separator.join(["1", '"{""a"": 5}"']) + "\n" + separator.join(["2", "plain"]) + "\n")
    df = load.json_cells(load.read_dataset(spark, str(path)), ["cell"])
    assert [tuple(r) for r in df.select("id", F.expr("variant_get(cell_json, '$.a', 'int')")).orderBy("id").collect()] == [("1", 5), ("2", None)]


@pytest.mark.parametrize("kind", ["jsonl", "csv", "parquet", "orc"])
def test_conversion_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a,b\"c", [1, 2]), (2, None, [])], "id int, t string, xs array<int>")
    load.convert(df, str(tmp_path / f"out.{kind}"), kind)
    back = load.read_dataset(spark, str(tmp_path / f"out.{kind}"), kind)
    assert [(int(r.id), r.t) for r in back.orderBy("id").collect()] == [(1, 'a,b"c'), (2, None)]


def test_missing_empty_and_custom(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load.read_dataset(spark, "nothing", folders=(str(tmp_path),))
    spark.range(0).write.parquet(str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError):
        load.read_dataset(spark, str(tmp_path / "none.parquet"))
    load.register_loader("lines", lambda s, p: s.read.text(p))
    (tmp_path / "x.txt").write_text("a\nb\n")
    assert load.read_dataset(spark, str(tmp_path / "x.txt"), "lines").count() == 2


def test_stream_of_rows(spark, tmp_path):
    schema = "eval_id string, model_id string, is_correct boolean, latency_ms bigint, cost_usd double, timestamp timestamp_ntz"
    spark.sql("SELECT 'e' || id AS eval_id, 'm' || id % 2 AS model_id, id % 3 = 0 AS is_correct, id AS latency_ms, 0.5D AS cost_usd, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) AS timestamp FROM range(100)").write.json(str(tmp_path / "in"))
    stream = monitor.distinct_rows(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    started = stream.writeStream.foreachBatch(monitor.upserting(str(tmp_path / "out"), ["eval_id"])).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    started.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out" / "v0"))
    assert out.count() == 100
    assert monitor.running_figures(out).agg(F.sum("n")).first()[0] == 100
