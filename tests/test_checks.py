"""Windows that split hot keys, upserts by parts, printed tables, checks and the command line, on small cases with known results."""

from pyspark.sql import functions as F

from larkspur import __main__ as cli
from larkspur.functions import render
from larkspur.operators import validate, windows
from larkspur.sources import results
from larkspur.streaming import monitor

EVENTS = "SELECT if(id % 7 = 0, NULL, 'a') AS key, timestamp'2024-01-01' + make_dt_interval(0, 0, CAST(pow(id, 2) AS int)) AS t, id, if(id < 5, NULL, CAST(id AS double)) AS x FROM range(60)"


def test_running_totals_equal_one_window(spark):
    df = spark.sql(EVENTS)
    got = windows.running_totals(df, "key", F.date_trunc("hour", "t"), ["t", "id"], {"n": F.lit(1).cast("bigint"), "total": F.col("x")})
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.t, r.id)):
        n, total = want.get(r.key, {}).get("last", (0, None))
        total = total if r.x is None else (total or 0.0) + r.x
        want.setdefault(r.key, {}).update({"last": (n + 1, total), r.id: (n + 1, total)})
    rows = got.collect()
    assert len(rows) == 60
    assert all((r.n, r.total) == want[r.key][r.id] for r in rows)


def test_sessions_split_at_the_pause_and_not_at_slots(spark):
    df = spark.sql("SELECT 'a' AS key, timestamp_seconds(s) AS t FROM VALUES (0), (1799), (3598), (5398), (NULL) AS v(s)")
    rows = windows.sessions(df, "key", "t", 30).selectExpr("unix_seconds(start) AS s", "unix_seconds(end) AS e", "n").orderBy("s").collect()
    assert [tuple(r) for r in rows] == [(0, 3598 + 1800, 3), (5398, 5398 + 1800, 1)]
    # over streams a pause of exactly that length still joins
    timed = df.filter("t is not null").select(F.col("key").alias("model_id"), F.col("t").alias("timestamp"))
    assert [r.n for r in monitor.sessions(timed).collect()] == [4]
    assert sorted(r.n for r in monitor.sessions(timed, "1799 seconds").collect()) == [1, 3]


def test_stratified_takes_its_total_from_uneven_strata(spark):
    df = spark.sql("SELECT if(id < 950, 'big', if(id < 998, 'mid', 'small')) AS s, CAST(id AS string) AS id FROM range(1000)")
    assert {r.s: r["count"] for r in windows.stratified(df, "s", "id", 31).groupBy("s").count().collect()} == {"big": 11, "mid": 10, "small": 2}


def test_upserting_parts_rewrites_touched_parts_and_takes_replays(spark, tmp_path):
    path = str(tmp_path / "table")
    write = monitor.upserting_parts(path, ["id"], parts=8)
    rows = lambda low, high, v: spark.range(low, high).select("id", F.lit(v).alias("v"))
    write(rows(0, 100, "first"), 0)
    write(rows(3, 4, "second"), 1)
    write(rows(100, 101, "third"), 2)
    write(rows(100, 101, "third"), 2)  # the batch comes again
    found = {r.id: r.v for r in monitor.newest_parts(spark, path).collect()}
    assert found == {k: "second" if k == 3 else "third" if k == 100 else "first" for k in range(101)}
    assert monitor.newest_parts(spark, path).count() == 101
    assert spark.read.parquet(path).filter("version = 1").select("part").distinct().count() == 1


def test_late_rows_do_not_reopen_a_closed_window(spark, tmp_path):
    schema = "model_id string, is_correct boolean, latency_ms bigint, cost_usd double, timestamp timestamp_ntz"
    lot = lambda at: spark.sql(f"SELECT 'm' AS model_id, true AS is_correct, 1L AS latency_ms, 0.5D AS cost_usd, timestamp_ntz'{at}' AS timestamp")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for at in ("2024-01-01 00:10:00", "2024-01-01 05:00:00", "2024-01-01 00:20:00", "2024-01-01 09:00:00"):
        lot(at).write.mode("append").json(source)
        stream = monitor.running_figures(spark.readStream.schema(schema).json(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = {str(r.start): r.n for r in spark.read.parquet(out).collect()}
    assert rows == {"2024-01-01 00:00:00": 1, "2024-01-01 05:00:00": 1}


def test_latex_escapes_each_character_once(spark):
    shown = spark.createDataFrame([("a_b\\c^{d}~&%$#",), ("",), (None,)], "t string").select(render.latex_text(F.col("t")).alias("t"), render.fixed(F.lit(0.0625), 3).alias("x")).collect()
    assert [r.t for r in shown] == ["a\\_b\\textbackslash{}c\\textasciicircum{}\\{d\\}\\textasciitilde{}\\&\\%\\$\\#", "", None]
    assert shown[0].x == "0.063"
    table = render.latex_table(["x & 1 \\\\"], ["Model", "AIC"], "Fits", "tab:fits").split("\n")
    assert table[4] == "\\begin{tabular}{lr}" and table[6] == "Model & AIC \\\\" and table[8] == "x & 1 \\\\"


def test_missing_fields_and_limits(spark):
    df = spark.createDataFrame([('{"run": 1, "models": null}',), ("not json",), (None,)], "doc string")
    assert {r.field: r.missing for r in validate.missing_fields(df, "doc", ["run", "models", "other"]).collect()} == {"run": 2, "models": 2, "other": 3}
    costs = spark.sql("SELECT * FROM VALUES ('a', 10.0D), ('b', 10.5D), ('c', NULL) AS t(run, cost)")
    assert [r.subject for r in validate.over_limit(costs, F.col("run"), "cost", 10.0, "warning", "cost").collect()] == ["b"]


def test_lock_changes_with_any_value(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'a', 'x'), (2, 'a', NULL), (3, 'b', 'x') AS t(id, u, w)").select("id", results.content_lock("w", "u").alias("lock")).collect()
    assert len({r.lock for r in rows}) == 3


def test_command_line(spark, sf, tmp_path, capsys):
    assert cli.main(["list", "v8_"]) == 0
    assert capsys.readouterr().out.split() == ["v8_limits", "v8_required_fields", "v8_run_data"]
    assert cli.main(["run", "a83_row_count", "--data", sf, "--out", str(tmp_path / "n"), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "n")).first().n > 0
    assert [o for _, o, _ in cli.smoke(spark, sf, ["a83_row_count", "nothing"], 60.0)] == ["ok", "KeyError"]
    assert cli.main(["smoke", "--data", str(tmp_path / "none"), "a83_row_count"]) == 1
