"""The work queue against plain Python."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from larkspur.operators import queue as Q
from larkspur.plans import bridge
from larkspur.plans import queue as plans

START = datetime(2024, 1, 1)
EVENTS = "entry bigint, ts timestamp, seq bigint, action string, value int"


def machine(events):
    """The same rules, written out by state: entry -> list of (ts, seq, action, accepted, status, attempts, priority, due)."""
    out = defaultdict(list)
    now = {}
    for entry, ts, seq, action, value in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        status, attempts, priority, due = now.get(entry, (None, 0, 0, None))
        if status == "waiting" and ts >= due:
            out[entry].append((due, None, "release", True, "ready", attempts, priority, None))
            status, due = "ready", None
        old = (status, attempts, priority, due)
        new = {
            (None, "enqueue"): ("ready", 0, value, None),
            ("cancelled", "enqueue"): ("ready", 0, value, None),
            ("ready", "start"): ("running", attempts, priority, None),
            ("running", "complete"): ("completed", attempts, priority, None),
            ("running", "fail"): ("waiting", attempts + 1, priority, ts + timedelta(minutes=2 ** (attempts + 1))) if attempts < 2 else ("failed", attempts + 1, priority, None),
        }.get((status, action))
        if new is None and status not in (None, "cancelled"):
            new = {"cancel": ("cancelled", attempts, priority, None), "prioritise": (status, attempts, value, due)}.get(action)
        now[entry] = new or old
        out[entry].append((ts, seq, action, new is not None, now[entry][0] or "", *now[entry][1:]))
    return out


def logged(rows):
    out = defaultdict(list)
    at = lambda us: None if us is None else START + timedelta(microseconds=us - 1704067200000000)
    for r in sorted(rows, key=lambda r: (r.entry, r.ts, -1 if r.seq is None else r.seq)):
        out[r.entry].append((at(r.ts), r.seq, r.action, r.accepted, r.status, r.attempts, r.priority, at(r.due)))
    return out


def log_of(seed=1, entries=40, n=4000):
    rng = random.Random(seed)
    actions = ["enqueue", "start", "start", "complete", "fail", "fail", "fail", "cancel", "prioritise"]
    return [(rng.randrange(entries) if rng.random() < 0.7 else 0, START + timedelta(seconds=rng.randrange(40_000)), k, rng.choice(actions), rng.randrange(9)) for k in range(n)]


def test_every_transition_of_random_logs(spark):
    """A third of all events are of one entry; rows come in any order and over several batches of a task."""
    events = log_of()
    df = spark.createDataFrame(events, EVENTS).repartition(7)
    found = Q.lifecycle(df).collect()
    expected = machine(events)
    assert logged(found) == expected
    assert {s for rows in expected.values() for _, _, _, _, s, *_ in rows} == {"", "ready", "running", "waiting", "completed", "failed", "cancelled"}
    last = {r.entry: (r.status, r.attempts, r.priority) for r in Q.standing(Q.lifecycle(df)).collect()}
    assert last == {e: rows[-1][4:7] for e, rows in expected.items() if rows[-1][4]}


def test_rows_without_entry_time_or_action(spark):
    rows = [(None, START, 1, "enqueue", 1), (1, None, 2, "enqueue", 1), (1, START, 3, None, 1), (1, START, None, "enqueue", None), (1, START, 5, "unheard of", 2)]
    found = Q.lifecycle(spark.createDataFrame(rows, EVENTS)).collect()
    assert [(r.action, r.accepted, r.status, r.priority) for r in found] == [("enqueue", True, "ready", 0), ("unheard of", False, "ready", 0)]
    assert Q.lifecycle(spark.createDataFrame([], EVENTS)).count() == 0


def test_the_tables_log(spark, sf):
    v = bridge.views(spark, sf)
    events = [tuple(r) for r in plans.commands(v).collect()]
    assert logged(Q.lifecycle(plans.commands(v)).collect()) == machine(events)


def test_stream_agrees_with_batch_up_to_the_watermark(spark, tmp_path):
    """Events come in small files, out of order within ten minutes; one comes too late. Timers release retries without a further event."""
    waits = [(50, START + timedelta(seconds=k), 5000 + k, action, 4) for k, action in enumerate(("enqueue", "start", "fail"))]
    events = sorted(log_of(3, 6, 397) + waits, key=lambda e: e[1])
    rng = random.Random(0)
    shuffled = sorted(events, key=lambda e: e[1] + timedelta(seconds=rng.randrange(500)))
    late = (3, START + timedelta(seconds=5), 9999, "cancel", 0)
    lots = [shuffled[k : k + 40] for k in range(0, 400, 40)]
    lots[-1].append(late)
    lots.append([(99, START + timedelta(hours=13), 10_000, "enqueue", 1)])  # moves the watermark past all others
    lots.append([(99, START + timedelta(hours=13, minutes=1), 10_001, "start", 1)])
    for k, lot in enumerate(lots):
        spark.createDataFrame(lot, EVENTS).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k:02d}")
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    run = Q.lifecycle_stream(source).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out")
    run.awaitTermination(300)
    got = logged(spark.read.schema(Q.LOG).parquet(f"file://{tmp_path}/out").collect())
    expected = machine(events)
    for entry, rows in expected.items():
        final = rows[-1]
        if final[4] == "waiting":
            rows = [*rows, (final[7], None, "release", True, "ready", final[5], final[6], None)]
        assert got[entry] == rows
    assert any(rows[-1][4] == "waiting" for rows in expected.values())


def admitted(rows, limits, most):
    """rows of (priority, day, id, a, b)"""
    used, out = [0, 0], []
    for r in sorted(rows):
        used = [u + (x or 0) for u, x in zip(used, r[3:])]
        if any(u > m for u, m in zip(used, limits)) or len(out) + 1 > most:
            break
        out.append(r[2])
    return out


def test_admission_stops_at_the_first_misfit(spark):
    rng = random.Random(2)
    for limits, most in (((400, 10**6), 10**6), ((10**6, 90), 10**6), ((10**6, 10**6), 17), ((10**6, 10**6), 10**6), ((-1, 5), 10), ((60, 60), 0)):
        rows = [(rng.choice([None, 1, 2, 3][1:]), rng.randrange(6), k, rng.choice([None, 1, 5, 9, -4]), rng.randrange(4)) for k in range(200)]
        df = spark.createDataFrame(rows, "p int, day int, id int, a int, b int")
        out = Q.admit(df, {"a": F.col("a"), "b": F.col("b")}, dict(zip("ab", limits)), ["id"], ["p", "day"], most)
        got = sorted(out.collect(), key=lambda r: r.place)
        assert [r.id for r in got] == admitted(rows, limits, most) and [r.place for r in got] == list(range(1, len(got) + 1))


def kahn(status, edges):
    needs, dependents = defaultdict(set), defaultdict(set)
    for i, n in edges:
        if i in status and status[i] != "completed" and status.get(n) != "completed":
            needs[i].add(n)
            dependents[n].add(i)
    lost = {i for i in status if status[i] == "failed"} | {n for ns in needs.values() for n in ns if n not in status}
    todo = list(lost)
    while todo:
        for d in dependents[todo.pop()]:
            if d not in lost:
                lost.add(d)
                todo.append(d)
    wave, now = {}, [i for i in status if status[i] not in ("completed", "failed") and not needs[i]]
    depth = 0
    while now:
        wave |= dict.fromkeys(now, depth)
        after = {d for i in now for d in dependents[i] if d not in wave and all(n in wave for n in needs[d])}
        now, depth = [d for d in after if d not in lost], depth + 1
    return {i: (wave.get(i), None if i in wave else "failed" if i in lost else "cycle") for i in status if status[i] != "completed"}


def released(spark, status, edges):
    s = spark.createDataFrame(list(status.items()), "id bigint, state string")
    return {r.id: (r.wave, r.reason) for r in Q.release_waves(s, spark.createDataFrame(edges, "id bigint, needs bigint")).collect()}


def test_waves_of_random_graphs(spark):
    """Chains, a hot predecessor, cycles, what waits behind them, failures, unknown needs and repeated edges."""
    rng = random.Random(4)
    status = {i: rng.choice(["completed", "completed", "waiting", "waiting", "ready"]) for i in range(300)} | {7: "failed", 9: "waiting", 299: None}
    edges = [(i, rng.randrange(max(i, 1))) for i in range(1, 250) if i % 3] * 2 + [(i, 9) for i in range(100, 200)] + [(k + 1, k) for k in range(400, 408)]
    status |= {k: "waiting" for k in range(400, 409)} | {k: "waiting" for k in (500, 501, 502, 503, 504, 505)}
    edges += [(500, 501), (501, 502), (502, 500), (503, 500), (504, 504), (505, 12345), (10**6, 1), (9, 8)]
    assert released(spark, status, edges) == kahn(status, edges)
    expected = kahn(status, edges)
    assert max(w for w, _ in expected.values() if w is not None) >= 8 and {r for _, r in expected.values()} == {None, "failed", "cycle"}
    assert released(spark, {}, []) == {}


def test_waves_of_the_tables(spark, sf):
    v = bridge.views(spark, sf)
    status, edges = (f.collect() for f in plans.dependencies(v))
    expected = kahn({r.id: r.state for r in status}, [(r.id, r.needs) for r in edges])
    assert {r.id: (r.wave, r.reason) for r in Q.release_waves(*plans.dependencies(v)).collect()} == expected


def test_rounds_write_only_what_they_change(spark, monkeypatch):
    """A chain makes many rounds; what waits on cycles meanwhile is not written in each of them."""
    paths, place = [], Q.scratch
    monkeypatch.setattr(Q, "scratch", lambda s, label: paths.append(place(s, label)) or paths[-1])
    status = dict.fromkeys(range(2020), "waiting")
    edges = [(k + 1, k) for k in range(19)] + [(k, k ^ 1) for k in range(20, 2020)]
    assert released(spark, status, edges) == kahn(status, edges)
    assert sum(spark.read.parquet(p).count() for p in paths) < 3 * (len(status) + len(edges))


def test_waves_with_shuffled_frontiers(spark, monkeypatch):
    monkeypatch.setattr(Q, "FRONTIER", 3)
    rng = random.Random(8)
    status = {i: rng.choice(["completed", "waiting", "waiting", "waiting"]) for i in range(120)} | {50: "failed"}
    edges = [(i, rng.randrange(max(0, i - 30), i)) for i in range(1, 120) for _ in range(2) if i % 4]
    assert released(spark, status, edges) == kahn(status, edges)
