"""The work queue (inventory J15, W5, W6, W10, A57, X4): entries are users, orders and events of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import queue as Q
from larkspur.registry import query

#: Order within a slot, and the slots: the leading columns of the whole order.
ORDER = ["o_orderkey"], ["o_orderpriority", "o_orderdate"]

#: Which event is which action of the entry of its user.
ACTION = "CASE WHEN event_type = 'view' THEN CASE WHEN {k} % 3 = 0 THEN 'enqueue' ELSE 'start' END WHEN event_type = 'click' THEN CASE WHEN {k} % 4 = 0 THEN 'enqueue' ELSE 'start' END WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'error' THEN 'fail' WHEN {k} % 10 = 0 THEN 'cancel' ELSE 'prioritise' END"


def commands(v):
    """entry, ts, seq, action, value from events."""
    k = "cast(get_json_object(props, '$.k') AS int)"
    return v.raw("events").select(F.col("user_id").alias("entry"), "ts", F.col("event_id").alias("seq"), F.expr(ACTION.format(k=k)).alias("action"), F.expr(k).alias("value"))


@query("w10_state_machine")
def state_machine(v):
    """Every transition of every entry, with releases of retries."""
    return Q.lifecycle(commands(v)).withColumns({"ts": F.timestamp_micros("ts"), "due": F.timestamp_micros("due")})


@query("x4_queue_standing")
def queue_standing(v):
    """Where each entry stands after its last event."""
    return Q.standing(Q.lifecycle(commands(v)))


@query("a57_queue_metrics")
def queue_metrics(v):
    """Entries by status, with mean wait and run in seconds and completions an hour of the log's span."""
    log = Q.lifecycle(commands(v))
    now = Q.standing(log)
    span = log.agg(((F.max("ts") - F.min("ts")) / 3.6e9).alias("hours"))
    wait, run = (F.avg(F.when(F.col("status") == "completed", (F.col(b) - F.col(a)) / 1e6)) for a, b in (("queued_at", "started_at"), ("started_at", "done_at")))
    each = now.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("attempts").alias("attempts"), wait.alias("wait_seconds"), run.alias("run_seconds"))
    return each.crossJoin(F.broadcast(span)).withColumn("an_hour", F.when(F.col("status") == "completed", F.try_divide("n", "hours"))).drop("hours")  # one row


@query("w5_queue_positions", """SELECT o_orderkey AS id, place FROM (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS BIGINT) place FROM orders WHERE o_orderstatus = 'O')""")
def queue_positions(v):
    """Open orders by priority, then first come, first served."""
    waiting = v.raw("orders").filter("o_orderstatus = 'O'")
    return Q.prefix_sums(waiting, {"place": F.lit(1).cast("bigint")}, *ORDER).select(F.col("o_orderkey").alias("id"), "place")


@query("w6_admission", """WITH q AS (SELECT o_orderkey, row_number() OVER w AS place, sum(CAST(o_totalprice * 100 AS BIGINT)) OVER w AS cost, sum(n) OVER w AS lines
    FROM orders JOIN (SELECT l_orderkey, count(*) n, sum(l_quantity) quantity FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'
    WINDOW w AS (ORDER BY o_orderpriority, o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)),
room AS (SELECT sum(CAST(o_totalprice * 100 AS BIGINT)) // 10 AS cost, (SELECT count(*) // 12 FROM lineitem) AS lines FROM orders)
SELECT o_orderkey AS id, place FROM q WHERE place < (SELECT coalesce(min(q.place), 9223372036854775807) FROM q, room WHERE q.cost > room.cost OR q.lines > room.lines OR q.place > 5000)""")
def admission(v):
    """Open orders admitted until the first for which a tenth of all money, a twelfth of all lines or 5000 places do not suffice."""
    lines = v.raw("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    waiting = v.raw("orders").filter("o_orderstatus = 'O'").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    money = v.raw("orders").agg(F.expr("sum(cast(round(o_totalprice * 100) as bigint)) div 10")).first()[0] or 0
    room = {"cost": money, "lines": v.raw("lineitem").count() // 12}
    return Q.admit(waiting, {"cost": cents, "lines": F.col("lines")}, room, *ORDER, max_count=5000).select(F.col("o_orderkey").alias("id"), "place")


def dependencies(v):
    """Events as entries: an event needs the one before it of its user, and the one before it of its kind and k. Errors failed; signups and every eighth other event wait."""
    e = v.raw("events").withColumn("k", F.get_json_object("props", "$.k"))
    state = F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "failed").when((F.col("event_type").isin("signup", "error")) | (F.col("event_id") % 8 == 0), "waiting").otherwise("completed")
    before = lambda *keys: F.lag("event_id").over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    edges = e.select("event_id", before("user_id").alias("a"), before("event_type", "k").alias("b")).select("event_id", F.explode(F.array("a", "b")).alias("needs")).filter("needs is not null")
    return e.select(F.col("event_id").alias("id"), state.alias("state")), edges.select(F.col("event_id").alias("id"), "needs")


@query("j15_ready_entries", """WITH e AS (SELECT *, props->>'$.k' AS k FROM events),
s AS (SELECT event_id AS id, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'failed' WHEN event_type IN ('signup', 'error') OR event_id % 8 = 0 THEN 'waiting' ELSE 'completed' END state FROM e),
d AS (SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS needs FROM e UNION SELECT event_id, lag(event_id) OVER (PARTITION BY event_type, k ORDER BY ts, event_id) FROM e)
SELECT s.id, count(needs) AS dependencies FROM s LEFT JOIN d ON d.id = s.id AND needs IS NOT NULL LEFT JOIN s n ON n.id = needs WHERE s.state <> 'completed' GROUP BY s.id HAVING count(needs) = count(needs) FILTER (n.state = 'completed')""")
def ready_entries(v):
    """Entries whose needs are all completed."""
    from larkspur.operators.windows import ready

    status, edges = dependencies(v)
    return ready(status, edges.distinct())


@query("j15_release_waves")
def release_waves(v):
    """When each waiting entry can run, wave by wave, and what is blocked for good."""
    return Q.release_waves(*dependencies(v))
