"""A work queue over tables: life cycles of entries from an event log, admission under limits, release through dependencies.

Entries move between ready, running, waiting (for a retry), completed, failed and cancelled. An event that does not fit
an entry's state changes nothing and is marked as not accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from larkspur.sources.scratch import scratch

MINUTE = 60_000_000
MAX_ATTEMPTS = 3
LOG = "entry bigint, ts bigint, seq bigint, action string, accepted boolean, status string, attempts int, priority int, due bigint"


@dataclass
class Entry:
    """Where an entry stands; times are microseconds."""

    status: str = ""  # none of the names: not in the queue
    attempts: int = 0
    priority: int = 0
    queued: int = 0
    started: int = 0
    due: int = 0  # when a waiting entry may run again

    def release(self, now: int) -> bool:
        """The timer: a waiting entry is ready again once its time has come."""
        if self.status != "waiting" or now < self.due:
            return False
        self.status = "ready"
        return True

    def apply(self, action: str, now: int, value: int) -> bool:
        """Whether the event was accepted. Retries wait 2 ** attempts minutes."""
        running, known = self.status == "running", self.status not in ("", "cancelled")
        if action == "enqueue" and not known:
            self.__init__("ready", 0, value, now)
        elif action == "start" and self.status == "ready":
            self.status, self.started = "running", now
        elif action == "complete" and running:
            self.status = "completed"
        elif action == "fail" and running:
            self.attempts += 1
            again = self.attempts < MAX_ATTEMPTS
            self.status, self.due = ("waiting", now + 2**self.attempts * MINUTE) if again else ("failed", 0)
        elif action == "cancel" and known:
            self.status = "cancelled"
        elif action == "prioritise" and known:
            self.priority = value
        else:
            return False
        return True


def _step(entry: Entry, key: int, ts: int, seq: int, action: str, value: int) -> list[tuple]:
    """What one event adds to the log: a release that was due before it, and the event."""
    out = []
    due = entry.due
    if entry.release(ts):
        out.append((key, due, None, "release", True, entry.status, entry.attempts, entry.priority, None))
    accepted = entry.apply(action, ts, value)
    out.append((key, ts, seq, action, accepted, entry.status, entry.attempts, entry.priority, entry.due if entry.status == "waiting" else None))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in LOG.split(", ")])
    return frame.astype({"ts": "Int64", "seq": "Int64", "due": "Int64"})


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by entry and time; only the entry at hand is kept, across frames."""
    key, entry = None, Entry()
    for f in frames:
        rows = []
        for k, ts, seq, action, value in zip(f["entry"], f["ts"], f["seq"], f["action"], f["value"]):
            if k != key:
                key, entry = k, Entry()
            rows += _step(entry, int(k), int(ts), int(seq), action, int(value))
        yield _frame(rows)


def lifecycle(events: DataFrame) -> DataFrame:
    """The log of every entry: its events (entry, ts, seq, action, value) in order of ts and seq, and releases where they came due.

    An ordered fold: rows are hashed by entry and sorted, and stream through a task, which holds one entry's state, so
    an entry of any length takes no more memory. Events without an entry, time or action are left out; a null value is 0.
    """
    known = events.dropna(subset=["entry", "ts", "action"])
    rows = known.select(F.col("entry").cast("bigint").alias("entry"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("seq").cast("bigint").alias("seq"), "action", F.coalesce(F.col("value").cast("int"), F.lit(0)).alias("value"))
    rows = rows.fillna(0, ["seq"]).repartition("entry").sortWithinPartitions("entry", "ts", "seq")
    return rows.mapInPandas(_fold, LOG)


def standing(log: DataFrame) -> DataFrame:
    """The newest state of each entry in a log: status, attempts, priority, when it was queued, and when it ran last and was done, in microseconds."""
    moment = F.struct("ts", F.coalesce("seq", F.lit(-1)))
    last = F.max_by(F.struct("status", "attempts", "priority"), moment)
    time = lambda *actions: F.max(F.when(F.col("accepted") & F.col("action").isin(*actions), F.col("ts")))
    found = log.groupBy("entry").agg(last.alias("s"), time("enqueue").alias("queued_at"), time("start").alias("started_at"), time("complete").alias("done_at"))
    return found.select("entry", "s.*", "queued_at", "started_at", "done_at").filter("status != ''")


STATE = "status string, attempts int, priority int, queued bigint, started bigint, due bigint, pending array<struct<ts:bigint,seq:bigint,action:string,value:int>>"


def _advance(key, frames, state):
    """Keep events until the watermark has passed them, so that they apply in order; wake up for the next one, or for a retry."""
    now = state.getCurrentWatermarkMs() * 1000
    *kept, pending = state.get if state.exists else (*asdict(Entry()).values(), [])
    entry, pending = Entry(*kept), [tuple(p) for p in pending]
    for f in frames:
        pending += [(int(t), int(s), a, int(v)) for t, s, a, v in zip(f["micros"], f["seq"], f["action"], f["value"])]
    pending.sort()
    out = []
    while pending and pending[0][0] < now:
        ts, seq, action, value = pending.pop(0)
        out += _step(entry, int(key[0]), ts, seq, action, value)
    due = entry.due
    if entry.release(now):  # no event before the watermark can come any more
        out.append((int(key[0]), due, None, "release", True, entry.status, entry.attempts, entry.priority, None))
    state.update((*asdict(entry).values(), pending))
    wake = pending[0][0] if pending else entry.due if entry.status == "waiting" else 0
    if wake:
        state.setTimeoutTimestamp(max(wake, now) // 1000 + 1)
    yield _frame(out)


def lifecycle_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """As ``lifecycle``, over a stream: what it has logged so far is the batch log of all events before the watermark, which
    events may come in any order; retries come due by event-time timers. Rows later than ``late`` behind the newest are left out."""
    known = events.dropna(subset=["entry", "ts", "action"]).withWatermark("ts", late)
    rows = known.select("entry", "ts", F.unix_micros("ts").alias("micros"), F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"), "action", F.coalesce(F.col("value").cast("int"), F.lit(0)).alias("value"))
    return rows.groupBy("entry").applyInPandasWithState(_advance, LOG, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def prefix_sums(df: DataFrame, sums: dict[str, Column], order: list[str], slot: list[str]) -> DataFrame:
    """Running sums over a whole table in one order. ``slot`` holds the leading columns of that order, so that rows are
    sorted within slots; only the table of slots, one row each, is summed in one place."""
    slots = [f"_slot{k}" for k in range(len(slot))]
    rows = df.withColumns({s: F.col(c) for s, c in zip(slots, slot)} | {f"_{n}": c for n, c in sums.items()})
    totals = rows.groupBy(*slots).agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    before = Window.orderBy(*slots).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(s).alias(f"_of{s}") for s in slots], *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    within = Window.partitionBy(*slots).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_{n}": F.sum(f"_{n}").over(within) for n in sums})
    same = None
    for s in slots:
        this = F.col(s).eqNullSafe(F.col(f"_of{s}"))
        same = this if same is None else same & this
    joined = rows.join(totals, same)
    return joined.withColumns({n: F.col(f"_{n}") + F.col(f"_before_{n}") for n in sums}).drop(*slots, *[f"_of{s}" for s in slots], *[f"_{n}" for n in sums], *[f"_before_{n}" for n in sums])


def admit(queue: DataFrame, needs: dict[str, Column], limits: dict[str, float], order: list[str], slot: list[str], max_count: int | None = None) -> DataFrame:
    """Entries taken in order until the first that any resource has no room for, or until there are ``max_count``.

    ``needs`` gives what an entry takes of each resource (null: nothing), ``limits`` what there is. Needs may be negative, as
    where an entry gives room back, so the first misfit is looked for, and only what stands before it is taken.
    """
    if max_count is not None:
        needs, limits = needs | {"_count": F.lit(1)}, limits | {"_count": max_count}
    sums = {f"_used_{n}": F.coalesce(c, F.lit(0)) for n, c in needs.items()} | {"_place": F.lit(1).cast("bigint")}
    placed = prefix_sums(queue, sums, order, slot)
    over = F.lit(False)
    for n, most in limits.items():
        over = over | (F.col(f"_used_{n}") > most)
    first = placed.filter(over).agg(F.min("_place").alias("_stop"))
    taken = placed.crossJoin(F.broadcast(first)).filter(F.col("_stop").isNull() | (F.col("_place") < F.col("_stop")))  # one row
    return taken.select(*queue.columns, F.col("_place").alias("place"))


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a frontier up to which it is broadcast.
FRONTIER = 200_000


class _Pieces:
    """A table that grows piece by piece. Eight pieces of a class are written together as one of the next class, so there are never many, and a row is written once a class."""

    def __init__(self, spark: SparkSession, schema: str, label: str):
        self.spark, self.schema, self.label = spark, schema, label
        self.classes: list[list[str]] = [[]]

    def read(self, paths: list[str] | None = None) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(paths or [p for c in self.classes for p in c]))

    def _write(self, df: DataFrame, k: int) -> DataFrame:
        path = scratch(self.spark, self.label)
        df.write.parquet(path)
        self.classes[k].append(path)
        return self.read([path])

    def add(self, df: DataFrame) -> DataFrame:
        """Write a piece and read it back."""
        piece, k = self._write(df, 0), 0
        while len(self.classes[k]) == 8:
            if k + 1 == len(self.classes):
                self.classes.append([])
            self._write(self.read(self.classes[k]), k + 1)
            self.classes[k] = []
            k += 1
        return piece


def _hinted(df: DataFrame) -> DataFrame:
    """Broadcast a written table of a round if it is small; what it meets is then only read, not shuffled."""
    return F.broadcast(df) if df.limit(FRONTIER + 1).count() <= FRONTIER else df


def release_waves(status: DataFrame, edges: DataFrame) -> DataFrame:
    """When each entry that is not completed can run: id, wave (0: all it needs is completed; k: what it needs runs in waves before k),
    or no wave and a reason: 'failed' if it failed or needs what did, directly or not, else 'cycle' for entries on a cycle or behind one.

    status: id, state; edges: id, needs. Needs that are not in status count as failed; edges of unknown ids are left out. Losses spread
    first, then waves pass over the rest. Each round writes only what it changes, so that all rounds together write each entry and
    each need once or a few times, however many there are; what a small round meets is read, not shuffled.
    """
    known = status.dropna(subset=["id"]).groupBy("id").agg(F.max("state").alias("state"))
    needs = edges.dropna().distinct().join(known.select("id"), "id", "left_semi")
    of = known.select(F.col("id").alias("needs"), F.coalesce("state", F.lit("")).alias("need_state"))
    waiting = _written(known.filter("state is null or state != 'completed'"), "waiting")
    # What is not completed yet, with the state of what it needs.
    unmet = needs.join(of, "needs", "left").filter("need_state is null or need_state != 'completed'").join(waiting.select("id"), "id", "left_semi")
    unmet = _written(unmet.select("id", "needs", (F.col("need_state").isNull() | (F.col("need_state") == "failed")).alias("lost")), "unmet")
    spark, kind = status.sparkSession, waiting.schema["id"].dataType.simpleString()
    lost = _Pieces(spark, f"id {kind}", "lost")
    frontier = lost.add(waiting.filter("state = 'failed'").select("id").union(unmet.filter("lost").select("id")).distinct())
    while not frontier.isEmpty():
        behind = _hinted(_written(unmet.join(_hinted(frontier.select(F.col("id").alias("needs"))), "needs", "left_semi").select("id").distinct(), "behind"))
        again = lost.read().join(behind, "id", "left_semi")  # no more rows than behind
        frontier = lost.add(behind.join(again, "id", "left_anti"))
    left = waiting.select("id").join(lost.read(), "id", "left_anti")
    open_ = _written(unmet.select("id", "needs").join(lost.read(), "id", "left_anti"), "open")
    # How many needs each entry has, less those that were met in each round.
    balance = _Pieces(spark, f"id {kind}, n bigint", "balance")
    counted = balance.add(open_.groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    waves = _Pieces(spark, f"id {kind}, wave int", "waves")
    frontier, wave = waves.add(left.join(counted, "id", "left_anti").select("id", F.lit(0).alias("wave"))), 0
    while not frontier.isEmpty():
        wave += 1
        met = open_.join(_hinted(frontier.select(F.col("id").alias("needs"))), "needs", "left_semi").groupBy("id").agg((-F.count(F.lit(1))).alias("n"))
        touched = _hinted(balance.add(met).select("id"))
        free = balance.read().join(touched, "id", "left_semi").groupBy("id").agg(F.sum("n").alias("n")).filter("n = 0")
        frontier = waves.add(free.select("id", F.lit(wave).alias("wave")))
    none = F.lit(None).cast("int").alias("wave")
    ran, stuck = waves.read(), left.join(waves.read(), "id", "left_anti")
    out = ran.select("id", "wave", F.lit(None).cast("string").alias("reason")).unionByName(lost.read().select("id", none, F.lit("failed").alias("reason")))
    return out.unionByName(stuck.select("id", none, F.lit("cycle").alias("reason")))
