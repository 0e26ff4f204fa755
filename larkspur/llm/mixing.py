"""Mixing sources to target weights by entropy balancing.

Among all document rates up to a limit whose tokens meet every source's target, the
mix takes those closest to one in relative entropy, each document counting once. Its
dual is convex, with one variable l for each source, and its solution tilts every
document exponentially by its length x in mean lengths: the rate is exp(l x), or the
limit where that is more. A Newton step needs the sums of size x rate and of its slope
over all documents. Documents are first summed to kinds of one source and size; then
each step is one grouped sum over the table of kinds, for all sources at once, kept
within the bracket that earlier steps have left. Sums are decimal, so that they do not
depend on the order of rows and reruns agree.

Rates are rounded into whole copies so that errors cancel: in buckets of a few
hundred kinds of documents of one source, from the largest down, each takes the
number of copies next to its rate that keeps the running total nearest. Rows of one
source, id and size are one kind with a count, so that no bucket grows with rows
that repeat an id or have none.

Only DataFrame operations. Null sources form one source, ordered last; null or
empty texts have size 0, and so rate 1 and one copy; texts of any length are
counted whole; repeated rows each get copies; ties in size go by id, nulls last; an
empty table gives an empty mix. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import hinted, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that are rounded together, on average.
BUCKET = 256
#: Relative distance from the target at which Newton's steps end, and their number at most.
CLOSE, NEWTON_STEPS = 1e-9, 60
SUM = "decimal(38,6)"


def sizes(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source and size (words of the text) of each row."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, its place in order, source_size, docs, target. Weights repeat over sources in code point order, nulls last.

    Targets share ``share`` times all sizes by weight; none exceeds ``most`` times its source's size, and what is cut
    off goes to the others by weight. That is a water level: sources are capped in order of cap over weight, and the
    level of the first source that stays below its cap holds for all that follow.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    table = sources.select("*", place.alias("place"), weight.alias("weight"), (F.col("source_size") * most).alias("cap"), (F.sum("source_size").over(everything) * share).alias("total"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    spent = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumns({"level": (F.col("total") - spent) / left, "nth": F.row_number().over(order)})
    below = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min_by("level", F.when(below, F.col("nth"))).over(everything)
    return table.select("source", "place", "source_size", "docs", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight"))).alias("target"))


def _rate(tilt, size, mean, most: float):
    return F.least(F.exp(tilt * size / mean), F.lit(float(most)))


def tilts(kinds: DataFrame, goals: DataFrame, most: float = 2.0) -> DataFrame:
    """Add ``tilt``, the dual variable of each source, to goals (place, source_size, docs, target), from kinds (place, size, n).

    Newton's method from 0; where a step leaves the bracket it is halved instead. Between the two ends of the bracket the
    tokens taken go from at most the target to all that the limit allows. Sources without words have none.
    """
    mean = F.col("source_size") / F.col("docs")
    state = goals.filter("source_size > 0").select("place", "target", mean.alias("mean"), (F.col("target") / F.col("source_size")).alias("ratio"))
    high = F.col("mean") * math.log(most)
    state = state.withColumns({"low": F.col("mean") * F.log(F.least("ratio", F.lit(1.0))), "high": high, "done": F.col("ratio") >= most * (1 - CLOSE)})
    state = materialise(state.withColumn("tilt", F.when(F.col("done"), F.col("high")).otherwise(F.lit(0.0))), "tilts")
    for _ in range(NEWTON_STEPS):
        open_ = state.filter("not done")
        if open_.isEmpty():
            break
        tilted = F.exp(F.col("tilt") * F.col("size") / F.col("mean"))
        words = F.col("n") * F.col("size")
        slope = F.when(tilted < most, words * F.col("size") / F.col("mean") * tilted).otherwise(F.lit(0.0))
        joined = kinds.join(hinted(open_.select("place", "tilt", "mean")), "place")
        sums = joined.groupBy("place").agg(F.sum((words * F.least(tilted, F.lit(float(most)))).cast(SUM)).cast("double").alias("taken"), F.sum(slope.cast(SUM)).cast("double").alias("slope"))
        off = F.col("taken") - F.col("target")
        now = state.join(sums, "place", "left")
        now = now.withColumns({"high": F.when(off > 0, F.col("tilt")).otherwise(F.col("high")), "low": F.when(off <= 0, F.col("tilt")).otherwise(F.col("low")), "done": F.col("done") | (F.abs(off) <= CLOSE * F.col("target"))})
        newton = F.col("tilt") - off / F.nullif("slope", F.lit(0.0))
        step = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise((F.col("low") + F.col("high")) / 2)
        # Brackets close in on a source that no rate meets more nearly, as at the last digits of a sum.
        tight = F.col("high") - F.col("low") <= 1e-12 * F.abs(F.col("high"))
        now = now.withColumns({"tilt": F.when(F.col("done"), F.col("tilt")).otherwise(step), "done": F.col("done") | tight})
        state = materialise(now.select(*state.columns), "tilts")
    return goals.join(state.select("place", "tilt", "mean"), "place", "left")


def _more(rows):
    """For an array of (size, doc_id, n, rate), largest first: how many of the n take one copy more than the rate's whole part, so that the running error stays smallest."""

    def take(state, row):
        part = row["rate"] - F.floor(row["rate"])
        want = row["n"] * part - state["error"] / F.greatest(row["size"], F.lit(1))
        more = F.when(part > 0, F.least(F.greatest(F.ceil(want - 0.5), F.lit(0)), row["n"])).otherwise(F.lit(0)).cast("bigint")
        return F.struct((state["error"] + row["size"] * (more - row["n"] * part)).alias("error"), F.concat(state["more"], F.array(more)).alias("more"))

    start = F.struct(F.lit(0.0).alias("error"), F.expr("cast(array() as array<bigint>)").alias("more"))
    return F.aggregate(rows, start, take, lambda s: s["more"])


def mix(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Return doc_id, size, source_size, target, taken, source, rate and copies of each row of df."""
    sized = materialise(sizes(df, id_col, source_col, text_col), "sizes")
    goals = materialise(targets(sized, weights, share, most).withColumnRenamed("source", "of"), "targets")
    numbered = hinted(goals.select("of", "place", "docs"))
    each = sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")).join(numbered, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    each = materialise(each, "kinds")
    lengths = materialise(each.filter("size > 0").groupBy("place", "size").agg(F.sum("n").alias("n")), "lengths")
    tilted = hinted(materialise(tilts(lengths, goals, most).select("place", "source_size", "target", "tilt", "mean"), "tilts"))
    # Digits beyond the sixth are cut, so that reruns agree.
    rate = F.when(F.col("size") > 0, F.round(_rate(F.col("tilt"), F.col("size"), F.col("mean"), most), 6)).otherwise(F.lit(1.0))
    bucket = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("docs") / BUCKET))
    keys = ["source", "place", "bucket"]
    rated = each.join(tilted.select("place", "tilt", "mean"), "place").select("source", "place", bucket.alias("bucket"), F.struct("size", "doc_id", "n", rate.alias("rate")).alias("row"))
    grouped = rated.groupBy(*keys).agg(F.sort_array(F.collect_list("row"), asc=False).alias("rows"))
    taken = grouped.select(*keys, F.explode(F.arrays_zip("rows", _more(F.col("rows")).alias("more"))).alias("x")).select(*keys, "x.rows.*", F.col("x.more").alias("more"))
    single = taken.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("nth"))
    copies = (F.floor("rate") + (F.col("nth") <= F.col("more")).cast("int")).cast("int")
    out = single.withColumn("copies", copies).join(tilted.select("place", "source_size", "target"), "place")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies")


def apply(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows of df, each as often as the mix has it. Rows of one id, source and size share the largest number of copies among them."""
    copies = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size")).agg(F.max("copies").alias("__copies"))
    copies = hinted(materialise(copies.filter("__copies > 0"), "copies"))
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (size == F.col("__size"))
    joined = df.join(copies, same)
    return joined.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in df.columns])
