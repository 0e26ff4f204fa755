"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

1. Every document gets its set of distinct k-word shingles, two 64-bit digests of
   the whole set, and the band keys of its SuperMinHash signature. Documents with
   the same set become one node, the least id among them.
2. A band key names a bucket. Each node is tied to the least node of each of its
   buckets, never to all others; the components of these ties are groups, which
   hold every pair that shares a bucket.
3. Within a group all links are found on full sets. A group that fits a task is
   compared there by an inverted index with union-find. A larger one is first
   linked through the ties that verify (long keys, of two bands, make most of
   them hold). Where more nodes than a block then lie outside its largest
   component, as with texts that share much boilerplate, it is cut into finer
   groups by rare shingles, which lose no link. What is still large is compared
   block by block: nodes outside the largest component with all others. Pairs are
   counted in arrays and never become rows; only links do.

Every link between different texts that shares a bucket is found or is implied by
others of its component. Bands of 5 slots are as many as make a pair at the
threshold share none with probability 1e-5 at most: 20 for 0.85, 29 for 0.8.

Letters A-Z are lowered. Null and empty texts, and texts without words, have no
shingles and are linked with nothing; very long texts are read whole. Rows that
share an id stand for one document: what is near one of them is linked to all; each
is labelled by its own text. Of ties, as among equal texts, the least id stays. Rows with a null id take no part: their component is null
and they are kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import minhash
from larkspur.llm.common import hinted, materialise
from larkspur.llm.components import components

#: Slots of a band, and the probability with which a pair at the threshold may share none.
ROWS, MISSED = 5, 1e-5
#: Nodes and shingles of a block; what a comparing task holds is two blocks.
BLOCK_NODES, BLOCK_SHINGLES = 512, 2_000_000
#: Columns of the sets that are compared: group, node, set, and component by the links known so far; and of the links found.
SETS = ["super", "node", "shingles", "comp"]
LINKS = "u bigint, v bigint"


def _find(parent: dict, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def compare(ids: np.ndarray, sets: list[np.ndarray], asking: np.ndarray, percent: int, component: np.ndarray) -> list[tuple[int, int]]:
    """Links between nodes of different components, of which at least one asks: enough of them to join what is linked."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
    parent = {int(c): int(c) for c in component}
    links = []
    for i in np.flatnonzero(asking):
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        count = high - low
        ends = np.cumsum(count)
        at = np.repeat(low - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        shared = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(100 * shared >= percent * (sizes + sizes[i] - shared)):
            a, b = _find(parent, int(component[i])), _find(parent, int(component[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(ids[i]), int(ids[j])))
    return links


def _compare_frame(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    links = []
    for _, part in frame.groupby("super", sort=False):
        # a node may come as one that asks and as one that is asked; rows of one id with unlike sets stay apart
        part = part.assign(mark=[zlib.crc32(s) for s in part["shingles"]]).sort_values("asks").drop_duplicates(["node", "mark"], keep="last")
        links += compare(part["node"].to_numpy(), [np.asarray(s) for s in part["shingles"]], part["asks"].to_numpy(), percent, part["comp"].to_numpy())
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def bands_for(percent: int) -> int:
    """Bands that a pair of this similarity misses all of with probability MISSED at most."""
    return 1 if percent >= 100 else math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** ROWS))


def _inside(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links within groups (super) of more than one component that fit a task, many groups a task; and the groups that do not fit. sets: super, node, shingles, comp."""
    extent = sets.groupBy("super").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("total"), (F.min("comp") < F.max("comp")).alias("mixed"))
    fits = (F.col("n") <= BLOCK_NODES) & (F.col("total") <= BLOCK_SHINGLES)
    extent = materialise(extent.filter("mixed").select("super", "total", fits.alias("fits")), "extent")
    load = extent.filter("fits").agg(F.sum("total")).first()[0] or 0
    batch = F.pmod(F.xxhash64("super"), F.lit(max(1, math.ceil(load / BLOCK_SHINGLES))))
    work = sets.join(extent.filter("fits").select("super"), "super").select(batch.alias("batch"), *SETS, F.lit(True).alias("asks"))
    links = work.groupBy("batch").applyInPandas(lambda _, frame: _compare_frame(frame, percent), LINKS)
    return materialise(links, "links"), extent.filter("not fits").select("super")


def _shape(sets: DataFrame) -> DataFrame:
    """For each group of more than one component: its largest component (main), and into how many blocks all nodes and those outside it go."""
    sizes = sets.groupBy("super", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum(F.size("shingles")).alias("t"))
    shape = sizes.groupBy("super").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("n"), F.sum("t").alias("total"), F.max("c").alias("in_main"))
    blocks = lambda n, t: F.greatest(F.lit(1), F.ceil(n / BLOCK_NODES), F.ceil(t / BLOCK_SHINGLES))
    outside = F.col("n") - F.col("in_main")
    shape = shape.withColumns({"member_blocks": blocks(F.col("n"), F.col("total")), "asking_blocks": blocks(outside, F.col("total") * outside / F.col("n"))})
    return materialise(shape.filter("in_main < n").select("super", "main", "member_blocks", "asking_blocks"), "shape")


def _regroup(sets: DataFrame, percent: int) -> DataFrame:
    """The same sets in finer groups, which still hold every pair at the threshold.

    Shingles of a group are ordered by how many of its sets have them. Two sets at
    the threshold share one of the first n - ceil(n * percent / 100) + 1 of each, so
    components tied through these hold all links, while what very many sets share
    comes last in all of them and ties none.
    """
    each = sets.select("super", "node", "comp", F.xxhash64("shingles").alias("mark"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("super", "shingle").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    counted = each.join(often, ["super", "shingle"], "left").withColumn("c", F.coalesce("c", F.lit(1).cast("bigint")))
    ordered = counted.groupBy("super", "comp", "node", "mark").agg(F.array_sort(F.collect_list(F.struct("c", "shingle"))).alias("order"))
    first = (F.size("order") - F.ceil(F.size("order") * percent / 100) + 1).cast("int")
    rare = ordered.select("super", "comp", F.explode(F.slice("order", 1, first)).alias("x")).filter("x.c > 1").select("super", "comp", F.col("x.shingle").alias("shingle"))
    rare = materialise(rare.distinct(), "rare")
    hubs = rare.groupBy("super", "shingle").agg(F.min("comp").alias("hub"), F.max("comp").alias("most")).filter("hub < most").drop("most")
    tied = components(rare.join(hubs, ["super", "shingle"]).filter("comp > hub").select("comp", "hub").distinct())
    finer = sets.drop("super").join(tied.select(F.col("node").alias("comp"), F.col("root").alias("finer")), "comp", "left")
    return materialise(finer.withColumn("super", F.coalesce("finer", "comp")).select(*SETS), "finer")


def _by_blocks(sets: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """Links of groups of any size: nodes outside the largest component against all nodes, block by block."""
    placed = sets.join(shape, "super")
    spread = lambda blocks: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1))
    asking = placed.filter("comp != main").withColumns({"asks": F.lit(True), "ask": F.pmod(F.xxhash64("node"), "asking_blocks")}).withColumn("among", spread("member_blocks"))
    among = placed.withColumns({"asks": F.lit(False), "among": F.pmod(F.xxhash64("node"), "member_blocks")}).withColumn("ask", spread("asking_blocks"))
    columns = ["ask", "among", *SETS, "asks"]
    work = asking.select(*columns).unionByName(among.select(*columns))
    return materialise(work.groupBy("super", "ask", "among").applyInPandas(lambda _, frame: _compare_frame(frame, percent), LINKS), "links")


def near_duplicates(df: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_shingles, component_id, kept and version (a hash of the text, which tells rows of one id apart) for each row. Linked are documents with 100 * |A and B| >= percent * |A or B|."""
    spark = df.sparkSession
    bands = bands_for(percent)
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = docs.withColumn("version", F.xxhash64("text")).mapInArrow(
        lambda b: minhash.sketch_batches(b, words, bands * ROWS, ROWS), "doc_id bigint, version bigint, n_shingles bigint, digest1 bigint, digest2 bigint, bands array<bigint>"
    )
    sketch = materialise(sketched, "sketch")
    digest = ["digest1", "digest2", "n_shingles"]
    nodes = materialise(
        sketch.filter("n_shingles > 0 and doc_id is not null").groupBy(*digest).agg(F.min(F.struct("doc_id", "bands")).alias("x")).select(*digest, F.col("x.doc_id").alias("node"), "x.bands"),
        "nodes",
    )
    # A set below this size is within the threshold of equal sets only.
    least = math.ceil(percent / (100 - percent)) if percent < 100 else 1 << 40
    wide = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.get("bands", i), F.get("bands", (i + 1) % bands)))
    keyed = nodes.filter(F.col("n_shingles") >= least).select("node", F.explode(F.concat("bands", wide)).alias("key"))
    buckets = materialise(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).filter("pivot < most").select("key", "pivot"), "buckets")
    ties = materialise(keyed.join(hinted(buckets), "key").filter("node > pivot").select("node", "pivot").distinct(), "ties")

    roots = components(ties)
    members = roots.select(F.col("node"), F.col("root").alias("super")).unionAll(roots.select(F.col("root").alias("node"), F.col("root").alias("super")).distinct())
    members = materialise(members, "members")
    wanted = hinted(members.select(F.col("node").alias("__node")))
    sets = docs.join(wanted, F.col("doc_id") == F.col("__node"), "left_semi").mapInArrow(lambda b: minhash.set_batches(b, words), "doc_id bigint, shingles array<bigint>")
    sets = materialise(sets.withColumnRenamed("doc_id", "node").join(members, "node"), "sets")

    links, large = _inside(sets.withColumn("comp", F.col("node")), percent)
    if not large.isEmpty():
        big = materialise(sets.join(hinted(large), "super"), "large-sets")
        left, right = big.select("node", F.col("shingles").alias("a")), big.select(F.col("node").alias("pivot"), F.col("shingles").alias("b"))
        tied = ties.join(left, "node").join(right, "pivot").withColumn("shared", F.size(F.array_intersect("a", "b")))
        holds = tied.filter(100 * F.col("shared") >= percent * (F.size("a") + F.size("b") - F.col("shared"))).select(F.col("node").alias("u"), F.col("pivot").alias("v"))
        holds = materialise(holds, "ties-held")
        linked = components(holds).withColumnRenamed("root", "comp")
        labelled = materialise(big.join(linked, "node", "left").select("super", "node", "shingles", F.coalesce("comp", "node").alias("comp")), "labelled")
        links, shape = links.unionByName(holds), _shape(labelled)
        crowded = materialise(shape.filter("asking_blocks > 1").select("super"), "crowded")
        if not crowded.isEmpty():
            finer = _regroup(labelled.join(hinted(crowded), "super"), percent)
            found, still = _inside(finer, percent)
            links = links.unionByName(found)
            labelled = labelled.join(hinted(crowded), "super", "left_anti").unionByName(finer.join(hinted(still), "super"))
            shape = _shape(labelled)
        links = links.unionByName(_by_blocks(labelled, shape, percent))

    labels = components(links)
    by_set = nodes.select(*digest, F.col("node").alias("__node")).join(labels, F.col("__node") == F.col("node"), "left").select(*digest, F.coalesce("root", "__node").alias("label"))
    result = sketch.select("doc_id", "version", *digest).join(by_set, digest, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "version")
