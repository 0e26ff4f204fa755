"""Sharded storage with size-tiered compaction.

A store holds runs: folders of immutable Parquet shards. An arrival is appended
as a run of small shards in tier 0. Where a tier has ``fan_in`` runs of similar
size, they are merged into one run of the next tier, in files near the target
size. Which runs a reader sees is stated by a manifest alone; manifests are
numbered, and a new one is moved into place in one step that fails if the number
is taken, so readers see either all of a change or nothing. A writer that was
overtaken reads the newest manifest and puts its change on top of that; a merge
whose runs are gone by then is dropped and planned anew. The file system must
rename in one step and refuse to overwrite, as HDFS and POSIX ones do; object
stores need a conditional put instead. Merging reads and writes without a shuffle.

The schema of a store is the union of all that was appended: columns that a batch, or
an older run, does not have are null in its rows, however often runs are merged. A
column whose type is not the stored one's is refused before anything is written, also
where it differs within a struct, array or map; so are names that agree but for case.

Only DataFrame operations touch rows. Rows without an arrival, as with null ids, fall
in arrival 0; null, empty and very long texts, ties, repeated rows and any other
columns are stored as they are; arrivals without rows add no run, and an empty store
reads as an empty table. __run, __arrival and __tier are the store's own columns:
given ones of these names are kept under the name with ``_given`` behind it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from larkspur.llm.common import remove_path

TARGET_BYTES = 64 << 20
FAN_IN = 4
#: Columns that a store adds.
OWN = ["__run", "__arrival", "__tier"]


@dataclass
class Run:
    name: str
    tier: int
    path: str
    bytes: int
    files: int


@dataclass
class Manifest:
    version: int = 0
    schema: str = ""
    made: dict[str, int] = field(default_factory=dict)  # runs ever made, by tier
    runs: list[Run] = field(default_factory=list)


def united(old: StructType, new: StructType) -> StructType:
    """All columns of both, those of old first, all nullable. Raises ValueError where a column has two types or names differ by case alone."""
    out = {f.name: StructField(f.name, f.dataType, True) for f in old}
    lower = {name.lower(): name for name in out}
    for f in new:
        known = lower.setdefault(f.name.lower(), f.name)
        if known != f.name:
            raise ValueError(f"column {f.name} is stored as {known}")
        if f.name not in out:
            out[f.name] = StructField(f.name, f.dataType, True)
        elif out[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is stored as {out[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return StructType(list(out.values()))


def schema_of(manifest: Manifest) -> StructType:
    return StructType.fromJson(json.loads(manifest.schema)) if manifest.schema else StructType()


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.conf)

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or the one of a version."""
        found = self.versions()
        if not found:
            return Manifest()
        text = self.spark.read.text(f"{self.root}/manifests/v{version or found[-1]:08d}.json", wholetext=True).first()[0]
        raw = json.loads(text)
        return Manifest(raw["version"], raw["schema"], raw["made"], [Run(**r) for r in raw["runs"]])

    def commit(self, new: Manifest) -> bool:
        """Put a manifest in place; False if its version exists."""
        draft, final = self._path("manifests", f".{uuid.uuid4().hex}"), self._path("manifests", f"v{new.version:08d}.json")
        out = self._fs().create(draft, True)
        out.write(bytearray(json.dumps({"version": new.version, "schema": new.schema, "made": new.made, "runs": [vars(r) for r in new.runs]}), "utf-8"))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf).rename(draft, final, options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            self._fs().delete(draft, False)
            return False
        return True

    def change(self, onto: Callable[[Manifest], Manifest | None]) -> bool:
        """Put a change on the newest manifest, again for as long as other writers come first. False if it says that it no longer fits."""
        while (new := onto(self.manifest())) is not None:
            if self.commit(new):
                return True
        return False

    def _measure(self, folder: str) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
        return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "length")

    def append(self, df: DataFrame, arrival=None) -> int:
        """Write rows as tier 0 runs, one for each value of the column expression ``arrival`` (all in one without it), in its order; compact after each. Returns the version."""
        incoming = f"{self.root}/data/{uuid.uuid4().hex}"
        order = F.lit(0) if arrival is None else F.coalesce(arrival.cast("int"), F.lit(0))
        df = df.withColumn("__order", order)
        for own in OWN:
            if own in df.columns:
                df = df.withColumnRenamed(own, f"{own}_given")
        df = df.withColumnRenamed("__order", "__arrival")
        united(schema_of(self.manifest()), df.schema)  # refuses clashes before the write
        df.withColumn("__run", F.col("__arrival")).write.option("compression", "zstd").partitionBy("__run").parquet(incoming)
        if not self._fs().exists(self._path("data", incoming.rpartition("/")[2])) or not list(self._fs().globStatus(self.jvm.org.apache.hadoop.fs.Path(incoming + "/__run=*"))):
            return self.manifest().version
        sizes = self._measure(incoming).groupBy("folder").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files")).collect()  # one row for each arrival
        for row in sorted(sizes, key=lambda r: int(r.folder.rpartition("=")[2])):

            def added(old: Manifest, row=row) -> Manifest:
                nth = old.made.get("0", 0)
                return Manifest(old.version + 1, united(schema_of(old), df.schema).json(), old.made | {"0": nth + 1}, [*old.runs, Run(f"L0-{nth}", 0, row.folder, row.bytes, row.files)])

            self.change(added)
            self.compact()
        return self.manifest().version

    @staticmethod
    def due(runs: list[Run], fan_in: int = FAN_IN) -> list[Run]:
        """The first group, by tier and then size, of at least fan_in runs of which none is over twice another's size."""
        for tier in sorted({r.tier for r in runs}):
            group: list[Run] = []
            for r in sorted((r for r in runs if r.tier == tier), key=lambda r: r.bytes):
                if group and r.bytes > 2 * group[0].bytes:
                    if len(group) >= fan_in:
                        return group
                    group = []
                group.append(r)
            if len(group) >= fan_in:
                return group
        return []

    def compact(self) -> None:
        """Merge until no tier has fan_in runs of similar size."""
        while group := self.due((old := self.manifest()).runs):
            tier, total, gone = group[0].tier + 1, sum(r.bytes for r in group), {g.name for g in group}
            path = f"{self.root}/data/{uuid.uuid4().hex}"
            merged = self.spark.read.schema(schema_of(old)).parquet(*[r.path for r in group])
            merged.coalesce(max(1, round(total / TARGET_BYTES))).write.option("compression", "zstd").parquet(path)
            size = self._measure(path).agg(F.sum("length"), F.count(F.lit(1))).first()

            def merged_in(old: Manifest) -> Manifest | None:
                if not gone <= {r.name for r in old.runs}:
                    return None
                nth = old.made.get(str(tier), 0)
                rest = [r for r in old.runs if r.name not in gone]
                return Manifest(old.version + 1, old.schema, old.made | {str(tier): nth + 1}, [*rest, Run(f"L{tier}-{nth}", tier, path, size[0], size[1])])

            if not self.change(merged_in):
                remove_path(self.spark, path)

    def vacuum(self, keep: int = 1, lost_after_hours: float = 24) -> None:
        """Delete runs that none of the last ``keep`` manifests names, and folders so many hours old that hold none of those, as writers that died leave behind."""
        named = [{r.path for r in self.manifest(v).runs} for v in self.versions()]
        for path in set().union(*named) - set().union(*named[-keep:]):
            remove_path(self.spark, path)
        known = {p.rpartition("/data/")[2].split("/")[0] for p in set().union(*named[-keep:])}
        folder = self._path("data")
        for status in self._fs().listStatus(folder) if self._fs().exists(folder) else []:
            if status.getPath().getName() not in known and status.getModificationTime() < (time.time() - 3600 * lost_after_hours) * 1000:
                remove_path(self.spark, status.getPath().toString())

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version with __arrival, and __run and __tier, which name the run that holds them."""
        now = self.manifest(version)
        if not now.runs:
            return self.spark.createDataFrame([], "__arrival int, __run string, __tier int")
        schema = schema_of(now)
        parts = [self.spark.read.schema(schema).parquet(r.path).withColumns({"__run": F.lit(r.name), "__tier": F.lit(r.tier)}) for r in now.runs]
        return reduce(DataFrame.unionByName, parts)
