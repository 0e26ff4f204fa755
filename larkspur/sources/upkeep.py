"""Stored sums and counts by key that follow changes of single rows.

The table is cut into parts by the hash of its keys. A change reads and writes the parts that its rows touch, as new
folders; a numbered list of the folders in use is then renamed into place, so readers see all of a change or nothing,
and a writer whose number another one took starts over on the newer parts. Totals are decimals: taking a value out leaves
nothing behind. Each key has n (rows), and for each value its number of known values and total.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOTAL = "decimal(38,6)"


class Upkeep:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], values: list[str], parts: int = 64):
        self.spark, self.root, self.keys, self.values, self.parts = spark, root.rstrip("/"), keys, values, parts
        self.sums = ["n", *[f"{kind}_{v}" for v in values for kind in ("known", "total")]]
        self._java = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 before the first change."""
        folder = self._java.Path(f"{self.root}/versions")
        fs = self._fs(folder)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max([int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")], default=0)

    def folders(self, version: int) -> dict[str, str]:
        """The folder of each part that has rows."""
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version:08d}.json", wholetext=True).first()[0])

    def _commit(self, version: int, folders: dict[str, str]) -> bool:
        draft, final = (self._java.Path(f"{self.root}/versions/{name}") for name in (f".{uuid.uuid4().hex}", f"{version:08d}.json"))
        out = self._fs(draft).create(draft, True)
        out.write(bytearray(json.dumps(folders), "utf-8"))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._java.Options.Rename, 1)
        options[0] = getattr(self._java.Options.Rename, "NONE")
        try:
            self._java.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            self._fs(draft).delete(draft, False)
            return False
        return True

    def _signed(self, rows: DataFrame, sign: int) -> DataFrame:
        known = lambda v: F.col(v).isNotNull().cast("bigint")
        sums: list[Column] = [F.lit(sign).cast("bigint").alias("n")]
        for v in self.values:
            sums += [(sign * known(v)).alias(f"known_{v}"), F.coalesce(F.col(v).cast("decimal(28,6)") * sign, F.lit(0)).cast("decimal(28,6)").alias(f"total_{v}")]
        return rows.select(*self.keys, *sums)

    def _summed(self, rows: DataFrame) -> DataFrame:
        cast = lambda c: TOTAL if c.startswith("total_") else "bigint"
        return rows.groupBy(*self.keys).agg(*[F.sum(c).cast(cast(c)).alias(c) for c in self.sums])

    def _stored(self, folders: list[str], like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*folders)

    def change(self, new: DataFrame | None = None, old: DataFrame | None = None) -> int:
        """Take rows of ``old`` out and put rows of ``new`` in. Returns the version; changes that cancel out make none.

        The differences are summed once and stored; only they are merged again when another writer comes first.
        """
        signed = [self._signed(rows, sign) for rows, sign in ((new, 1), (old, -1)) if rows is not None]
        if not signed:
            return self.version()
        summed = self._summed(signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1]))
        moved = summed.filter(" or ".join(f"{c} <> 0" for c in self.sums)).withColumn("_part", F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))
        place = f"{self.root}/changes/{uuid.uuid4().hex}"
        moved.write.partitionBy("_part").parquet(place)
        moved = self.spark.read.schema(moved.schema).parquet(place)
        touched = sorted(r[0] for r in moved.select("_part").distinct().collect())  # at most self.parts rows
        while touched:
            now = self.version()
            folders = self.folders(now)
            held = [folders[str(p)] for p in touched if str(p) in folders]
            difference = moved.select(*self.keys, *self.sums)
            both = difference.unionByName(self._stored(held, difference)) if held else difference
            merged = self._summed(both).filter(" or ".join(f"{c} <> 0" for c in self.sums))
            made = f"{self.root}/data/{uuid.uuid4().hex}"
            merged.withColumn("_part", F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")).write.partitionBy("_part").parquet(made)
            there = self._fs(self._java.Path(made)).globStatus(self._java.Path(f"{made}/_part=*"))
            kept = {s.getPath().getName().split("=")[1]: s.getPath().toString() for s in there}
            rest = {p: f for p, f in folders.items() if int(p) not in touched}
            if self._commit(now + 1, rest | kept):
                break
            self._fs(self._java.Path(made)).delete(self._java.Path(made), True)
        self._fs(self._java.Path(place)).delete(self._java.Path(place), True)
        return self.version()

    def read(self, like: DataFrame, version: int | None = None) -> DataFrame:
        """Keys with their sums and the mean of each value; ``like`` gives the types of the keys."""
        shape = self._summed(self._signed(like.limit(0), 1))
        folders = list(self.folders(version or self.version()).values())
        stored = self._stored(folders, shape) if folders else shape
        mean = lambda v: F.try_divide(F.col(f"total_{v}").cast("double"), F.col(f"known_{v}")).alias(f"mean_{v}")
        return stored.select(*self.keys, *self.sums, *[mean(v) for v in self.values])

    def vacuum(self, keep: int = 1) -> None:
        """Delete folders of parts that none of the last ``keep`` versions names but older ones do."""
        newest = self.version()
        named = {v: set(self.folders(v).values()) for v in range(1, newest + 1)}
        live = set().union(*[named[v] for v in named if v > newest - keep]) if named else set()
        for folder in set().union(*named.values()) - live if named else set():
            path = self._java.Path(folder)
            self._fs(path).delete(path, True)
