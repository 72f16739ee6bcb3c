"""Several tables in one store: versions that a single rename puts in place, snapshots, and pages that open few files.

A version is a manifest in the log that names a folder for each table. Folders are written first, under names of their own; the
manifest is then renamed to its number, which fails if another commit has taken it. Readers resolve a manifest and see whole
versions of all tables or none of it. A commit that fails or is cancelled leaves folders that no manifest names; `vacuum` deletes
them.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another commit took the version."""


@dataclass(frozen=True)
class Snapshot:
    """The tables of one version; version 0 has none."""

    spark: SparkSession
    version: int
    tables: dict[str, dict] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.tables[name]["path"])

    def page(self, name: str, limit: int, cursor: tuple | None = None) -> DataFrame:
        """The `limit` rows of highest key below the cursor, highest first, of a table that was committed with a key.

        Files are disjoint in their keys, so only the file that the cursor falls in and as many below it as fill the page are
        opened.
        """
        key = self.tables[name]["key"]
        columns = [F.col(c) for c in key]
        low = [F.col(f"low.{c}") for c in key]
        zones = self.spark.read.parquet(self.tables[name]["zones"])
        if cursor is not None:
            zones = zones.filter(_below(low, cursor))
        wanted, rows = [], 0
        inside = None if cursor is None else _below([F.col(f"high.{c}") for c in key], cursor)
        for z in zones.withColumn("whole", F.lit(True) if inside is None else inside).orderBy(F.col("high").desc()).limit(limit + 1).toLocalIterator():
            if rows >= limit:
                break
            wanted.append(z["file"])
            rows += z["rows"] if z["whole"] else 0  # the cursor's own file may have any number below it
        if not wanted:
            return self.table(name).limit(0)
        found = self.spark.read.schema(self.table(name).schema).parquet(*wanted)
        if cursor is not None:
            found = found.filter(_below(columns, cursor))
        return found.orderBy(*[c.desc() for c in columns]).limit(limit)


def _below(columns: list, cursor: tuple):
    """Whether the columns are below the cursor, the first that differs deciding."""
    out, equal = F.lit(False), F.lit(True)
    for c, at in zip(columns, cursor):
        out, equal = out | (equal & (c < F.lit(at))), equal & (c == F.lit(at))
    return out


class Store:
    """Tables under a root folder that any file system of Spark can hold."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path("/log"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.root + name)

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("/log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The given version, or the newest."""
        known = self.versions()
        at = (known[-1] if known else 0) if version is None else version
        if at == 0:
            return Snapshot(self.spark, 0)
        stream = self._fs.open(self._path(f"/log/{at:012d}.json"))
        try:
            manifest = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Snapshot(self.spark, at, manifest["tables"], manifest["notes"])

    def _write(self, df: DataFrame, name: str, key: list[str] | None) -> dict:
        path = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        if not key:
            df.write.parquet(path)
            return {"path": path}
        df.repartitionByRange(*key).sortWithinPartitions(*key).write.parquet(path)
        rows = self.spark.read.schema(df.schema).parquet(path).select("_metadata.file_path", *key)
        entry = F.struct(*key)
        zones = rows.groupBy(F.col("file_path").alias("file")).agg(F.min(entry).alias("low"), F.max(entry).alias("high"), F.count("*").alias("rows"))
        zones.coalesce(1).write.parquet(path + "-zones")  # a row a file
        return {"path": path, "key": key, "zones": path + "-zones"}

    def commit(self, tables: dict[str, DataFrame], base: Snapshot | None = None, keys: dict[str, list[str]] | None = None, notes: dict[str, str] | None = None) -> int:
        """Replace the given tables in one version and keep the others of `base` (the newest by default); the new version.

        Raises Conflict if a version after `base` exists by then. A table keeps the key that it was committed with.
        """
        base = self.snapshot() if base is None else base
        made = {n: self._write(df, n, (keys or {}).get(n) or base.tables.get(n, {}).get("key")) for n, df in tables.items()}
        manifest = {"tables": base.tables | made, "notes": base.notes | (notes or {})}
        draft, final = self._path(f"/log/draft-{uuid.uuid4().hex}"), self._path(f"/log/{base.version + 1:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # without the overwrite option the rename fails where the name is taken
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, final, none)
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {base.version + 1} is taken") from error
            raise
        return base.version + 1

    def vacuum(self, keep: int = 2, least_age_s: float = 3600.0) -> int:
        """Delete the manifests before the newest `keep` and the folders that no other names, unless they are young; how many folders."""
        known, gone = self.versions(), 0
        named = {t[k].rpartition("/")[2] for v in known[-keep:] for t in self.snapshot(v).tables.values() for k in ("path", "zones") if k in t}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"/log/{v:012d}.json"), False)
        if self._fs.exists(self._path("/data")):
            for s in self._fs.listStatus(self._path("/data")):
                if s.getPath().getName() not in named and time.time() - s.getModificationTime() / 1000 >= least_age_s:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone
