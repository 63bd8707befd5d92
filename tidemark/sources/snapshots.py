"""Epochs of a table set: versions are written first and become visible by one manifest.

A version is a folder of Parquet; a commit writes ``manifest/<version>.json`` through Spark's committer,
last of all, and readers take the highest manifest. A folder without manifest, left by a crash, is never
read; what it held is rebuilt by replaying the journal. Works on any file system that Spark can write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Mismatch(RuntimeError):
    """Another writer has published since the base version was read: read again and retry."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str, schema_version: int = 1) -> None:
        self.spark, self.folder, self.schema_version = spark, folder.rstrip("/"), schema_version

    def _manifests(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        schema = "version long, schema_version int, tables array<string>, cp_lsn long"
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").json(f"{self.folder}/manifest")

    def version(self) -> int:
        """The last published version; 0 before the first."""
        found = self._manifests()
        return (found.agg(F.max("version")).first()[0] or 0) if found is not None else 0

    def commit(self, tables: dict[str, DataFrame], cp_lsn: int, base: int | None = None, sealer: str | None = None) -> int:
        """Write the tables as the next version and publish them at once. The sealer's table is written last."""
        if base is not None and self.version() != base:
            raise Mismatch(f"{self.version()} is published, {base} was read")
        version = self.version() + 1
        for name in sorted(tables, key=lambda n: (n == sealer, n)):
            tables[name].write.mode("overwrite").parquet(f"{self.folder}/v{version}/{name}")
        row = self.spark.createDataFrame([(version, self.schema_version, sorted(tables), cp_lsn)], "version long, schema_version int, tables array<string>, cp_lsn long")
        row.coalesce(1).write.mode("errorifexists").json(f"{self.folder}/manifest/{version}")
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        row = self._manifests().where(F.col("version") == (version or self.version())).first()
        if row is None or name not in row["tables"]:
            raise KeyError(name)
        if row["schema_version"] != self.schema_version:
            raise ValueError(f"schema version {row['schema_version']}, not {self.schema_version}")
        return self.spark.read.parquet(f"{self.folder}/v{row['version']}/{name}")

    def destroy(self, name: str) -> dict[str, int]:
        """Drop a table's folders in all versions; the numbers of entries in the last version and of nodes (files) that are freed."""
        rows = self.read(name)
        n = rows.count()
        files, fs = set(), None
        for r in self._manifests().where(F.array_contains("tables", name)).select("version").collect():  # a row for each version
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{r['version']}/{name}")
            fs = fs or path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if fs.exists(path):
                files |= {str(f.getPath()) for f in fs.listStatus(path) if f.getPath().getName().endswith(".parquet")}
                fs.delete(path, True)
        return {"n_entries": n, "n_nodes": len(files)}

    def checkpoint_lsn(self) -> int:
        found = self._manifests()
        return found.orderBy(F.col("version").desc()).first()["cp_lsn"] if found is not None else -1

    def recovered(self, name: str, journal: DataFrame) -> DataFrame:
        """The table with the journal (lsn, k, v; a null v removes) after its checkpoint replayed over it."""
        late = journal.where(F.col("lsn") > self.checkpoint_lsn()).groupBy("k").agg(F.max_by("v", "lsn").alias("v"))
        return self.read(name).select("k", "v").join(late, "k", "left_anti").unionByName(late.where("v is not null"))
