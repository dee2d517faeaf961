"""The latest row of each key as a table that streams write to: in buckets, and a batch rewrites only the buckets that it touches.

A batch leaves its buckets in a folder of its own and then, as its last step, a manifest: for each bucket the batch whose files are in
force. Readers follow the last manifest, so they see a batch whole or not at all. A batch that runs again begins from the manifest
before it and overwrites its own files, so it leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.sources.tables import exists, folders, removed


class LatestStore:
    """keys: the columns of a key. version: the column (a time, or a struct of a time and a number) of which the strictly greater one
    wins; of equal ones the row that was there first stays, and within a batch the greatest row. Rows with a null version are no
    state and are left out."""

    def __init__(self, path: str, keys: list[str], version: str, buckets: int = 64):
        self.path, self.keys, self.version, self.buckets = path, keys, version, buckets

    def _manifest(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """Bucket -> batch in force: a row for each bucket, so it is small."""
        if not exists(spark, f"{self.path}/manifest"):
            return {}
        numbers = [int(f.split("=")[1]) for f in folders(spark, f"{self.path}/manifest") if f.startswith("batch=") and exists(spark, f"{self.path}/manifest/{f}/_SUCCESS")]
        numbers = [n for n in numbers if before is None or n < before]
        return {r.bucket: r.written for r in spark.read.parquet(f"{self.path}/manifest/batch={max(numbers)}").collect()} if numbers else {}

    def _rows(self, spark: SparkSession, manifest: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/batch={batch}/bucket={bucket}" for bucket, batch in manifest.items()]
        return spark.read.parquet(*paths) if paths else None

    def write(self, batch: DataFrame, number: int) -> None:
        """A sink for foreachBatch."""
        spark, rest = batch.sparkSession, [c for c in batch.columns if c not in (*self.keys, self.version)]
        new = batch.where(F.col(self.version).isNotNull()).groupBy(*self.keys).agg(F.max(F.struct(self.version, *rest)).alias("_r")).select(*self.keys, "_r.*")
        new = new.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).withColumn("_old", F.lit(0)).persist()
        try:
            touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # `buckets` numbers at most
            manifest = self._manifest(spark, number)
            if touched:
                old = self._rows(spark, {b: n for b, n in manifest.items() if b in touched})
                rows = new
                if old is not None:
                    own = old.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).withColumn("_old", F.lit(1))
                    rows = new.unionByName(own)
                merged = rows.groupBy("bucket", *self.keys).agg(F.max(F.struct(self.version, "_old", *rest)).alias("_r")).select("bucket", *self.keys, *[f"_r.{c}" for c in (self.version, *rest)])
                merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/batch={number}")
            now = {**manifest, **dict.fromkeys(touched, number)}
            spark.createDataFrame(list(now.items()), "bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")
        finally:
            new.unpersist()

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The table by the last manifest (before a batch, if one is named); None where nothing was written."""
        return self._rows(spark, self._manifest(spark, before))

    def vacuum(self, spark: SparkSession) -> list[int]:
        """Removes the folders of batches that the last manifest doesn't name, and the manifests before it; returns the batches whose
        rows went. Not while a batch or a reader of an older manifest is at work."""
        live = set(self._manifest(spark).values())
        gone = [f for f in folders(spark, f"{self.path}/data") if int(f.split("=")[1]) not in live]
        manifests = sorted(folders(spark, f"{self.path}/manifest"), key=lambda f: int(f.split("=")[1]))[:-1]
        for f in [f"data/{f}" for f in gone] + [f"manifest/{f}" for f in manifests]:
            removed(spark, f"{self.path}/{f}")
        return sorted(int(f.split("=")[1]) for f in gone)


def sink(store: LatestStore, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    return lambda batch, number: store.write(transform(batch), number)
