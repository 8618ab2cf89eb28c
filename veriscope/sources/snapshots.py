"""Keyed tables on plain files whose versions appear all at once.

A table is a folder. `data/v=<version>/bucket=<b>` holds what a version added to a hash bucket of the keys;
`manifest/v=<version>` says, for every bucket, which versions make it up. Writing the manifest is the last step of a
version, and Spark's committer finishes it with `_SUCCESS`: before that the version does not exist for readers, however
far its writer got, and a repeated writer starts it over. A finished version is never written again, so a replayed
batch changes nothing. Readers are bound to one manifest and go on reading it while the next version is made.

An upsert writes its own rows only. A bucket that already consists of `chain` versions is merged into one on the
way, so reading stays bounded and each row is rewritten once per `chain` versions that touch its bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.operators.ordering import latest_per_key

BUCKETS, CHAIN = 16, 8
_VERSION, _BUCKET = "_version", "bucket"


class SnapshotTable:
    """One writer at a time (a stream's `foreachBatch`); any number of readers. Versions rise with each write."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = BUCKETS, chain: int = CHAIN):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.buckets, self.chain = buckets, chain

    def _listed(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        """Finished versions in order."""
        names = [n for n in self._listed(f"{self.path}/manifest") if n.startswith("v=")]
        return sorted(int(n[2:]) for n in names if "_SUCCESS" in self._listed(f"{self.path}/manifest/{n}"))

    def _manifest(self, version: int | None) -> dict[int, list[int]]:
        if version is None:
            return {}
        rows = self.spark.read.schema("bucket int, versions array<long>").parquet(f"{self.path}/manifest/v={version}")
        return {r.bucket: list(r.versions) for r in rows.collect()}  # a row per bucket

    def _rows(self, manifest: dict[int, list[int]]) -> DataFrame:
        """Rows of the buckets of a manifest, the newest per key."""
        paths = [f"{self.path}/data/v={v}/{_BUCKET}={b}" for b, versions in sorted(manifest.items()) for v in versions]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, {_VERSION} long").parquet(*paths)
        if max(map(len, manifest.values())) > 1:
            rows = latest_per_key(rows, self.keys, [_VERSION])
        return rows.drop(_VERSION)

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a finished version (the newest by default); empty before the first."""
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"version {version} of {self.path} does not exist")
        chosen = version if version is not None else (known[-1] if known else None)
        return self._rows(self._manifest(chosen))

    def upsert(self, rows: DataFrame, version: int) -> bool:
        """Adds rows, one per key, replacing those with equal keys. False if the version was there already."""
        return self._write(rows, version, keep=True)

    def replace(self, rows: DataFrame, version: int) -> bool:
        """Publishes rows, one per key, as the whole table. False if the version was there already."""
        return self._write(rows, version, keep=False)

    def _write(self, rows: DataFrame, version: int, keep: bool) -> bool:
        known = self.versions()
        if version in known:
            return False
        if known and version < known[-1]:
            raise ValueError(f"version {version} is older than {known[-1]}")
        before = self._manifest(known[-1]) if known and keep else {}
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        new = rows.select(*columns)
        full = {b: versions for b, versions in before.items() if len(versions) >= self.chain}
        if full:
            # both sides are read from files that stay as they are
            old = self._rows(full).join(new.select(*self.keys), self.keys, "left_anti")
            new = new.unionByName(old)
        home = f"{self.path}/data/v={version}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        (
            new.withColumns({_VERSION: F.lit(version).cast("long"), _BUCKET: bucket})
            .repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(home)
        )
        touched = {int(n.removeprefix(f"{_BUCKET}=")) for n in self._listed(home) if n.startswith(f"{_BUCKET}=")}
        after = {b: versions for b, versions in before.items() if b not in full}
        for b in touched:
            after[b] = [*after.get(b, []), version]
        manifest = self.spark.createDataFrame(sorted(after.items()), "bucket int, versions array<long>")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        return True


def upsert_batches(table: SnapshotTable, shape: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: upserts `shape(batch)` as the version of the batch; a batch that was written is skipped.

    A table belongs to one stream and its checkpoint, as batch numbers are its versions.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id not in table.versions():
            table.upsert(shape(batch), batch_id)

    return write
