"""Keyed tables cut into buckets by a hash of the key; a merge rewrites only the buckets of its batch.

Layout below ``root/name``::

    data/store_version=<n>/bucket=<b>/...    rows of a bucket as that version wrote them
    manifest/store_version=<n>/...           for each bucket the version that holds it

The names of these two folders are columns of the files, so a table has no columns of its own called so.

A version counts once its manifest is complete, which is written last. So readers see whole versions only, a failed
merge leaves nothing that is read, and a reader of the version before isn't disturbed. Files that none of the last
``keep`` versions needs are deleted by ``vacuum``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.functions import vectors as V
from shelfmark.session import materialize
from shelfmark.sources.tables import KEY

BUCKET, VERSION = "bucket", "store_version"


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class BucketStore:
    """Bucketed tables with versions. The number of buckets is fixed when a table is made: choose it so
    that a bucket is a few hundred megabytes; all that a driver holds are a few numbers per bucket."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, key: str = KEY):
        self.spark, self.root, self.buckets, self.key = spark, root.rstrip("/"), buckets, key

    def _at(self, path: str):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(context._jsc.hadoopConfiguration())

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        at, fs = self._at(folder)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[len(prefix) + 1 :]) for n in names if n.startswith(f"{prefix}="))

    def versions(self, name: str) -> list[int]:
        """Complete versions, oldest first."""
        folder = f"{self.root}/{name}/manifest"
        return [
            v for v in self._numbers(folder, VERSION) if (m := self._at(f"{folder}/{VERSION}={v}/_SUCCESS"))[1].exists(m[0])
        ]

    def _manifest(self, name: str, version: int) -> tuple[dict[int, int], str | None]:
        """Version of each bucket, and the batch that made this one."""
        schema = "bucket int, held int, buckets int, batch string"
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/manifest/{VERSION}={version}").collect()
        if any(r["buckets"] != self.buckets for r in rows):
            raise ValueError(f"{name} has {rows[0]['buckets']} buckets, not {self.buckets}")
        return {r["bucket"]: r["held"] for r in rows if r["bucket"] >= 0}, rows[0]["batch"]

    def read(self, name: str, schema: str, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """A version, the last by default, with the partition column ``bucket``; only some buckets, if named."""
        known = self.versions(name)
        version = known[-1] if version is None and known else version
        held = self._manifest(name, version)[0] if version is not None else {}
        if buckets is not None:
            held = {b: held[b] for b in buckets if b in held}
        if not held:
            return self.spark.createDataFrame([], f"{schema}, {BUCKET} int")
        data = f"{self.root}/{name}/data"
        paths = [f"{data}/{VERSION}={v}/{BUCKET}={b}" for b, v in sorted(held.items())]
        rows = self.spark.read.schema(f"{schema}, {VERSION} int, {BUCKET} int").option("basePath", data).parquet(*paths)
        return rows.drop(VERSION)

    def merge(
        self, name: str, schema: str, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame],
        batch_id: str | None = None,
    ) -> int | None:
        """Merge ``batch`` into its buckets by ``merge(old, batch)`` and return the new version.

        A batch id that a kept version was made by is not merged again, and an empty batch makes no version.
        """
        known = self.versions(name)
        current = known[-1] if known else None
        if batch_id is not None and any(self._manifest(name, v)[1] == batch_id for v in known):
            return current
        batch = materialize(batch)  # read twice
        touched = sorted(r[0] for r in batch.select(bucket_of(self.key, self.buckets)).distinct().collect())
        if not touched:
            return current
        old = self.read(name, schema, current, touched).drop(BUCKET)
        merged = merge(old, batch).withColumn(BUCKET, bucket_of(self.key, self.buckets))
        nxt = max([0, *known, *self._numbers(f"{self.root}/{name}/data", VERSION)]) + 1
        path = f"{self.root}/{name}/data/{VERSION}={nxt}"
        rows = merged.repartition(len(touched), BUCKET).sortWithinPartitions(BUCKET, self.key)
        rows.write.mode("errorifexists").partitionBy(BUCKET).parquet(path)
        held = self._manifest(name, current)[0] if current is not None else {}
        for b in touched:
            held.pop(b, None)
        held |= {b: nxt for b in self._numbers(path, BUCKET)}
        lines = [(b, v, self.buckets, batch_id) for b, v in [(-1, nxt), *sorted(held.items())]]
        manifest = self.spark.createDataFrame(lines, "bucket int, held int, buckets int, batch string")
        manifest.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/{name}/manifest/{VERSION}={nxt}")
        return nxt

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Delete what the last ``keep`` versions don't need; the number of bucket folders that went.

        Data of a version that is being written now is newer than the last complete one and stays.
        """
        known = self.versions(name)
        needed = {(v, b) for n in known[-keep:] for b, v in self._manifest(name, n)[0].items()}
        gone = 0
        for v in self._numbers(f"{self.root}/{name}/data", VERSION):
            if not known or v > known[-1]:
                continue
            folder = f"{self.root}/{name}/data/{VERSION}={v}"
            held = self._numbers(folder, BUCKET)
            old = [b for b in held if (v, b) not in needed]
            for path in [folder] if len(old) == len(held) else [f"{folder}/{BUCKET}={b}" for b in old]:
                at, fs = self._at(path)
                fs.delete(at, True)
            gone += len(old)
        for n in known[:-keep]:
            at, fs = self._at(f"{self.root}/{name}/manifest/{VERSION}={n}")
            fs.delete(at, True)
        return gone


VECTORS = "parent_asin string, embedding array<float>, bits array<bigint>"


def vector_rows(embeddings: DataFrame, dim: int) -> DataFrame:
    """Key, vector and sign bits: the columns of a stored vector table, where stage 1 of a search reads the bits
    and stage 2 only the buckets of its candidates."""
    return embeddings.select("parent_asin", "embedding", V.pack_bits("embedding", dim).alias("bits"))
