"""Keyed Parquet tables: merge policies as joins, whole versions swapped in on success."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.operators.ranking import last_by

KEY = "parent_asin"

# Product columns that a reload does not refresh.
PRODUCT_KEPT = ("subtitle", "author", "main_category", "store")


def upsert(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str] = (KEY,),
    kept: Sequence[str] = (),
    sequence: Sequence[str] | None = None,
    stamp: str | None = None,
) -> DataFrame:
    """``old`` merged with ``new``: absent keys are inserted, present ones refreshed.

    Columns in ``kept`` hold their old value on a refresh, null included. With ``sequence`` the
    last of several new rows of one key wins; those columns are not stored. ``stamp`` names a
    column set to the current time on every row that was inserted or refreshed.
    """
    keys = list(keys)
    if sequence:
        # A first insert of a repeated key fixes its kept columns, so they come from the first
        # row of the batch and the others from the last.
        new = _first_kept(new, keys, kept, sequence)
    columns = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    present = [c for c in columns if c in new.columns]
    n = new.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in present])
    here, there = F.col("_new").isNotNull(), F.col("_old").isNotNull()

    def merged(c: str):
        before = F.col(f"_o_{c}")
        if c == stamp:
            return F.when(here, F.current_timestamp()).otherwise(before)
        if c not in present:
            return before
        fresh = F.when(here & ~there, F.col(f"_n_{c}")) if c in kept else F.when(here, F.col(f"_n_{c}"))
        keep_old = there if c in kept else ~here
        return F.when(keep_old, before).otherwise(fresh)

    joined = o.join(n, keys, "full_outer")
    return joined.select(*[*keys, *[merged(c).alias(c) for c in columns]]).select(*old.columns)


def _first_kept(new: DataFrame, keys: list[str], kept: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    order = F.struct(*sequence)
    values = [c for c in new.columns if c not in keys and c not in sequence]
    frozen = [c for c in values if c in kept]
    moving = [c for c in values if c not in kept]
    aggs = [F.max_by(F.struct(*moving), order).alias("_last")] if moving else []
    aggs += [F.min_by(F.struct(*frozen), order).alias("_first")] if frozen else []
    picked = new.groupBy(*keys).agg(*aggs)
    return picked.select(
        *keys, *[F.col(("_first." if c in frozen else "_last.") + f"`{c}`").alias(c) for c in values]
    )


def upsert_products(old: DataFrame, new: DataFrame, sequence: Sequence[str] | None = None) -> DataFrame:
    stamp = "ingested_at" if "ingested_at" in old.columns else None
    return upsert(old, new, kept=PRODUCT_KEPT, sequence=sequence, stamp=stamp)


def upsert_embeddings(old: DataFrame, new: DataFrame, sequence: Sequence[str] | None = None) -> DataFrame:
    stamp = "ingested_at" if "ingested_at" in old.columns else None
    return upsert(old, new, sequence=sequence, stamp=stamp)


def insert_if_absent(
    old: DataFrame, new: DataFrame, keys: Sequence[str] = (KEY,), sequence: Sequence[str] | None = None
) -> DataFrame:
    """``old`` plus the new rows whose key it lacks; the first of repeated new rows counts."""
    if sequence:
        keyed = [c for c in new.columns if c not in keys and c not in sequence]
        first = F.min_by(F.struct(*keyed), F.struct(*sequence)).alias("_row")
        new = new.groupBy(*keys).agg(first).select(*keys, "_row.*")
    added = new.join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(added.select(*old.columns))


def known_keys(rows: DataFrame, products: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose product exists. Catalyst broadcasts the keys when they are small and otherwise
    shuffles, where a hot product's rows are split by the adaptive skew join."""
    return rows.join(products.select(key), key, "left_semi")


def delete_cascade(
    deleted: DataFrame, *dependents: DataFrame, key: str = KEY
) -> list[DataFrame]:
    """Each table without the rows of the deleted keys."""
    gone = deleted.select(key).distinct()
    return [d.join(gone, key, "left_anti") for d in dependents]


def missing_keys(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.select(key).join(found.select(key), key, "left_anti")


def with_new_ids(rows: DataFrame, existing: DataFrame | None, id_column: str) -> DataFrame:
    """Surrogate keys above the existing ones: unique, increasing per task, with gaps.

    No shuffle and no global order, as with a database sequence.
    """
    offset = F.lit(0)
    if existing is not None:
        offset = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("m")).scalar()
    return rows.withColumn(id_column, offset + 1 + F.monotonically_increasing_id())


#: A review is the same if product, variant, user and time are.
REVIEW_KEY = ["parent_asin", "asin", "user_id", "timestamp_raw"]


def drop_repeats(reviews: DataFrame) -> DataFrame:
    """One review per (product, variant, user, time), for reloads of the same file."""
    return reviews.dropDuplicates(REVIEW_KEY)


class TableStore:
    """Tables below one shared folder, each a sequence of complete versions ``name/v=<n>``.

    A version counts once its ``_SUCCESS`` marker exists, so a failed or half-written one is
    never read and readers of the former version are not disturbed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, relative: str):
        """A Hadoop path below the root with its file system."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relative}")
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def _parts(self, name: str, prefix: str) -> list[str]:
        """Values of the ``prefix=<value>`` folders of a table."""
        folder, fs = self._path(name)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(n[len(prefix) + 1 :] for n in names if n.startswith(f"{prefix}="))

    def _versions(self, name: str) -> list[int]:
        return sorted(int(v) for v in self._parts(name, "v"))

    def _complete(self, name: str, version: int) -> bool:
        marker, fs = self._path(f"{name}/v={version}/_SUCCESS")
        return fs.exists(marker)

    def version(self, name: str) -> int | None:
        return next((v for v in reversed(self._versions(name)) if self._complete(name, v)), None)

    def read(self, name: str, schema: str) -> DataFrame:
        current = self.version(name)
        if current is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v={current}")

    def replace(self, name: str, df: DataFrame, sort_by: Sequence[str] = ()) -> None:
        """Write ``df`` as the next version; sorting by key lets key lookups skip row groups."""
        nxt = max(self._versions(name), default=0) + 1
        rows = df.sortWithinPartitions(*sort_by) if sort_by else df
        rows.write.mode("errorifexists").parquet(f"{self.root}/{name}/v={nxt}")

    def append(self, name: str, df: DataFrame, batch: str) -> None:
        """Add rows under ``batch``; repeating a batch replaces it instead of doubling it.

        Each attempt is a version of its batch, and the last complete one counts; so a repeat that fails
        leaves the rows of the attempt before, and readers of those are not disturbed.
        """
        nxt = max(self._versions(f"{name}/batch={batch}"), default=0) + 1
        df.write.mode("errorifexists").parquet(f"{self.root}/{name}/batch={batch}/v={nxt}")

    def batches(self, name: str) -> list[str]:
        """Batches with a complete version."""
        return [b for b in self._parts(name, "batch") if self.version(f"{name}/batch={b}") is not None]

    def read_batch(self, name: str, schema: str | None, batch: str) -> DataFrame:
        """The rows of one batch; without a schema, as the files have them."""
        at = f"{name}/batch={batch}"
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.root}/{at}/v={self.version(at)}")

    def read_appended(self, name: str, schema: str, without: str | None = None) -> DataFrame:
        """All batches of a table, or all but one."""
        kept = [b for b in self.batches(name) if b != without]
        if not kept:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{name}/batch={b}/v={self.version(f'{name}/batch={b}')}" for b in kept]
        return self.spark.read.schema(schema).parquet(*paths)


def write_jdbc(df: DataFrame, url: str, table: str, chunk: int = 500, **properties: str) -> None:
    """Append to an external database in chunks of ``chunk`` rows per statement."""
    df.write.jdbc(url, table, mode="append", properties={**properties, "batchsize": str(chunk)})


__all__ = [
    "TableStore", "delete_cascade", "drop_repeats", "insert_if_absent", "known_keys", "last_by",
    "missing_keys", "upsert", "upsert_embeddings", "upsert_products", "with_new_ids", "write_jdbc",
]
