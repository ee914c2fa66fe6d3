"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "shelfmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can see: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        root = configured
    else:
        root = spark.sparkContext.getCheckpointDir()
        if root is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            root = tempfile.mkdtemp(prefix="shelfmark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and cut its lineage.

    Needed where two branches of a plan must see the very same physical order.
    """
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, parts: int | None) -> DataFrame:
    """Deal the rows out to ``parts`` partitions before costly work per row; None leaves them as read.

    For inputs that a scan can't split, such as one compressed file; the caller knows which they are.
    """
    return df if parts is None else df.repartition(parts)
