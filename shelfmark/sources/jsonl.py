"""JSON-lines input: presence check, tolerant reading, source order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark import schemas

BAD = "_corrupt_record"


def input_sizes(spark: SparkSession, expected: Sequence[str]) -> DataFrame:
    """Per expected name the input to read and its size in bytes: the plain file or a folder of files, else its
    ``.gz`` form, else null. Other files beside it, such as backups, don't count, nor do empty folders.

    Only the names asked for are looked up, and no content is read.
    """
    context = spark.sparkContext

    def size(path: str) -> int | None:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(context._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return None
        if fs.getFileStatus(at).isDirectory():
            return fs.getContentSummary(at).getLength() or None
        return fs.getFileStatus(at).getLen()

    rows = []
    for path in expected:
        sizes = ((p, size(p)) for p in (path, f"{path}.gz"))
        rows.append((path, *next(((p, n) for p, n in sizes if n is not None), (None, None))))
    return spark.createDataFrame(rows, "path string, found string, length long")


def check_inputs(spark: SparkSession, expected: Sequence[str]) -> DataFrame:
    """``input_sizes``, or an error that names all missing files at once."""
    sizes = input_sizes(spark, expected)
    missing = [r["path"] for r in sizes.filter("length IS NULL").orderBy("path").collect()]
    if missing:
        raise FileNotFoundError(
            "No input at " + ", ".join(f"{p}[.gz]" for p in missing)
        )
    return sizes


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Every line as a row of text fields, unreadable lines in ``_corrupt_record``.

    ``_source`` orders rows as the files do: file, block, then row inside the block. Blank lines
    are skipped and ``.gz`` files are decompressed.
    """
    schema = schemas.raw([*fields, BAD])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", BAD).json(paths)
    # A line that parses but is no object, such as a bare number, is unreadable too.
    return rows.select(
        *fields,
        BAD,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("_source"),
    )


def parse_lines(lines: DataFrame, fields: Sequence[str], line: str = "line") -> DataFrame:
    """``read_jsonl`` for lines that are already a column, keeping the other columns."""
    schema = schemas.raw([*fields, BAD])
    parsed = F.from_json(
        F.col(line), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    )
    rest = [c for c in lines.columns if c != line]
    # As a generator the parser runs once per line: later filters on its fields stay above it,
    # where a plain projection would be repeated inside each of them. Blank lines give no row.
    filled = F.when(F.trim(F.col(line)) != "", F.array(parsed))
    return lines.select(*rest, F.inline(filled))


def readable(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(BAD).isNull()).drop(BAD)


def unreadable(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(BAD).isNotNull()).select(BAD)


def json_list(text: Column) -> Column:
    """A JSON array as an array of strings, ``[]`` for anything else."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
