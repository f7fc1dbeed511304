"""File-order row numbers for splittable text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.joins import lookup_join
from quillrank.session import stage

POSITION_COLUMNS = ["src_file", "src_block", "src_row"]


def with_position(scan: DataFrame) -> DataFrame:
    """Tag file rows with (file, byte offset of the split); call directly on the file scan."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
    )


def number_rows(rows: DataFrame, name: str = "seq") -> DataFrame:
    """Add a 1-based ``bigint`` number following file order over the rows given.

    The rows are written once to the shared folder. A second pass reads only the position
    columns to count rows per split, and the per-split offsets are joined back, so the rows
    themselves are never shuffled or sorted.
    """
    staged = stage(rows.withColumn("src_row", F.monotonically_increasing_id()), "numbered")
    splits = staged.groupBy("src_file", "src_block").agg(
        F.min("src_row").alias("first_row"), F.count("*").alias("n_rows")
    )
    splits = stage(splits, "splits")
    within_file = Window.partitionBy("src_file").orderBy("src_block").rowsBetween(Window.unboundedPreceding, -1)
    files = _rows_before(splits.groupBy("src_file").agg(F.sum("n_rows").alias("file_rows")))
    offsets = splits.join(files, "src_file").select(
        "src_file",
        "src_block",
        (F.col("rows_before") + F.coalesce(F.sum("n_rows").over(within_file), F.lit(0)) - F.col("first_row")).alias(
            "shift"
        ),
    )
    numbered = lookup_join(staged, offsets, ["src_file", "src_block"])
    return numbered.withColumn(name, F.col("src_row") + F.col("shift") + 1).drop("shift")


def _rows_before(files: DataFrame) -> DataFrame:
    """Rows of all earlier files, ``(src_file, rows_before)``, for one row per file.

    Files are cut into ranges of names; totals run inside a range and over the ranges, so no task sees all files.
    """
    ranged = stage(files.repartitionByRange("src_file").withColumn("part", F.spark_partition_id()), "files")
    totals = ranged.groupBy("part").agg(F.sum("file_rows").alias("part_rows"))
    # One row per shuffle partition, whatever the number of files.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("part", F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("part").orderBy("src_file").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("file_rows").over(inside), F.lit(0))
    return ranged.withColumn("within", within).join(F.broadcast(shifts), "part").select(
        "src_file", (F.col("within") + F.col("shift")).alias("rows_before")
    )


def file_order(rows: DataFrame, name: str = "version") -> DataFrame:
    """Add a column that orders rows as their files do, without numbering them; needs the position columns.

    Files are ordered by name, or first by ``src_time`` if rows have it.
    """
    placed = rows.withColumn("src_row", F.monotonically_increasing_id())
    columns = [*(["src_time"] if "src_time" in rows.columns else []), *POSITION_COLUMNS]
    return placed.withColumn(name, F.struct(*columns)).drop(*columns)
