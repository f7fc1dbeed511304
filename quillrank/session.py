"""Shared-folder handling: where intermediate tables and indexes are written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where that is not set, a folder below the warehouse, which tables are shared through anyway.
    """
    configured = spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(_CHECKPOINT_CONF)
    if configured:
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quillrank_shared"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillrank/{spark.sparkContext.applicationId}"


def remove_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; results that were not written elsewhere can no longer be read."""
    remove_folder(spark, _own_folder(spark))


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation, and lets
    several later passes read only the columns they need.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files below ``path``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.selectExpr("coalesce(sum(length), 0) AS n").first()["n"]


def bucket_count(spark: SparkSession, total_bytes: int, target_bytes: int = 256 << 20) -> int:
    """Buckets that keep one bucket near ``target_bytes``, within Spark's bucket limit."""
    wanted = max(spark.sparkContext.defaultParallelism, -(-total_bytes // target_bytes))
    return min(wanted, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))


#: Bytes of text per bucket, few enough for a task to count and sort their words in memory; with positions each word is a row to sort.
INDEX_BUCKET_BYTES, POSITIONS_BUCKET_BYTES = 8 << 20, 2 << 20


def index_buckets(spark: SparkSession, text_bytes: int, positions: bool = False) -> int:
    """Buckets of an index of ``text_bytes`` of text; their number grows with the text, so a bucket does not."""
    most = POSITIONS_BUCKET_BYTES if positions else INDEX_BUCKET_BYTES
    return max(bucket_count(spark, text_bytes), bucket_count(spark, text_bytes, most))
