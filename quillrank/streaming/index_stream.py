"""Index JSON-lines files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillrank.operators.embedding import ModelFactory, embed_missing_titles
from quillrank.plans.index_store import IndexOptions, write_documents
from quillrank.session import stage
from quillrank.sources.jsonl import RAW_SCHEMA, split_documents
from quillrank.sources.ordering import file_order, with_position


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint."""
    metadata = spark.read.text(f"{checkpoint}/metadata")
    return metadata.select(F.get_json_object("value", "$.id").alias("id")).where("id IS NOT NULL").first()["id"]


def stream_index(
    spark: SparkSession,
    source: str,
    root: str,
    checkpoint: str,
    options: IndexOptions = IndexOptions(),
    *,
    files_per_batch: int = 0,
    bytes_per_batch: int = 8 << 30,
    make_model: ModelFactory | None = None,
    rejected_path: str | None = None,
) -> StreamingQuery:
    """Commit new files under ``source`` to the index at ``root``, one segment per micro-batch.

    Batches are numbered, and a batch replayed after a failure is recognized by its number and the id of its stream,
    so every file is indexed once. Of an id that comes several times in a batch the newest file's wins. A stream with a new checkpoint has a new id, also at a path used before. Readers see a commit when they next open the index.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        # The batch's session carries the same catalog and settings.
        session = batch.sparkSession
        lines = split_documents(batch, False, ["src_time", "src_file", "src_block"])
        docs = file_order(lines.docs)
        if make_model is not None:
            docs = stage(embed_missing_titles(docs, make_model), "embedded")
        write_documents(session, root, docs, options, source=stream_id(session, checkpoint), source_batch=batch_id)
        if rejected_path:
            lines.rejected.write.mode("overwrite").json(f"{rejected_path}/batch={batch_id}")

    files = spark.readStream.schema(RAW_SCHEMA)
    # Batches by size, so that many small files make one commit; by number only if asked for.
    limit = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", bytes_per_batch)
    lines = files.option(*limit).json(source)
    return (
        with_position(lines.withColumn("src_time", F.col("_metadata.file_modification_time")))
        .writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
