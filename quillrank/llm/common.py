"""What several of the operators need: table reading, document keys, grouped streaming, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.session import stage

__all__ = ["component_labels", "grouped", "held_out", "keyed", "stage", "table", "text_or_empty"]

#: Stands for a missing document id, so that joins and orderings need no null handling; sorts first.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_d`` and ``_t``, which together name a document: its id and its text's hash.

    Rows that agree in both are copies of one row and are always treated alike; rows that share only the
    id stay apart.
    """
    return docs.withColumns({"_d": F.coalesce("doc_id", F.lit(NO_ID)), "_t": F.xxhash64("text")})


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document is kept from training: its id's checksum is a multiple of ``folds``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``keys`` in sorted batches, each as one table, also where a run spans batches.

    Memory is bounded by one batch and one run, so callers must bound the size of their runs.
    """
    pending: list[pa.Table] = []
    pending_key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        columns = [rows[k].to_pylist() for k in keys]
        names = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(names) + 1):
            if i < len(names) and names[i] == names[start]:
                continue
            part = rows.slice(start, i - start)
            if pending and names[start] != pending_key:
                yield pa.concat_tables(pending)
                pending = []
            pending_key = names[start]
            pending.append(part)
            start = i
    if pending:
        yield pa.concat_tables(pending)


def binaries(column: pa.ChunkedArray) -> list[memoryview]:
    """The values of a binary column without copying them one by one."""
    values = []
    for chunk in column.chunks:
        for scalar in chunk:
            values.append(memoryview(scalar.as_buffer()) if scalar.is_valid else memoryview(b""))
    return values


def _checksum(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), total).first())


def component_labels(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected ``edges (u, v)``: ``node, label``, the label being the smallest node.

    Alternates the two star operations (Kiveris et al., Connected Components in MapReduce and Beyond): neighbours
    are tied to the smallest node known, in rounds that grow with the logarithm of the size. Every round is written to
    the shared folder, so a lost executor repeats one round at most. Nodes without an edge to another node are left out.
    """

    def star(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs, least

    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(edges, name)
    before = _checksum(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pairs, least = star(both)
        large = pairs.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        pairs, least = star(large)
        small = pairs.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        edges = stage(small.unionByName(own).filter("u <> v").distinct(), name)
        after = _checksum(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def equal_nulls(column: pa.ChunkedArray, value) -> pa.ChunkedArray:
    return pc.fill_null(column, value)
