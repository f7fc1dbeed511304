"""Indexes kept as tables.

An index is a folder of immutable segments. A commit writes one segment (documents and
postings, bucketed by id) plus signed changes of the statistics, and becomes visible when its
row in ``commits`` is written last; that row lists the segments in use. A document that is written again stays in
its old segment and is listed in ``dead``. Segments of similar size are merged, so a row is rewritten as often as
the logarithm of the index's size. All segments share one bucket count, so their union keeps the
bucketing and scoring needs no shuffle.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from dataclasses import dataclass, replace
from functools import reduce
from hashlib import md5

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillrank.functions.routing import shard_of
from quillrank.functions.text import MAX_TOKEN_BYTES
from quillrank.operators.analysis import postings_and_stems
from quillrank.operators.ingest import latest_versions
from quillrank.operators.joins import lookup_join
from quillrank.operators.retrieval import Index
from quillrank.operators.statistics import all_shards, combine_field_stats, field_lengths, field_stats, shard_stats, sum_term_rows, term_counts
from quillrank.operators.stems import Dictionary
from quillrank.operators.vector_columns import check_dimension
from quillrank.schemas import FIELDS, INDEX_DOC_COLUMNS, POSTING_COLUMNS
from quillrank.session import bucket_count, index_buckets, remove_folder

_COMMIT = (
    "commit bigint, attempt string, num_shards int, num_buckets int, analyzer string, positions boolean, "
    "max_token_bytes int, dim int, segments array<struct<number: bigint, folder: string, n_docs: bigint>>, "
    "sources map<string, bigint>"
)
#: Segments of one size class that are merged into one, and documents of the smallest class.
MERGE_FACTOR, SMALL_SEGMENT = 4, 10_000


@dataclass(frozen=True)
class IndexOptions:
    """Fixed when an index is created."""

    num_shards: int = 8
    num_buckets: int = 0
    analyzer: str = "en_stem"
    positions: bool = False
    dim: int = 0
    max_token_bytes: int = MAX_TOKEN_BYTES

    def buckets(self, docs: DataFrame) -> int:
        """The number given, or one that follows from the texts of the first documents written."""
        if self.num_buckets:
            return self.num_buckets
        size = sum((F.coalesce(F.octet_length(name), F.lit(0)) for name in FIELDS), F.lit(0).cast("long"))
        return index_buckets(docs.sparkSession, docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0], self.positions)


def build_index(docs: DataFrame, options: IndexOptions = IndexOptions()) -> Index:
    """An index as lazy DataFrames, nothing written; for one-off use on modest data."""
    prepared = _prepared(docs, options).repartition("id")
    postings, _ = _postings(prepared, options)
    terms = term_counts(postings)
    return Index(
        prepared,
        postings,
        field_stats(prepared, terms),
        terms,
        options.num_shards,
        options.analyzer,
        options.positions,
        options.max_token_bytes,
        all_shards(docs.sparkSession, options.num_shards),
    )


def _postings(docs: DataFrame, options: IndexOptions, **more) -> tuple[DataFrame, Dictionary | None]:
    return postings_and_stems(docs, options.analyzer, positions=options.positions, max_bytes=options.max_token_bytes, **more)


def _prepared(docs: DataFrame, options: IndexOptions) -> DataFrame:
    if "version" in docs.columns:
        docs = latest_versions(docs, ["version"])
    missing = {"indexed_at": "string", "title_vector": "array<float>"}
    for name, kind in missing.items():
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    given = F.when(F.col("id").isNull(), F.raise_error("a document has no id").cast("string")).otherwise(F.col("id"))
    docs = docs.withColumn("id", given)
    docs = docs.withColumn("shard", shard_of(F.col("id"), options.num_shards))
    if options.dim:
        docs = check_dimension(docs, options.dim)
    return docs.select(*INDEX_DOC_COLUMNS)


def create_index(spark: SparkSession, root: str, docs: DataFrame, options: IndexOptions = IndexOptions()) -> Index:
    """Create an index at ``root``, which must not hold one."""
    if _newest(spark, root):
        raise ValueError(f"{root} already holds an index")
    return write_documents(spark, root, docs, options)


def open_index(spark: SparkSession, root: str, *more: str) -> Index:
    """The index as of its last commit; later commits do not change a DataFrame already made.

    Several roots are searched as one index, whose shards are those of the first, then those of the next, and so on. Each
    shard keeps its own statistics, so a document scores as it does in its own index; documents of different indexes may
    share an id and are told apart by their shard. All must have been made with one analyzer.
    """
    if more:
        return _as_one([open_index(spark, r) for r in (root, *more)])
    last = _newest(spark, root)
    if last is None:
        raise ValueError(f"no index at {root}")
    return _open(spark, root, last)


def _as_one(indexes: list[Index]) -> Index:
    first = indexes[0]
    for index in indexes:
        if (index.analyzer, index.max_token_bytes) != (first.analyzer, first.max_token_bytes):
            raise ValueError("indexes of different analyzers cannot be searched as one")
    positions = all(index.positions for index in indexes)
    offsets = [sum(i.num_shards for i in indexes[:n]) for n in range(len(indexes))]

    def union(name: str, columns: list[str] | None = None) -> DataFrame:
        tables = []
        for index, offset in zip(indexes, offsets, strict=True):
            rows = getattr(index, name)
            rows = rows.withColumn("shard", (F.col("shard") + F.lit(offset)).cast("int")) if offset else rows
            tables.append(rows.select(*columns) if columns else rows)
        return reduce(DataFrame.unionByName, tables)

    return Index(
        union("docs"),
        union("postings", POSTING_COLUMNS + (["positions"] if positions else [])),
        union("field_stats"),
        union("term_counts"),
        offsets[-1] + indexes[-1].num_shards,
        first.analyzer,
        positions,
        first.max_token_bytes,
        union("shards"),
        sum(index.n_docs for index in indexes),
    )


def write_documents(
    spark: SparkSession,
    root: str,
    docs: DataFrame,
    options: IndexOptions = IndexOptions(),
    *,
    source: str = "",
    source_batch: int = -1,
) -> Index:
    """Add documents, replacing those with the same id; creates the index if there is none.

    With a ``version`` column the highest version of an id wins, otherwise the last row in the order of ``docs``. A missing
    id is an error. A batch of a named ``source`` already committed is not written again. Vectors must have the size of those
    that the index has, or the given ``dim``.

    Costs follow what is written: old documents are looked up by their id column, and only if some are replaced is more of
    them read, namely their texts, whose terms are taken from the statistics. Postings are not read.
    """
    last = _newest(spark, root)
    if last is not None:
        if (last.sources or {}).get(source, -1) >= source_batch >= 0:
            return _open(spark, root, last)
        options = _options(last)
    else:
        options = replace(options, num_buckets=options.buckets(docs))
    number = last.commit + 1 if last is not None else 0
    attempt = _Segment.new(root, number, options)

    added = attempt.write_docs(spark, _prepared(docs, options))
    if "version" not in docs.columns and not added.groupBy("id").count().where("count > 1").isEmpty():
        # Rare, so the order is only kept for a second try.
        ordered = docs.withColumn("version", F.monotonically_increasing_id())
        added = attempt.write_docs(spark, _prepared(ordered, options))
    options = _with_dimension(added, options)
    n_added = added.count()
    known = _stems(spark, root, last) if last is not None else None
    postings, stems = _postings(
        added, options, known=known, unique=True, keep=lambda rows: attempt.write_words(spark, rows), num_buckets=options.num_buckets
    )
    new_postings = attempt.write_postings(spark, postings)
    if stems is not None:
        attempt.remove(spark, "words")
    if stems is not None:
        attempt.write_stats(spark, "stems", stems.added)
    changes = term_counts(new_postings)
    if last is None:
        terms = attempt.write_stats(spark, "term_stats", changes)
        attempt.write_stats(spark, "field_stats", field_stats(added, terms))
    else:
        current = _documents(spark, root, last)
        ids = added.select("id")
        # Both sides are bucketed by id, so beyond the broadcast bound this still needs no shuffle.
        dead = lookup_join(current.select("id", "shard", "segment"), ids, ["id"], "left_semi", bound=n_added)
        dead = attempt.write_stats(spark, "dead", dead)
        doc_counts = shard_stats(added)
        if not dead.isEmpty():
            replaced = lookup_join(current.select(*INDEX_DOC_COLUMNS), ids, ["id"], "left_semi", bound=n_added)
            gone, _ = _postings(replaced, options, known=known, unique=True)
            gone = term_counts(gone).selectExpr("shard", "field", "term", "-df AS df", "-total_tf AS total_tf", "NULL AS max_tf", "NULL AS min_ratio")
            changes = sum_term_rows(changes.unionByName(gone))
            doc_counts = _signed(doc_counts, shard_stats(dead), ["shard"])
        terms = attempt.write_stats(spark, "term_stats", changes)
        attempt.write_stats(spark, "field_stats", combine_field_stats(doc_counts, field_lengths(terms)))
    live = [*(last.segments if last is not None else []), Row(number=number, folder=attempt.folder, n_docs=n_added)]
    sources = dict(last.sources or {}) if last is not None else {}
    if source_batch >= 0:
        sources[source] = source_batch
    last = _commit(spark, root, number, attempt.folder, options, live, sources)
    while merged := _mergeable(last.segments):
        last = _merge(spark, root, last, merged)
    return _open(spark, root, last)


def compact(spark: SparkSession, root: str) -> Index:
    """Rewrite all live rows as one segment. Both copies keep the bucketing: no shuffle."""
    last = _newest(spark, root)
    return _open(spark, root, _merge(spark, root, last, list(last.segments)))


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete what the newest commit does not use: merged and failed segments, their tables, and older commits.

    Indexes opened before may lose their files. Returns the folders deleted.
    """
    last = _newest(spark, root)
    used = {s.folder for s in last.segments}
    gone = []
    for kind in ("docs", "postings", "term_stats", "field_stats", "dead", "stems", "words"):
        for folder in _folders(spark, f"{root}/{kind}"):
            if folder not in used:
                spark.sql(f"DROP TABLE IF EXISTS {_Segment(root, 0, folder, _options(last)).table(kind)}")
                remove_folder(spark, f"{root}/{kind}/{folder}")
                gone.append(f"{kind}/{folder}")
    for folder in _folders(spark, f"{root}/commits"):
        if folder < _commit_folder(last.commit):
            remove_folder(spark, f"{root}/commits/{folder}")
            gone.append(f"commits/{folder}")
    return gone


def _folders(spark: SparkSession, path: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(target) if s.isDirectory()) if system.exists(target) else []


def _options(last: Row) -> IndexOptions:
    return IndexOptions(last.num_shards, last.num_buckets, last.analyzer, last.positions, last.dim, last.max_token_bytes)


def _with_dimension(added: DataFrame, options: IndexOptions) -> IndexOptions:
    """The first vectors decide on the size of all."""
    if options.dim:
        return options
    size = F.when(F.size("title_vector") > 0, F.size("title_vector"))
    least, most = added.agg(F.min(size), F.max(size)).first()
    if least != most:
        raise ValueError(f"title_vector: sizes from {least} to {most} in one index")
    return replace(options, dim=most or 0)


def _signed(added: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of what is added minus what is removed, per key."""
    values = [name for name in added.columns if name not in keys]
    minus = removed.select(*keys, *[(-F.col(name)).alias(name) for name in values])
    return added.unionByName(minus).groupBy(*keys).agg(*[F.sum(name).alias(name) for name in values])


def _mergeable(segments: list[Row]) -> list[Row]:
    """The segments of the smallest size class that has ``MERGE_FACTOR`` of them; classes grow by that factor."""
    classes = defaultdict(list)
    for s in segments:
        level, bound = 0, SMALL_SEGMENT
        while s.n_docs > bound:
            level, bound = level + 1, bound * MERGE_FACTOR
        classes[level].append(s)
    full = [level for level, members in classes.items() if len(members) >= MERGE_FACTOR]
    return classes[min(full)] if full else []


def _merge(spark: SparkSession, root: str, last: Row, merged: list[Row]) -> Row:
    """Commit that puts one segment in the place of ``merged``; what these hold of dead rows is dropped."""
    options = _options(last)
    number = last.commit + 1
    attempt = _Segment.new(root, number, options)
    numbers = [s.number for s in merged]
    docs = attempt.write_docs(spark, _documents(spark, root, last, numbers).select(*INDEX_DOC_COLUMNS), dealt=True)
    attempt.write_postings(spark, _live_postings(spark, root, last, numbers))
    attempt.write_stats(spark, "term_stats", sum_term_rows(_stats(spark, root, merged, "term_stats")))
    fields = _stats(spark, root, merged, "field_stats").groupBy("shard", "field")
    attempt.write_stats(spark, "field_stats", fields.agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl")))
    stems = _stems(spark, root, last)
    if stems is not None:
        merged_stems = [f"{root}/stems/{s.folder}" for s in merged if s.folder in set(_folders(spark, f"{root}/stems"))]
        attempt.write_stats(spark, "stems", spark.read.schema(stems.schema).parquet(*merged_stems) if merged_stems else stems.limit(0))
    kept = [s for s in last.segments if s.number not in numbers]
    if kept:
        # Rows that are dead in segments which stay are still so.
        dead = _dead(spark, root, merged)
        if dead is not None:
            attempt.write_stats(spark, "dead", dead.where(F.col("segment").isin([s.number for s in kept])))
    live = [*kept, Row(number=number, folder=attempt.folder, n_docs=docs.count())]
    return _commit(spark, root, number, attempt.folder, options, live, dict(last.sources or {}))


@dataclass(frozen=True)
class _Segment:
    root: str
    number: int
    folder: str
    options: IndexOptions

    @staticmethod
    def new(root: str, number: int, options: IndexOptions) -> _Segment:
        """A segment of one attempt: writers that happen to use one number do not meet in a folder."""
        return _Segment(root, number, f"segment-{number:09d}-{uuid.uuid4().hex[:12]}", options)

    def path(self, kind: str) -> str:
        return f"{self.root}/{kind}/{self.folder}"

    def table(self, kind: str) -> str:
        return f"quillrank_{kind}_{self.options.num_buckets}_{md5(self.path(kind).encode()).hexdigest()}"

    def write_docs(self, spark: SparkSession, docs: DataFrame, *, dealt: bool = False) -> DataFrame:
        docs = docs if dealt else docs.repartition(self.options.num_buckets, "id")
        return self._write_bucketed(spark, "docs", docs, "id")

    def write_postings(self, spark: SparkSession, postings: DataFrame) -> DataFrame:
        # Sorted by term: a term's rows of a bucket share pages, and the others' pages can be skipped.
        return self._write_bucketed(spark, "postings", postings, "term", "field")

    def write_words(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        """Words that are counted but not stemmed, until the segment's postings are written."""
        return self._write_bucketed(spark, "words", rows)

    def remove(self, spark: SparkSession, kind: str) -> None:
        spark.sql(f"DROP TABLE IF EXISTS {self.table(kind)}")
        remove_folder(spark, self.path(kind))

    def _write_bucketed(self, spark: SparkSession, kind: str, rows: DataFrame, *sort: str) -> DataFrame:
        spark.sql(f"DROP TABLE IF EXISTS {self.table(kind)}")
        writer = rows.write.mode("overwrite").bucketBy(self.options.num_buckets, "id")
        writer = writer.sortBy(*sort) if sort else writer
        # Small pages, as lookups of a few terms skip by page.
        writer = writer.option("parquet.page.row.count.limit", "4096")
        writer.option("path", self.path(kind)).saveAsTable(self.table(kind))
        return spark.table(self.table(kind))

    def write_stats(self, spark: SparkSession, kind: str, rows: DataFrame) -> DataFrame:
        if kind == "term_stats":
            rows = rows.sortWithinPartitions("term")
        rows.write.mode("overwrite").option("parquet.page.row.count.limit", "4096").parquet(self.path(kind))
        return spark.read.schema(rows.schema).parquet(self.path(kind))

    def bucketed(self, spark: SparkSession, kind: str, sort: str) -> DataFrame:
        """The segment's table, declared again if this session has not seen it."""
        name = self.table(kind)
        if not spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(self.path(kind)).schema)
            spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (id) SORTED BY ({sort}) "
                f"INTO {self.options.num_buckets} BUCKETS LOCATION '{self.path(kind)}'"
            )
        return spark.table(name)


def _commit_folder(number: int) -> str:
    return f"commit_{number:09d}"


def _newest(spark: SparkSession, root: str) -> Row | None:
    """The last commit; of two with one number, the one whose writer was told that it holds."""
    if not _folders(spark, f"{root}/commits"):
        return None
    found = spark.read.schema(_COMMIT).option("recursiveFileLookup", True).parquet(f"{root}/commits")
    return found.orderBy(F.desc("commit"), "attempt").first()


def _commit(
    spark: SparkSession, root: str, number: int, attempt: str, options: IndexOptions, segments: list[Row], sources: dict[str, int]
) -> Row:
    row = (
        number, attempt, options.num_shards, options.num_buckets, options.analyzer, options.positions,
        options.max_token_bytes, options.dim, [(s.number, s.folder, s.n_docs) for s in segments], sources,
    )
    path = f"{root}/commits/{_commit_folder(number)}"
    # Fails if another writer has committed the same number.
    spark.createDataFrame([row], StructType.fromDDL(_COMMIT)).coalesce(1).write.mode("error").parquet(path)
    holds = spark.read.schema(_COMMIT).parquet(path).orderBy("attempt").first()
    if holds.attempt != attempt:
        raise RuntimeError(f"another writer has made commit {number} of {root}; write again")
    return holds


def _dead(spark: SparkSession, root: str, segments: list[Row]) -> DataFrame | None:
    # The first segment replaces nothing, and a merged one may have nothing left that it replaces.
    paths = [f"{root}/dead/{s.folder}" for s in segments]
    known = set(_folders(spark, f"{root}/dead"))
    paths = [path for path in paths if path.rsplit("/", 1)[1] in known]
    return spark.read.schema("id string, shard int, segment bigint").parquet(*paths) if paths else None


def _union_live(
    spark: SparkSession, root: str, last: Row, kind: str, sort: str, columns: list[str], numbers: list[int] | None
) -> DataFrame:
    """Rows of the live segments, or of those numbered, without dead ones; with the segment's number for documents."""
    options = _options(last)
    dead = _dead(spark, root, last.segments)
    counts = {r.segment: r.n for r in dead.groupBy("segment").agg(F.count("*").alias("n")).collect()} if dead is not None else {}
    union = None
    for s in last.segments:
        if numbers is not None and s.number not in numbers:
            continue
        # Columns in table order: a projection below the union would hide the bucketing.
        rows = _Segment(root, s.number, s.folder, options).bucketed(spark, kind, sort).select(*columns)
        if counts.get(s.number):
            gone = dead.where(F.col("segment") == s.number).select("id")
            rows = lookup_join(rows, gone, ["id"], "left_anti", bound=counts[s.number])
        if kind == "docs":
            rows = rows.withColumn("segment", F.lit(s.number).cast("bigint"))
        union = rows if union is None else union.unionByName(rows)
    return union


def _documents(spark: SparkSession, root: str, last: Row, numbers: list[int] | None = None) -> DataFrame:
    return _union_live(spark, root, last, "docs", "id", INDEX_DOC_COLUMNS, numbers)


def _live_postings(spark: SparkSession, root: str, last: Row, numbers: list[int] | None = None) -> DataFrame:
    columns = POSTING_COLUMNS + (["positions"] if last.positions else [])
    return _union_live(spark, root, last, "postings", "term, field", columns, numbers)


def _stems(spark: SparkSession, root: str, last: Row) -> DataFrame | None:
    """The stems of all words that the index has met, of an analyzer that has any."""
    if last.analyzer == "simple":
        return None
    schema = "word string, stem string"
    known = set(_folders(spark, f"{root}/stems"))
    paths = [f"{root}/stems/{s.folder}" for s in last.segments if s.folder in known]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _stats(spark: SparkSession, root: str, segments: list[Row], kind: str) -> DataFrame:
    return spark.read.parquet(*[f"{root}/{kind}/{s.folder}" for s in segments])


def _open(spark: SparkSession, root: str, last: Row) -> Index:
    terms = _stats(spark, root, last.segments, "term_stats")
    fields = _stats(spark, root, last.segments, "field_stats")
    if len(last.segments) > 1:
        fields = fields.groupBy("shard", "field").agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl"))
    return Index(
        _documents(spark, root, last).drop("segment"),
        _live_postings(spark, root, last),
        fields.where("n_docs > 0"),
        terms,
        last.num_shards,
        last.analyzer,
        last.positions,
        last.max_token_bytes,
        _shards(spark, root, last),
        sum(s.n_docs for s in last.segments),
    )


def _shards(spark: SparkSession, root: str, last: Row) -> DataFrame:
    """The shards of an index, whether they hold documents or not, as its last commit has them."""
    commits = spark.read.schema(_COMMIT).parquet(f"{root}/commits/{_commit_folder(last.commit)}").where(F.col("attempt") == last.attempt)
    return commits.select(F.explode(F.sequence(F.lit(0), F.col("num_shards") - 1)).alias("shard"))
