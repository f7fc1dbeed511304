"""Hybrid document retrieval on Spark DataFrames."""

from quillrank.functions.scoring import Bm25
from quillrank.operators.embedding import embed_missing_titles, embed_queries, embedding_failures
from quillrank.operators.requests import check_queries, prepare, rejected_queries
from quillrank.operators.retrieval import Index
from quillrank.plans.index_store import IndexOptions, build_index, compact, create_index, open_index, vacuum, write_documents
from quillrank.plans.ingest import index_json, ingest_dump
from quillrank.plans.search import Search, hybrid_search, keyword_search, scored_search
from quillrank.streaming.index_stream import stream_index

__all__ = [
    "Bm25",
    "Index",
    "IndexOptions",
    "Search",
    "build_index",
    "check_queries",
    "compact",
    "create_index",
    "embed_missing_titles",
    "embed_queries",
    "embedding_failures",
    "hybrid_search",
    "index_json",
    "ingest_dump",
    "keyword_search",
    "open_index",
    "prepare",
    "rejected_queries",
    "scored_search",
    "stream_index",
    "vacuum",
    "write_documents",
]
