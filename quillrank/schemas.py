"""Column layouts of the tables that cross module borders."""

# JSON-lines documents, as read and written.
JSON_DOC = "id string, title string, body string, indexed_at string, title_vector array<float>"

# Documents held by an index.
INDEX_DOC_COLUMNS = ["id", "title", "body", "shard", "indexed_at", "title_vector"]

# One row per (document, field, term); positions only when phrases are wanted.
POSTING_COLUMNS = ["shard", "field", "term", "id", "tf", "dl"]

FIELDS = ("title", "body")

REQUEST = "query_id bigint, q string, query_vector array<float>, limit int, alpha double, fusion string"
