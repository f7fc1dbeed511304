"""DuckDB SQL for the queries of ``registry.queries``.

Written from the definitions of the operators, independently of the Spark plans: per-row
array functions, plain joins and windows. Stems come from a chain of steps over the distinct words.
"""

from __future__ import annotations

# The characters that the cleaning rule strips, and those it takes for white space.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_MARKUP = r"''{2,3}|\[\[|\]\]|\{\{|\}\}|\[|\]"
_SPLIT = r"'[^\p{L}\p{N}]+'"


def _clean(raw: str, max_chars: int = 0) -> str:
    text = f"translate(regexp_replace({raw}, '{_MARKUP}', '', 'g'), chr(10) || chr(9), '  ')"
    text = f"regexp_replace({text}, '{_SPACE}{{2,}}', ' ', 'g')"
    text = f"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    return f"substring({text}, 1, {max_chars})" if max_chars else text


def _shard(doc_id: str, n: int = 8) -> str:
    return f"CAST(CAST('0x' || substr(md5({doc_id}), 1, 16) AS UBIGINT) % {n} AS INTEGER)"


def _words(text: str) -> str:
    kept = f"list_filter(regexp_split_to_array({text}, {_SPLIT}), lambda w: strlen(w) BETWEEN 1 AND 39)"
    return f"list_transform({kept}, lambda w: lower(w))"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _marked(text: str, title: str) -> str:
    wide = "chr(160) || chr(12288)"
    return (
        f"('''''''' || {title} || ''''''' [[a|b]] {{{{c}}}}' || chr(9) || chr(9) || ' ' || {wide} || ' ' || {text} "
        f"|| '  [x] ' || chr(10))"
    )


_DOCS = f"""docs AS (
  SELECT 'wiki_' || d.doc_id AS id, d.doc_id, split_part(d.text, chr(10), 1) AS title, d.text AS body,
         {_shard("'wiki_' || d.doc_id")} AS shard, e.embedding AS title_vector
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

# Of two indexes searched as one, the second's shards come after the first's.
_DOCS_OF_TWO = _DOCS.replace("AS shard", "+ CAST(8 * (d.doc_id % 2) AS INTEGER) AS shard")

_QUERIES = """queries AS (
  SELECT b.item_id AS query_id, b.text AS q, e.embedding AS query_vector
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""


def _postings(docs: str = "docs", stemmed: bool = False) -> str:
    tokens = "tokens AS (SELECT id, shard, field, len(words) AS dl, unnest(words) AS term FROM fields)"
    if stemmed:
        words = f"raw_query_words AS (SELECT query_id, unnest({_words('q')}) AS term FROM queries)"
        stems = "tokens AS (SELECT id, shard, field, dl, stem AS term FROM raw_tokens JOIN stems USING (term))"
        tokens = ",\n".join([tokens.replace("tokens AS", "raw_tokens AS", 1), words, *_STEMS, stems])
    return f"""fields AS (
  SELECT id, shard, 'title' AS field, {_words('title')} AS words FROM {docs}
  UNION ALL SELECT id, shard, 'body', {_words('body')} FROM {docs}),
{tokens},
postings AS (
  SELECT shard, field, term, id, CAST(count(*) AS INTEGER) AS tf, CAST(max(dl) AS INTEGER) AS dl
  FROM tokens GROUP BY shard, field, term, id),
term_stats AS (SELECT shard, field, term, count(*) AS df FROM postings GROUP BY shard, field, term),
field_stats AS (
  SELECT shard, field, count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS sum_dl
  FROM fields GROUP BY shard, field)"""


def _ending(step: str, source: str, endings: str) -> str:
    """A step's words with the ending found and the part before it."""
    return f"""{step} AS (
  SELECT *, w[:len(w) - len(e)] AS b FROM (SELECT *, regexp_extract(w, '({endings})$', 1) AS e FROM {source}))"""


def _swap(pairs: str) -> str:
    """The replacement of an ending, from ``ending:replacement`` pairs."""
    cases = " ".join("WHEN '{}' THEN '{}'".format(*pair.split(":")) for pair in pairs.split())
    return f"b || CASE e {cases} END"


# The endings of the published steps and what takes their place.
_TWO = (
    "ational:ate tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ation:ate ator:ate alism:al aliti:al alli:al "
    "fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:"
)
_THREE = "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:"
_FOUR = "al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ism|ate|iti|ous|ive|ize|ion"
_EXCEPTIONS = (
    "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky "
    "news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes"
)
_SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"


def _endings(pairs: str) -> str:
    return "|".join(pair.split(":")[0] for pair in pairs.split())


_STEMS = (
    "vocabulary AS (SELECT DISTINCT term FROM (SELECT term FROM raw_tokens UNION ALL SELECT term FROM raw_query_words))",
    r"""marked AS (SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') AS w FROM vocabulary),
starts AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5 WHEN starts_with(w, 'commun') THEN 6
  WHEN regexp_matches(w, '""" + _REGION + r"""') THEN len(regexp_extract(w, '""" + _REGION + r"""')) ELSE len(w) END AS r1 FROM marked),
regions AS (SELECT *, r1 + CASE WHEN regexp_matches(w[r1 + 1:], '""" + _REGION + r"""')
  THEN len(regexp_extract(w[r1 + 1:], '""" + _REGION + r"""')) ELSE len(w) - r1 END AS r2 FROM starts),
step_1a AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'sses') THEN w[:-3] WHEN regexp_matches(w, 'ie[ds]$')
  THEN CASE WHEN len(w) > 4 THEN w[:-3] ELSE w[:-2] END WHEN regexp_matches(w, '[us]s$') THEN w
  WHEN regexp_matches(w, '[aeiouy].+s$') THEN w[:-2] ELSE w END AS w) FROM regions),
kept AS (SELECT *, w IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') AS final,
  w AS final_w FROM step_1a)""",
    _ending("past", "kept", "eedly|eed|ingly|edly|ing|ed"),
    f"""step_1b AS (SELECT * EXCLUDE (e, b) REPLACE (CASE WHEN e = '' THEN w
  WHEN e IN ('eed', 'eedly') THEN CASE WHEN len(b) >= r1 THEN b || 'ee' ELSE w END
  WHEN NOT regexp_matches(b, '[aeiouy]') THEN w
  WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
  WHEN b[-2:] IN ('bb', 'dd', 'ff', 'gg', 'mm', 'nn', 'pp', 'rr', 'tt') THEN b[:-2]
  WHEN len(b) <= r1 AND regexp_matches(b, '{_SHORT}') THEN b || 'e' ELSE b END AS w) FROM past)""",
    r"step_1c AS (SELECT * REPLACE (regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\1i') AS w) FROM step_1b)",
    _ending("two", "step_1c", _endings(_TWO)),
    f"""step_2 AS (SELECT * EXCLUDE (e, b) REPLACE (CASE WHEN e = '' OR len(b) < r1 OR (e = 'ogi' AND b[-1] <> 'l')
  OR (e = 'li' AND NOT regexp_matches(b, '[cdeghkmnrt]$')) THEN w ELSE {_swap(_TWO)} END AS w) FROM two)""",
    _ending("three", "step_2", _endings(_THREE)),
    f"""step_3 AS (SELECT * EXCLUDE (e, b) REPLACE (CASE WHEN e = '' OR len(b) < CASE WHEN e = 'ative' THEN r2 ELSE r1 END
  THEN w ELSE {_swap(_THREE)} END AS w) FROM three)""",
    _ending("four", "step_3", _FOUR),
    "step_4 AS (SELECT * EXCLUDE (e, b) REPLACE (CASE WHEN e = '' OR len(b) < r2 OR (e = 'ion' AND b[-1] NOT IN ('s', 't')) "
    "THEN w ELSE b END AS w) FROM four)",
    f"""stems AS (SELECT term, CASE WHEN len(term) <= 2 THEN term ELSE CASE term {
        " ".join("WHEN '{}' THEN '{}'".format(*pair.split(":")) for pair in _EXCEPTIONS.split())
    } ELSE lower(CASE WHEN final THEN final_w
  WHEN ends_with(w, 'e') AND (len(w) > r2 OR (len(w) > r1 AND NOT regexp_matches(w[:-2], '{_SHORT}'))) THEN w[:-2]
  WHEN ends_with(w, 'll') AND len(w) > r2 THEN w[:-2] ELSE w END) END END AS stem FROM step_4)""",
)

_LENGTH = {
    "exact": "dl",
    "quantized": "CASE WHEN dl < 40 THEN dl ELSE dl - (dl - 24) % CAST(pow(2, floor(log2(dl - 24)) - 3) AS INTEGER) END",
}


def _term_weight(tf: str, dl: str, idf: str, avg_dl: str) -> str:
    return f"({idf}) * 2.2::DOUBLE * {tf} / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * ({dl}) / ({avg_dl})))"


_IDF = "ln(1.0::DOUBLE + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"


def _weighed(length: str = "exact") -> str:
    return f"""weighed AS (
  SELECT p.shard, p.field, p.term, p.id,
         {_term_weight('tf', _LENGTH[length], _IDF, 'sum_dl::DOUBLE / n_docs')} AS weight
  FROM postings p JOIN term_stats USING (shard, field, term) JOIN field_stats USING (shard, field))"""


_BAG = f"""query_words AS (SELECT query_id, unnest({_words('q')}) AS term FROM queries)"""


def _bag_scores(dedupe: bool = True, length: str = "exact") -> str:
    words = "SELECT DISTINCT query_id, term FROM query_words" if dedupe else "SELECT query_id, term FROM query_words"
    return f"""{_weighed(length)},
{_BAG},
scored AS (
  SELECT query_id, shard, id, round(sum(weight), 6) AS bm25_score
  FROM ({words}) JOIN weighed USING (term) GROUP BY query_id, shard, id)"""


def _pool(k: str = "20") -> str:
    return f"""pool AS (
  SELECT query_id, shard, id, bm25_score, CAST(shard_rank AS INTEGER) AS shard_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, shard ORDER BY bm25_score DESC, id) AS shard_rank FROM scored)
  JOIN limits USING (query_id) WHERE shard_rank <= {k})"""


def _limits(limit: str = "20", source: str = "queries") -> str:
    return f"limits AS (SELECT query_id, {limit} AS lim FROM {source})"


_WIDENED = "greatest(lim, least(lim * 2, 200))"

_BASE = (_DOCS, _QUERIES, _postings())
_STEMMED = (_DOCS, _QUERIES, _postings(stemmed=True))


def _bag_of_stems() -> str:
    return _bag_scores().replace(_BAG, "query_words AS (SELECT query_id, stem AS term FROM raw_query_words JOIN stems USING (term))")


_KEYWORD = (*_BASE, _bag_scores(), _limits(), _pool())

_COSINE = """candidates AS (
  SELECT p.query_id, p.shard, p.id, d.title, p.bm25_score,
         round(coalesce(list_cosine_similarity(q.query_vector::DOUBLE[], d.title_vector::DOUBLE[]), 0.0::DOUBLE), 6)
           AS semantic_score
  FROM pool p JOIN docs d USING (id) JOIN asked q ON q.query_id = p.query_id)"""


def _asked(vector: str, limit: str, alpha: str, fusion: str) -> str:
    return f"""asked AS (
  SELECT query_id, q, {vector} AS query_vector, CAST({limit} AS INTEGER) AS lim, CAST({alpha} AS DOUBLE) AS alpha,
         CASE WHEN {fusion} = 'rrf' AND ({vector}) IS NOT NULL THEN 'rrf' ELSE 'weighted' END AS method
  FROM queries)"""


_FUSED = """ranked AS (
  SELECT c.*, lim, alpha, method,
         row_number() OVER (PARTITION BY c.query_id ORDER BY bm25_score DESC, shard, id) AS k_rank
  FROM candidates c JOIN asked a ON a.query_id = c.query_id),
both_ranks AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, k_rank) AS s_rank FROM ranked),
fused AS (
  SELECT *, CASE WHEN method = 'rrf' THEN 1.0::DOUBLE / (60 + k_rank) + 1.0::DOUBLE / (60 + s_rank)
                 ELSE alpha * bm25_score + (1.0::DOUBLE - alpha) * semantic_score END AS hybrid
  FROM both_ranks),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC,
    CASE WHEN method = 'rrf' THEN s_rank ELSE 0 END, shard, bm25_score DESC, id) AS place FROM fused),
hybrid_hits AS (
  SELECT query_id, CAST(place AS INTEGER) AS "rank", id, title, bm25_score AS keyword_score, semantic_score,
         round(hybrid, 9) AS hybrid_score, shard
  FROM placed WHERE place <= lim)"""


def _hybrid(vector="query_vector", limit="20", alpha="0.5", fusion="'rrf'", stemmed=False) -> tuple[str, ...]:
    asked = _asked(vector, limit, alpha, fusion)
    limits = "limits AS (SELECT query_id, lim FROM asked)"
    base, scores = (_STEMMED, _bag_of_stems()) if stemmed else (_BASE, _bag_scores())
    return (*base, asked, limits, scores, _pool(_WIDENED), _COSINE, _FUSED)


_MIXED = _hybrid(
    vector="CASE WHEN query_id % 3 <> 0 THEN query_vector END",
    limit="query_id % 30 + 1",
    alpha="(query_id % 5)::DOUBLE / 4",
    fusion="CASE WHEN query_id % 4 = 0 THEN 'weighted' ELSE 'rrf' END",
)

# Structured clauses: one per word of the benchmark text, placed by its order.
_CLAUSE_WORDS = rf"""raw_clauses AS (
  SELECT query_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM (
    SELECT query_id, list_filter(regexp_split_to_array(q, {_SPLIT}), lambda w: w <> '') AS words FROM queries)),
clause_terms AS (SELECT *, lower(word) AS term FROM raw_clauses WHERE strlen(word) < 40)"""


def _clause_hits(occur: str, field: str = "TRUE", boost: str = "1.0") -> str:
    parts = (
        *_BASE,
        _weighed(),
        _CLAUSE_WORDS,
        f"""matched AS (
  SELECT query_id, i, {occur} AS occur, shard, id, CAST({boost} AS DOUBLE) * weight AS score
  FROM clause_terms JOIN weighed USING (term) WHERE {field})""",
        f"""needed AS (
  SELECT query_id, count(*) FILTER (WHERE {occur} = 'must') AS n_must FROM raw_clauses GROUP BY query_id)""",
        """scored AS (
  SELECT query_id, shard, id, round(sum(score) FILTER (WHERE occur <> 'must_not'), 6) AS bm25_score
  FROM matched JOIN needed USING (query_id)
  GROUP BY query_id, shard, id, n_must
  HAVING count(*) FILTER (WHERE occur = 'must_not') = 0
     AND count(*) FILTER (WHERE occur <> 'must_not') > 0
     AND count(DISTINCT CASE WHEN occur = 'must' THEN i END) = n_must)""",
        _limits(),
        _pool(),
    )
    return _with(*parts) + "SELECT * FROM pool"


_PLACES = (
    f"""slots AS (
  SELECT shard, id, field, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM (
    SELECT shard, id, 'title' AS field, regexp_split_to_array(title, {_SPLIT}) AS words FROM docs
    UNION ALL SELECT shard, id, 'body', regexp_split_to_array(body, {_SPLIT}) FROM docs))""",
    "places AS (SELECT shard, id, field, lower(word) AS term, pos FROM slots WHERE strlen(word) BETWEEN 1 AND 39)",
)
_PAIRS = (
    # Words too long to be indexed leave their place empty.
    """pairs AS (
  SELECT query_id, unnest(range(1, greatest(max(n) - 1, 1) + 1)) AS clause FROM raw_clauses GROUP BY query_id)""",
    """phrases AS (
  SELECT query_id, 0 AS clause, term, i AS word_offset, count(*) OVER (PARTITION BY query_id) AS n_words FROM clause_terms
  UNION ALL
  SELECT query_id, clause, term, i - clause + 1, count(*) OVER (PARTITION BY query_id, clause)
  FROM clause_terms JOIN pairs USING (query_id) WHERE i BETWEEN clause - 1 AND clause)""",
)
_PHRASE_SCORES = (
    f"""starts AS (
  SELECT query_id, clause, n_words, shard, id, field, pos - word_offset AS start, sum({_IDF}) AS idf
  FROM phrases JOIN places USING (term) JOIN term_stats USING (shard, field, term) JOIN field_stats USING (shard, field)
  GROUP BY ALL HAVING count(*) = n_words)""",
    """found AS (
  SELECT query_id, clause, shard, id, field, count(*) AS tf, max(idf) AS idf FROM starts GROUP BY ALL)""",
    f"""scored AS (
  SELECT query_id, shard, id, round(sum({_term_weight('tf', 'len(words)', 'idf', 'sum_dl::DOUBLE / n_docs')}), 6) AS bm25_score
  FROM found JOIN fields USING (shard, id, field) JOIN field_stats USING (shard, field)
  GROUP BY query_id, shard, id)""",
)
_PHRASE = _with(*_BASE, _CLAUSE_WORDS, *_PLACES, *_PAIRS, *_PHRASE_SCORES, _limits(), _pool()) + "SELECT * FROM pool"

_GAP = (
    f"""gaps AS (
  SELECT doc_id AS query_id, words, list_position(
    list_transform(words, lambda w, i: strlen(w) >= 40 AND i > 1 AND i < len(words)), true) AS middle FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, {_SPLIT}), lambda w: w <> '') AS words FROM documents)),
phrases AS (
  SELECT query_id, 0 AS clause, lower(words[middle + d]) AS term, d + 1 AS word_offset, count(*) OVER (PARTITION BY query_id) AS n_words
  FROM gaps, (SELECT unnest([-1, 1]) AS d) WHERE middle > 0 AND strlen(words[middle + d]) < 40)""",
)

# Pages of the dump: every tenth lacks a title, another tenth a text.
_PAGES = f"""pages_in AS (
  SELECT doc_id, title, {_marked('body', 'title')} AS raw FROM docs
  WHERE doc_id % 10 NOT IN (3, 7) AND title <> ''),
numbered AS (SELECT row_number() OVER (ORDER BY doc_id) AS seq, title, raw FROM pages_in),
cleaned AS (SELECT 'wiki_' || seq AS id, title, {_clean('raw')} AS body FROM numbered)"""

_LINES = """lines AS (
  SELECT *, CASE WHEN doc_id % 10 IN (1, 4) THEN 'malformed' WHEN doc_id % 10 = 2 THEN 'missing:body'
                 WHEN doc_id % 10 = 5 THEN 'missing:id' ELSE 'indexed' END AS reason FROM docs)"""

_VERSIONS = f"""versions AS (
  SELECT id, title, body, shard, 1 AS version FROM docs
  UNION ALL
  SELECT id, title || ' revised', reverse(body), shard, 2 FROM docs WHERE doc_id % 3 = 0),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM versions) WHERE rn = 1)"""


def _hashed(text: str) -> str:
    words = f"list_filter(string_split(lower({text}), ' '), lambda w: w <> '')"
    return f"list_transform({words}, lambda w: CAST(CAST('0x' || substr(md5(w), 1, 8) AS UBIGINT) % 64 AS INTEGER))"


def _embedded(key: str, text: str, source: str) -> str:
    return (
        f"SELECT {key}, pos, CAST(count(*) AS DOUBLE) AS x "
        f"FROM (SELECT {key}, unnest({_hashed(text)}) AS pos FROM {source}) GROUP BY {key}, pos"
    )


def _unnested(key: str, vector: str, source: str) -> str:
    return f"SELECT {key}, CAST(generate_subscripts({vector}, 1) - 1 AS INTEGER) AS pos, unnest({vector}) AS x FROM {source}"


_MERGED = """SELECT query_id, CAST(place AS INTEGER) AS "rank", id, bm25_score AS score, title, m.shard FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, shard, id) AS place FROM pool) m
JOIN (SELECT id, title FROM docs) USING (id) WHERE place <= 20"""

ORACLES: dict[str, str] = {
    # Ingest
    "clean_body": _with(_DOCS) + f"SELECT id, {_clean(_marked('body', 'title'), 2000)} AS body FROM docs",
    "clean_body_full": _with(_DOCS) + f"SELECT id, {_clean(_marked('body', 'title'))} AS body FROM docs",
    "shard_route": _with(_DOCS)
    + f"SELECT id, 0 AS of_1, {_shard('id', 3)} AS of_3, {_shard('id', 7)} AS of_7, {_shard('id', 8)} AS of_8 FROM docs",
    "xml_pages": _with(_DOCS, _PAGES) + "SELECT title, raw FROM numbered",
    "page_seq": _with(_DOCS, _PAGES) + "SELECT seq, title FROM numbered WHERE seq <= 500",
    "min_len_filter": _with(_DOCS)
    + f"SELECT id, title, CAST(length(body) AS INTEGER) AS n_chars FROM (SELECT id, title, {_clean('body', 2000)} AS body FROM docs) "
    "WHERE length(body) >= 50",
    "ingest_report": _with(_DOCS, _PAGES)
    + "SELECT count(*) FILTER (WHERE length(body) >= 50) AS written, count(*) FILTER (WHERE length(body) < 50) AS skipped "
    "FROM cleaned",
    "jsonl_roundtrip": _with(_DOCS, _PAGES)
    + f"SELECT id, title, body, 0 AS dims, {_shard('id')} AS shard FROM cleaned WHERE length(body) >= 50",
    "ingest_all_pages": _with(_DOCS, _PAGES)
    + "SELECT count(*) FILTER (WHERE length(body) >= 50) AS written, count(*) FILTER (WHERE length(body) < 50) AS skipped, "
    "CAST(sum(length(body)) FILTER (WHERE length(body) >= 50) AS BIGINT) AS n_chars FROM cleaned",
    "xml_pages_prefixed": _with(_DOCS, _PAGES) + "SELECT title, raw FROM numbered",
    "xml_quarantine": _with(_DOCS)
    + f"""SELECT reason, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_chars FROM (
      SELECT CASE WHEN doc_id % 10 = 5 THEN 'malformed' WHEN doc_id % 10 = 3 OR title = '' THEN 'title missing'
                  WHEN doc_id % 10 = 7 THEN 'text missing' ELSE 'taken' END AS reason,
             CASE WHEN doc_id % 10 = 5 OR doc_id % 10 = 3 THEN 0 WHEN doc_id % 10 = 7 THEN length(title)
                  WHEN title = '' THEN 0 ELSE length({_marked('body', 'title')}) END AS n
      FROM docs) GROUP BY reason""",
    "xml_pages_bz2": _with(_DOCS, _PAGES) + "SELECT title, raw FROM numbered",
    "jsonl_single": _with(_DOCS, _PAGES)
    + "SELECT id, title, CAST(length(body) AS INTEGER) AS n_chars FROM cleaned WHERE length(body) >= 50",
    "jsonl_quarantine": _with(_DOCS, _LINES)
    + "SELECT reason, count(*) AS n_lines, CAST(sum(CASE WHEN reason = 'indexed' THEN coalesce(len(title_vector), 0) ELSE 0 END) "
    "AS BIGINT) AS n_dims FROM lines GROUP BY reason",
    "index_report": _with(_DOCS, _LINES)
    + "SELECT count(*) FILTER (WHERE reason = 'indexed') AS indexed, count(*) FILTER (WHERE reason <> 'indexed') AS skipped "
    "FROM lines",
    "doc_cap": _with(_DOCS, _LINES)
    + "SELECT id, version FROM (SELECT id, row_number() OVER (ORDER BY doc_id) AS version FROM lines WHERE reason = 'indexed') "
    "WHERE version <= 200",
    # Index
    "tokenize_terms": _with(_DOCS, _postings()) + "SELECT * FROM postings",
    "tokenize_stemmed": _with(*_STEMMED) + "SELECT * FROM postings",
    "term_df": _with(_DOCS, _postings()) + "SELECT * FROM term_stats",
    "field_stats_by_shard": _with(_DOCS, _postings()) + "SELECT * FROM field_stats",
    "shard_doc_counts": _with(_DOCS) + "SELECT shard, count(*) AS doc_count FROM docs GROUP BY shard",
    "cluster_totals": _with(_DOCS)
    + """SELECT 8::BIGINT AS total_shards, (SELECT count(*) FROM docs) AS total_documents, s::INTEGER AS shard, count(id) AS doc_count
FROM range(8) r(s) LEFT JOIN docs ON shard = s GROUP BY s""",
    "cluster_totals_two_roots": _with(_DOCS_OF_TWO)
    + """SELECT 16::BIGINT AS total_shards, (SELECT count(*) FROM docs) AS total_documents, s::INTEGER AS shard, count(id) AS doc_count
FROM range(16) r(s) LEFT JOIN docs ON shard = s GROUP BY s""",
    "shard_list": "SELECT s::INTEGER AS shard FROM range(8) r(s)",
    "empty_shards": _with(_DOCS)
    + f"""SELECT s::INTEGER AS shard, count(id) AS doc_count
FROM range(3000) r(s) LEFT JOIN (SELECT id, {_shard("id", 3000)} AS own FROM docs) ON own = s GROUP BY s""",
    "upsert_latest": _with(_DOCS, _VERSIONS) + "SELECT id, title, body, version FROM latest",
    "upsert_index_docs": _with(_DOCS, _VERSIONS) + "SELECT id, title, body, shard FROM latest",
    "upsert_repeated_ids": _with(_DOCS, _VERSIONS) + "SELECT id, title, body, shard FROM latest",
    "upsert_many_commits": _with(
        _DOCS,
        """last_write AS (
  SELECT id, doc_id, max(n) AS n FROM docs, range(10) r(n)
  WHERE doc_id % 10 = n OR (doc_id % 10 < n AND doc_id % 7 = n % 7) GROUP BY ALL),
written AS (SELECT id, shard, title || ' v' || n AS title, body FROM docs JOIN last_write USING (id))""",
        _postings("written"),
    )
    + "SELECT * FROM term_stats",
    "upsert_index_terms": _with(_DOCS, _VERSIONS, _postings("latest")) + "SELECT * FROM term_stats",
    "upsert_index_fields": _with(_DOCS, _VERSIONS, _postings("latest")) + "SELECT * FROM field_stats",
    "index_jsonl": _with(_DOCS, _LINES)
    + "SELECT id, shard, CAST(length(body) AS INTEGER) AS n_chars FROM lines WHERE reason = 'indexed'",
    "stream_index_terms": _with(_DOCS, _VERSIONS, _postings("latest")) + "SELECT * FROM term_stats",
    # Keyword search
    "bm25_topk": _with(*_KEYWORD) + "SELECT * FROM pool",
    "bm25_quantized": _with(*_BASE, _bag_scores(length="quantized"), _limits(), _pool()) + "SELECT * FROM pool",
    "bm25_repeated": _with(*_BASE, _bag_scores(dedupe=False), _limits(), _pool()) + "SELECT * FROM pool",
    "bm25_stemmed": _with(*_STEMMED, _bag_of_stems(), _limits(), _pool()) + _MERGED,
    "hybrid_stemmed": _with(*_hybrid(stemmed=True)) + "SELECT * FROM hybrid_hits",
    "bm25_merge": _with(*_KEYWORD) + _MERGED,
    "search_report": _with(*_KEYWORD)
    + """SELECT q.query_id, least(count(id), 20) AS total_hits, count(id) AS keyword_hits, 8 AS shards_queried,
  count(DISTINCT shard) AS shards_responded FROM queries q LEFT JOIN pool p ON p.query_id = q.query_id GROUP BY q.query_id""",
    "bool_must": _clause_hits("CASE WHEN i < 2 THEN 'must' ELSE 'should' END"),
    "bool_must_not": _clause_hits("CASE WHEN i = n - 1 THEN 'must_not' ELSE 'should' END"),
    "field_scoped": _clause_hits("'should'", field="field = CASE WHEN i < 3 THEN 'title' ELSE 'body' END"),
    "boosted": _clause_hits("'should'", boost="CASE WHEN i % 2 = 0 THEN 2.5 ELSE 1.0 END"),
    "phrase_match": _PHRASE,
    "phrase_gap": _with(
        *_BASE,
        *_PLACES,
        *_GAP,
        "body_places AS (SELECT * FROM places WHERE field = 'body')",
        *[part.replace("JOIN places", "JOIN body_places") for part in _PHRASE_SCORES],
        _limits(source="gaps"),
        _pool(),
    )
    + "SELECT * FROM pool",
    # Semantic and hybrid search
    "vector_normalize": "SELECT vec_id, pos, round(CAST(x AS DOUBLE), 6) AS x FROM ("
    + _unnested(
        "vec_id",
        "list_transform(embedding, lambda x: CAST(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: "
        "y::DOUBLE * y::DOUBLE))) AS FLOAT))",
        "embeddings",
    )
    + ")",
    "vector_codec": _unnested("vec_id", "embedding", "embeddings"),
    "candidate_cosine": _with(*_hybrid()[:-1])
    + "SELECT query_id, shard, id, bm25_score, semantic_score FROM candidates",
    "hybrid_rrf": _with(*_hybrid()) + "SELECT * FROM hybrid_hits",
    "hybrid_two_roots": _with(*[p.replace(_DOCS, _DOCS_OF_TWO) for p in _hybrid()]) + "SELECT * FROM hybrid_hits",
    "hybrid_weighted": _with(*_hybrid(alpha="0.3", fusion="'weighted'")) + "SELECT * FROM hybrid_hits",
    "hybrid_fallback": _with(*_MIXED) + "SELECT * FROM hybrid_hits",
    "hybrid_report": _with(*_MIXED)
    + """SELECT a.query_id, least(count(id), any_value(a.lim)) AS total_hits, count(id) AS keyword_hits, 8 AS shards_queried,
  count(DISTINCT shard) AS shards_responded, any_value(method) AS fusion_method,
  any_value(CASE WHEN method = 'weighted' THEN alpha END) AS fusion_alpha
FROM asked a LEFT JOIN candidates c ON c.query_id = a.query_id GROUP BY a.query_id""",
    "fuse_defaults": _with(*_KEYWORD)
    + """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25_score * 0.5::DOUBLE DESC,
    bm25_score DESC, id) AS INTEGER) AS "rank", id, '' AS title, bm25_score AS keyword_score, 0.0::DOUBLE AS semantic_score,
  round(0.5::DOUBLE * bm25_score, 9) AS hybrid_score, 'unknown' AS shard FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, shard, id) AS place FROM pool)
WHERE place <= 20""",
    "validate_queries": """SELECT item_id AS query_id,
  CASE item_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'q missing' WHEN 2 THEN 'q missing' WHEN 3 THEN 'limit out of range'
    WHEN 4 THEN 'limit out of range' WHEN 5 THEN 'alpha out of range' ELSE 'unknown fusion' END AS reason,
  CASE WHEN item_id % 7 = 0 THEN 20 END AS "limit", CASE WHEN item_id % 7 = 0 THEN 0.5::DOUBLE END AS alpha,
  CASE WHEN item_id % 7 = 0 THEN 'rrf' END AS fusion FROM benchmark""",
    "validate_query_ids": """SELECT query_id, CASE WHEN query_id IS NULL THEN 'query_id missing' WHEN m > 1 THEN 'query_id repeated' ELSE 'ok' END
  AS reason, count(*) AS n_rows FROM (
  SELECT *, count(*) OVER (PARTITION BY query_id) AS m FROM (
    SELECT CASE WHEN item_id % 5 <> 0 THEN item_id END AS query_id FROM benchmark
    UNION ALL SELECT item_id FROM benchmark WHERE item_id % 7 = 1)) GROUP BY ALL""",
    "limits_widened": """SELECT item_id AS query_id, CAST(item_id * 7 + 1 AS INTEGER) AS "limit",
  CAST(greatest(item_id * 7 + 1, least((item_id * 7 + 1) * 2, 200)) AS INTEGER) AS retrieval_limit FROM benchmark""",
    # Embedding
    "embed_titles": _with(_DOCS) + _embedded("id", "title", "docs"),
    "embed_missing": _with(_DOCS)
    + "SELECT id, pos, round(CAST(x AS DOUBLE), 6) AS x FROM ("
    + _unnested("id", "title_vector", "docs WHERE title_vector IS NOT NULL")
    + ") WHERE x <> 0 UNION ALL ("
    + _embedded("id", "title", "docs WHERE title_vector IS NULL")
    + ")",
    "embed_query_texts": _with(_QUERIES) + _embedded("query_id", "q", "queries"),
    "embed_dedup": _with(_DOCS)
    + "SELECT lower(trim(title)) AS text_key, 2 * count(*) AS n_texts, CAST(1 AS BIGINT) AS n_vectors FROM docs "
    "GROUP BY lower(trim(title))",
}
