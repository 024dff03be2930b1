"""Queries of the engine's own operators over the given tables, each with the SQL that it is held against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import rules
from textloom.functions import text as T
from textloom.operators import chunks, classify, dedup, documents, quality, query_analysis, retrieval, sessions
from textloom.sources import readers, sinks
from textloom.sources.storage import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K = 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """documents as the engine names columns; a source stands for a url and a title."""
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("title"), F.col("source").alias("url"), "lang")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _fixture(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def _values(rows: list[tuple], names: str) -> str:
    def lit(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({names})"


# ---- SQL pieces

_WORD = r"[\p{L}\p{N}_]+"
_TERMS = f"regexp_extract_all(lower(coalesce(%s, '')), '{_WORD}')"
_STRIP = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"
_BM25 = rf"""
d AS (SELECT doc_id, {_TERMS % "text"} AS t FROM documents WHERE length({_STRIP % "coalesce(text, '')"}) > {rules.MIN_INDEXED_CHARS}),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
s AS (SELECT doc_id, len(t) AS dl FROM d),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM s),
r AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, c GROUP BY term),
t AS (SELECT term, df, CASE WHEN raw < 0 THEN {rules.BM25_EPSILON} * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TERMS % "text"}) AS term FROM benchmark) GROUP BY ALL),
b AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * ({rules.BM25_K1} + 1) / (tf + {rules.BM25_K1} * (1 - {rules.BM25_B} + {rules.BM25_B} * dl / avgdl))), 9) AS score
      FROM q JOIN t USING (term) JOIN p USING (term) JOIN s USING (doc_id), c GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b) WHERE rank <= %d AND score > 0)"""
_DENSE = """
v AS (SELECT q.item_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], f.embedding::DOUBLE[]), 9) AS score
      FROM benchmark q JOIN embeddings f ON f.vec_id = q.item_id, embeddings e),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v) WHERE rank <= %d)"""
_FUSED = f"""
l AS (SELECT coalesce(d1.query_id, s1.query_id) AS query_id, coalesce(d1.doc_id, s1.doc_id) AS doc_id, d1.rank AS dense_rank, s1.rank AS sparse_rank
      FROM dense d1 FULL JOIN sparse s1 ON d1.query_id = s1.query_id AND d1.doc_id = s1.doc_id),
g AS (SELECT *, coalesce({rules.ALPHA} / ({rules.RRF_K} + dense_rank), 0) + coalesce((1 - {rules.ALPHA}) / ({rules.RRF_K} + sparse_rank), 0) AS raw FROM l),
fused AS (SELECT query_id, doc_id, dense_rank, sparse_rank, round(raw, 5) AS score,
      CASE WHEN sparse_rank IS NULL THEN '{rules.SOURCE_DENSE}' WHEN dense_rank IS NULL THEN '{rules.SOURCE_SPARSE}' ELSE '{rules.SOURCE_BOTH}' END AS source,
      row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rank FROM g)"""
_RERANK = f"""
h AS (SELECT s.query_id, s.doc_id, s.rank, list_distinct({_TERMS % "q.text"}) AS qt, {_TERMS % "d.text"} AS ct, {_TERMS % "d.source"} AS tt
      FROM sparse s JOIN benchmark q ON q.item_id = s.query_id JOIN documents d ON d.doc_id = s.doc_id),
o AS (SELECT *, len(list_intersect(qt, ct)) / greatest(len(qt), 1) AS lexical_overlap, len(list_intersect(qt, tt)) / greatest(len(qt), 1) AS ov FROM h),
w AS (SELECT query_id, doc_id, lexical_overlap, round(least(1, 0.8 * lexical_overlap + 0.2 * ov), 9) AS rerank_score, rank FROM o),
rr AS (SELECT * EXCLUDE (rank), rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rn FROM w) WHERE rn <= {rules.RERANK_TOP_K})"""


# ---- BM25


@query(f"WITH {_BM25 % K} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM sparse")
def bm25_topk(spark, sf):
    hits = retrieval.bm25_top_k(_asked(spark, sf), _docs(spark, sf), K)
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25 % K} SELECT query_id, count(*) AS n, round(sum(score), 3) AS total FROM b GROUP BY query_id")
def bm25_scores(spark, sf):
    scored = retrieval.bm25_of(_asked(spark, sf), _docs(spark, sf))
    return scored.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total"))


@query(f"WITH {_BM25 % K} SELECT doc_id, term, tf FROM p")
def postings(spark, sf):
    return retrieval.build_index(_docs(spark, sf))["postings"]


_TERM_STATS = f"""WITH d AS (SELECT doc_id, {_TERMS % "text"} AS t FROM documents WHERE length({_STRIP % "coalesce(text, '')"}) > {rules.MIN_INDEXED_CHARS}),
p AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM d),
r AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, df, ln((SELECT count(*) FROM d) - df + 0.5) - ln(df + 0.5) AS raw FROM r)
SELECT term, df, round(CASE WHEN raw < 0 THEN {rules.BM25_EPSILON} * avg(raw) OVER () ELSE raw END, 6) AS idf FROM w"""


@query(_TERM_STATS)
def term_stats(spark, sf):
    return retrieval.build_index(_docs(spark, sf))["term_stats"].select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25 % K} SELECT s.doc_id, s.dl, c.n AS n_docs, round(c.avgdl, 6) AS avgdl FROM s, c")
def corpus_stats(spark, sf):
    i = retrieval.build_index(_docs(spark, sf))
    return i["doc_stats"].crossJoin(F.broadcast(i["corpus_stats"])).select("doc_id", "dl", "n_docs", F.round("avgdl", 6).alias("avgdl"))


# ---- vectors, fusion, reranking


@query(f"WITH {_DENSE % K} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM dense")
def dense_topk_cosine(spark, sf):
    return _dense(spark, sf, K).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def _dense(spark, sf, k):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = table(spark, sf, "benchmark").join(vectors, F.col("item_id") == F.col("doc_id")).select(F.col("item_id").alias("query_id"), "embedding")
    return retrieval.dense_top_k(asked, vectors, k)


_FLOOR = f"SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.item_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], f.embedding::DOUBLE[]), 9) AS score FROM benchmark q JOIN embeddings f ON f.vec_id = q.item_id, embeddings e WHERE e.label = 3) WHERE score >= {rules.DENSE_SCORE_FLOOR}) WHERE rank <= {K}"


@query(_FLOOR)
def dense_filtered_floor(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    asked = table(spark, sf, "benchmark").join(vectors, F.col("item_id") == F.col("doc_id")).select(F.col("item_id").alias("query_id"), "embedding")
    return retrieval.dense_top_k(asked, vectors, K, filters={"label": 3, "absent": "x"}, floor=rules.DENSE_SCORE_FLOOR).select("query_id", "doc_id", "rank")


def _fused(spark, sf):
    return retrieval.fuse(_dense(spark, sf, rules.CANDIDATES), retrieval.bm25_top_k(_asked(spark, sf), _docs(spark, sf), rules.CANDIDATES))


@query(f"WITH {_BM25 % rules.CANDIDATES}, {_DENSE % rules.CANDIDATES}, {_FUSED} SELECT query_id, doc_id, dense_rank, sparse_rank, score, source, rank FROM fused")
def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "doc_id", "dense_rank", "sparse_rank", "score", "source", "rank")


_CAP = f"""SELECT query_id, doc_id, url, rank FROM (SELECT query_id, doc_id, url, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM
(SELECT f.*, d.source AS url, row_number() OVER (PARTITION BY f.query_id, d.source ORDER BY f.rank) AS n FROM fused f LEFT JOIN documents d USING (doc_id)) WHERE n <= {rules.MAX_PER_URL} OR coalesce(url, '') = '') WHERE rank <= {K}"""


@query(f"WITH {_BM25 % rules.CANDIDATES}, {_DENSE % rules.CANDIDATES}, {_FUSED} {_CAP}")
def url_cap(spark, sf):
    hits = _fused(spark, sf).join(_docs(spark, sf).select("doc_id", "url"), "doc_id", "left")
    return retrieval.cap_per_url(hits, K).select("query_id", "doc_id", "url", "rank")


def _reranked(spark, sf):
    asked, docs = _asked(spark, sf), _docs(spark, sf)
    hits = retrieval.with_texts(retrieval.bm25_top_k(asked, docs, rules.CANDIDATES), docs.select("doc_id", "content", "title"))
    return asked, retrieval.rerank(asked, hits)


@query(f"WITH {_BM25 % rules.CANDIDATES}, {_RERANK} SELECT query_id, doc_id, rank, round(lexical_overlap, 6) AS lexical_overlap, round(rerank_score, 6) AS rerank_score FROM rr")
def lexical_rerank(spark, sf):
    return _reranked(spark, sf)[1].select("query_id", "doc_id", "rank", F.round("lexical_overlap", 6).alias("lexical_overlap"), F.round("rerank_score", 6).alias("rerank_score"))


_GATE = """, k AS (SELECT query_id, arg_min(rerank_score, rank) AS r, arg_min(lexical_overlap, rank) AS lx, count(*) AS n, max(CASE WHEN rank = 2 THEN rerank_score END) AS second FROM rr GROUP BY query_id),
z AS (SELECT q.item_id AS query_id, n, round(greatest(0, least(1, coalesce(0.55 * r + 0.20 * lx + 0.05 * least(n, 3) / 3 + 0.05 * least(greatest(0, coalesce(r - second, 0)) * 5, 1), 0))), 9) AS s FROM benchmark q LEFT JOIN k ON k.query_id = q.item_id)
SELECT query_id, round(s, 6) AS score, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.45 THEN 'medium' ELSE 'low' END AS level,
CASE WHEN n IS NULL THEN 'no_candidates' WHEN s >= 0.7 THEN 'strong_retrieval_evidence' WHEN s >= 0.45 THEN 'retrieval_needs_confirmation' ELSE 'insufficient_retrieval_evidence' END AS reason FROM z"""


@query(f"WITH {_BM25 % rules.CANDIDATES}, {_RERANK}{_GATE}")
def confidence_gate(spark, sf):
    asked, hits = _reranked(spark, sf)
    return retrieval.confidence(asked, hits).select("query_id", F.round("score", 6).alias("score"), "level", "reason")


_CONTEXT = f"""WITH {_BM25 % 5} SELECT s.query_id, md5(string_agg('--- ' || d.source || ' |  ---' || chr(10) || d.text, chr(10) || chr(10) ORDER BY s.rank)) AS digest,
list_aggregate(list_distinct(list(d.source)), 'count') AS n_sources FROM sparse s JOIN documents d USING (doc_id) GROUP BY s.query_id"""


@query(_CONTEXT)
def context_string(spark, sf):
    docs = _docs(spark, sf).withColumn("section", F.lit(""))
    found = checkpointed(retrieval.bm25_top_k(_asked(spark, sf), docs, 5).withColumn("place", F.col("rank")).drop("score", "rank"))
    hits = retrieval.with_texts(found, docs)
    told = retrieval.context(hits).join(retrieval.sources(hits, "doc_id"), "query_id")
    return told.select("query_id", F.md5("context").alias("digest"), F.size("sources").cast("long").alias("n_sources"))


_EXPANDED = f"""WITH RECURSIVE {(_BM25 % 5).replace("FROM documents", "FROM (SELECT conv_id || '-' || turn AS doc_id, text FROM conversations)")},
near AS (SELECT conv_id || '-' || turn AS doc_id, lag(conv_id || '-' || turn) OVER o AS before, lead(conv_id || '-' || turn) OVER o AS after FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
step AS (SELECT query_id, 3 * (rank - 1) AS k, doc_id AS c, 'primary' AS role FROM sparse UNION ALL SELECT query_id, 3 * (rank - 1) + 1, before, 'previous' FROM sparse JOIN near USING (doc_id)
UNION ALL SELECT query_id, 3 * (rank - 1) + 2, after, 'next' FROM sparse JOIN near USING (doc_id)),
walked AS (SELECT query_id, k, [c] AS ids, ['primary'] AS roles, false AS skipped, 0 AS n FROM step WHERE k = 0
UNION ALL SELECT query_id, k, CASE WHEN takes THEN list_append(ids, c) ELSE ids END, CASE WHEN takes THEN list_append(roles, role) ELSE roles END, CASE WHEN k % 3 = 0 THEN NOT takes ELSE skipped END, CASE WHEN k % 3 = 0 THEN 0 WHEN takes THEN n + 1 ELSE n END
FROM (SELECT s.query_id, s.k, s.c, s.role, w.ids, w.roles, w.skipped, w.n, s.c IS NOT NULL AND NOT list_contains(w.ids, s.c) AND (s.k % 3 = 0 OR (NOT w.skipped AND w.n < {rules.MAX_EXTRA_CHUNKS})) AS takes FROM walked w JOIN step s ON s.query_id = w.query_id AND s.k = w.k + 1)),
whole AS (SELECT query_id, ids, roles FROM walked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC) = 1)
SELECT query_id, CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS place, unnest(ids) AS chunk_id, unnest(roles) AS role FROM whole"""


@query(_EXPANDED)
def context_expansion(spark, sf):
    turns = _turns(spark, sf)
    asked = _asked(spark, sf)
    hits = checkpointed(retrieval.bm25_top_k(asked, turns, 5, "chunk_id").select("query_id", "chunk_id", "rank"))
    return retrieval.expand_context(hits, turns)


# ---- text functions

_METRICS = rf"""SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS word_count, length(text) AS char_count,
greatest(1, length(text) // 4) AS tokens_by_chars, CAST(floor(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) * 1.3 + 1e-9) AS INTEGER) AS tokens_by_words,
CASE WHEN text = '' THEN 'unknown' ELSE 'en' END AS language, false AS bengali, sha256(text) AS content_hash, len(regexp_extract_all(text, '\n\|')) AS n_tables FROM documents"""


@query(_METRICS)
def text_metrics(spark, sf):
    c = F.col("content")
    return _docs(spark, sf).select("doc_id", T.word_count(c).alias("word_count"), F.length(c).alias("char_count"), T.tokens_by_chars(c).alias("tokens_by_chars"), T.tokens_by_words(c).alias("tokens_by_words"), T.detect_language(c).alias("language"), T.contains_bengali(c).alias("bengali"), T.content_hash(c).alias("content_hash"), T.markdown_table_count(c).alias("n_tables"))


_IDS = r"""SELECT page_id, left(lower(trim(regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g'), '_')), 100) || '__' || left(md5(url), 8) AS document_id,
left(lower(trim(regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g'), '_')), 160) || '__' || left(md5(url), 8) AS url_slug,
url || '__chunk_' || CASE WHEN length(page_id::VARCHAR) < 4 THEN lpad(page_id::VARCHAR, 4, '0') ELSE page_id::VARCHAR END AS chunk_id,
md5(url || '::' || page_id) AS url_chunk_id, sha256(url) AS vector_id, 'rag:answer:' || sha256(lower(url)) AS cache_key FROM pages"""


@query(_IDS)
def ids(spark, sf):
    u, n = F.col("url"), F.col("page_id")
    return table(spark, sf, "pages").select("page_id", T.document_id(u, F.lit("")).alias("document_id"), T.url_slug(u).alias("url_slug"), T.chunk_id(u, n).alias("chunk_id"), T.url_chunk_id(u, n).alias("url_chunk_id"), T.vector_id(u).alias("vector_id"), T.cache_key(u).alias("cache_key"))


_URLS = rf"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS domain,
lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) IN ({", ".join(f"'{h}'" for h in rules.TRUSTED_HOSTS)}) OR lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) LIKE '%{rules.TRUSTED_SUFFIX}' AS trusted,
round(({" + ".join(f"contains(lower(url), '{w}')::INT" for w in rules.PRIORITY_WORDS)}) / {len(rules.PRIORITY_WORDS)} * {rules.PRIORITY_WEIGHT}, 9) AS priority FROM pages"""


@query(_URLS)
def url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.url_domain(u).alias("domain"), T.trusted_host(u).alias("trusted"), F.round(T.crawl_priority(u), 9).alias("priority"))


URLS = [
    (1, "https://westtripura.nic.in/form/a.PDF?x=1#p"), (2, "http://www.cdn.s3waas.gov.in/s3/b.docx"), (3, "https://x.s3waas.gov.in/c.xlsx"), (4, "https://drive.google.com/file/d/AB12/view"),
    (5, "https://drive.google.com/open?id=Z9"), (6, "https://example.com/list.csv"), (7, "https://westtripura.nic.in/gallery/x.html"), (8, "https://example.com/notice"),
]
_LINKS = f"""SELECT id, CASE WHEN p LIKE '%.pdf' THEN '.pdf' WHEN p LIKE '%.docx' THEN '.docx' WHEN p LIKE '%.doc' THEN '.doc' WHEN p LIKE '%.xlsx' THEN '.xlsx' WHEN p LIKE '%.xls' THEN '.xls' WHEN p LIKE '%.csv' THEN '.csv' WHEN p LIKE '%.txt' THEN '.txt' ELSE '' END AS extension,
CASE WHEN p LIKE '%.pdf' THEN 'pdf' WHEN p LIKE '%.doc' OR p LIKE '%.docx' THEN 'docx' WHEN p LIKE '%.xls' OR p LIKE '%.xlsx' THEN 'xlsx' END AS kind,
h IN ({", ".join(f"'{x}'" for x in rules.TRUSTED_HOSTS)}) OR h LIKE '%{rules.TRUSTED_SUFFIX}' AS trusted,
CASE id WHEN 4 THEN 'https://drive.usercontent.google.com/download?id=AB12&export=download&confirm=t' WHEN 5 THEN 'https://drive.usercontent.google.com/download?id=Z9&export=download&confirm=t' ELSE url END AS download
FROM (SELECT id, url, lower(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)) AS p, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS h FROM {_values(URLS, "id, url")})"""


@query(_LINKS)
def link_kinds(spark, sf):
    u = F.col("url")
    return _fixture(spark, URLS, "id int, url string").select("id", T.asset_extension(u).alias("extension"), T.document_kind(u).alias("kind"), T.trusted_host(u).alias("trusted"), T.drive_download(u).alias("download"))


_NORMAL = rf"""SELECT doc_id, md5({_STRIP % "regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')"}) AS digest FROM documents"""


@query(_NORMAL)
def normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.normalize_text(F.col("content"))).alias("digest"))


_CLEAN = rf"""SELECT doc_id, md5({_STRIP % "regexp_replace(array_to_string(list_transform(string_split(regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '\\s+$', ''), '[ \\t]{2,}', ' ', 'g')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')"}) AS digest FROM documents""".replace("\\\\", "\\")


@query(_CLEAN)
def clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.clean_text(F.col("content"))).alias("digest"))


_EMBED = rf"""SELECT doc_id, md5(source || chr(10) || chr(10) || lang || CASE WHEN k = '' THEN '' ELSE chr(10) || chr(10) || k END) AS digest FROM (SELECT *, CASE WHEN length(c) <= {rules.EMBED_CHARS} THEN c WHEN strpos(h, ' ') > 0 AND length(h) - strpos(reverse(h), ' ') > {rules.EMBED_CHARS * rules.EMBED_SPACE_SHARE} THEN left(h, length(h) - strpos(reverse(h), ' ')) ELSE h END AS k
FROM (SELECT doc_id, source, lang, c, left(c, {rules.EMBED_CHARS}) AS h FROM (SELECT doc_id, source, lang, {_STRIP % (r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _STRIP % "text" + r", '!\[.*?\]\(.*?\)', '', 'g'), '<img[^>]*>', '', 'gi'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g')")} AS c FROM documents)))"""


@query(_EMBED)
def embedding_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.embedding_text(F.array("source"), F.col("lang"), F.col("text"))).alias("digest"))


_HTML = r"""SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<![^>]*>', chr(10), 'g'), '(?s)<[/!a-zA-Z][^>]*>', chr(10), 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))) AS digest FROM pages"""


@query(_HTML)
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("digest"))


_ANCHORS = r"""SELECT page_id, count(*) AS n_links, md5(string_agg(DISTINCT u, ' ' ORDER BY u)) AS digest FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || h AS u FROM
(SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages) WHERE h LIKE '/%') GROUP BY page_id"""


@query(_ANCHORS)
def link_discovery(spark, sf):
    found = readers.anchors(table(spark, sf, "pages"))
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"), F.md5(F.array_join(F.array_sort(F.collect_set("url")), " ")).alias("digest"))


def _glob(glob: str) -> str:
    return f"regexp_full_match(url, '{readers.T.glob_pattern(glob)}')"


_FRONTIER = rf"""WITH a AS (SELECT DISTINCT 'https://{rules.SITE}' || regexp_replace(h, '#.*$', '') AS url FROM (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages) WHERE h LIKE '/%'),
o AS (SELECT url, round(({" + ".join(f"contains(lower(url), '{w}')::INT" for w in rules.PRIORITY_WORDS)}) / {len(rules.PRIORITY_WORDS)} * {rules.PRIORITY_WEIGHT}, 9) AS score FROM a WHERE url NOT IN (SELECT url FROM pages) AND NOT ({" OR ".join(_glob(g) for g in rules.LOW_VALUE_URLS)}))
SELECT url, 1 AS depth, score FROM o ORDER BY score DESC, url LIMIT {rules.MAX_PAGES}"""


@query(_FRONTIER)
def crawl_frontier(spark, sf):
    pages = table(spark, sf, "pages")
    links = readers.anchors(pages).select(F.regexp_replace("url", r"^https?://[^/]+", f"https://{rules.SITE}").alias("url")).withColumn("depth", F.lit(1))
    return readers.frontier(links, pages.select("url"))


FRONT = [
    (1, "---\nurl: https://a.b/c\ndepth: 2\ntitle: \"A: b\"\n---\n# Head\nbody"), (2, "no frontmatter\n## Second"), (3, "---\nbroken"), (4, "---\nurl: 'x'\nurl: y\nnocolon\n---\n\n  body  \n"),
]
_FRONT = f"""SELECT id, CASE id WHEN 1 THEN 'https://a.b/c' WHEN 4 THEN 'y' ELSE '' END AS url, CASE id WHEN 1 THEN 2 ELSE 0 END AS depth,
CASE id WHEN 1 THEN 'A: b' ELSE '' END AS title, CASE id WHEN 1 THEN '# Head' || chr(10) || 'body' WHEN 4 THEN 'body' ELSE raw END AS body,
CASE id WHEN 1 THEN 'Head' WHEN 2 THEN 'Second' ELSE 'some stem' END AS heading FROM {_values(FRONT, "id, raw")}"""


@query(_FRONT)
def frontmatter_parse(spark, sf):
    front = readers.with_frontmatter(_fixture(spark, FRONT, "id int, raw string"))
    return front.select("id", "url", "depth", F.coalesce(F.try_element_at("frontmatter", F.lit("title")), F.lit("")).alias("title"), "body", T.heading_title(F.col("body"), F.lit("some_stem")).alias("heading"))


LINKED = [
    (1, 0, "Form", "see https://a.b/x.pdf, and (https://a.b/y.docx)."), (1, 1, "", "again https://a.b/x.pdf; none https://a.b/z.html"), (2, 0, "List", "http://c.d/e.XLSX?v=2"), (3, 0, "None", "no link"),
]
_DOCLINKS = _values([(1, 1, "West Tripura document", "https://a.b/x.pdf", "PDF"), (1, 2, "Form", "https://a.b/y.docx", "DOCX"), (2, 1, "List", "http://c.d/e.XLSX?v=2", "XLSX")], "query_id, place, title, url, document_type")


@query(f"SELECT * FROM {_DOCLINKS}")
def document_links(spark, sf):
    return retrieval.document_links(_fixture(spark, LINKED, "query_id int, place int, title string, content string"))


# ---- dedup, gates, classification


@query("SELECT doc_id, url FROM (SELECT doc_id, source AS url, row_number() OVER (PARTITION BY sha256(text) ORDER BY length(source), source, doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_hash(spark, sf):
    return dedup.by_content(_docs(spark, sf), "content").select("doc_id", "url")


@query("SELECT url, doc_id FROM (SELECT source AS url, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, lang, doc_id DESC) AS rn FROM documents) WHERE rn = 1")
def dedup_url(spark, sf):
    pages = table(spark, sf, "documents").select("doc_id", F.col("source").alias("url"), F.col("n_chars").alias("depth"), F.col("lang").alias("crawled_at"), F.col("doc_id").alias("file"))
    return dedup.by_url(pages).select("url", "doc_id")


_PREFIX = f"lower({_STRIP % f'left({_STRIP % "text"}, {rules.PREFIX_CHARS})'})"


@query(f"SELECT doc_id FROM (SELECT doc_id, {_PREFIX} AS p, row_number() OVER (PARTITION BY {_PREFIX} ORDER BY greatest(1, length(text) // 4) DESC, doc_id) AS rn FROM documents) WHERE rn = 1 AND p <> ''")
def dedup_prefix(spark, sf):
    return dedup.by_prefix(_docs(spark, sf).withColumn("token_count", T.tokens_by_chars(F.col("content"))), order="doc_id").select("doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_first_seen(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return dedup.first_seen([d.where("lang = 'fr'"), d.where("lang = 'de'"), d], "source", "doc_id").select("source", "doc_id")


_GREEDY = """WITH RECURSIVE d AS (SELECT doc_id, concat_ws('/', source, lang, n_chars) AS url, sha256(text) AS hash, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
w AS (SELECT n, doc_id, url, hash, true AS ok, [url] AS urls, [hash] AS hashes FROM d WHERE n = 1
UNION ALL SELECT n, doc_id, url, hash, ok, CASE WHEN ok THEN list_append(urls, url) ELSE urls END, CASE WHEN ok THEN list_append(hashes, hash) ELSE hashes END
FROM (SELECT d.*, w.urls, w.hashes, NOT list_contains(w.hashes, d.hash) AND NOT (d.url <> '' AND list_contains(w.urls, d.url)) AS ok FROM w JOIN d ON d.n = w.n + 1))
SELECT url, hash, doc_id FROM w WHERE ok"""


@query(_GREEDY)
def dedup_greedy(spark, sf):
    d = table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang", "n_chars").alias("url"), F.sha2("text", 256).alias("hash"), "doc_id")
    return dedup.greedy(d, "doc_id")


def _case(column: str, rules_: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}', 'i') THEN '{name}'" for name, p in rules_) + " END"


_CATEGORY = f"coalesce({_case('url', rules.URL_CATEGORIES)}, {_case('title', rules.URL_CATEGORIES)}, {_case(f'left(content, {rules.CLASSIFIED_CHARS})', rules.CONTENT_CATEGORIES)}, 'general')"
_CLASSED = f"SELECT key, {_CATEGORY} AS category FROM (SELECT 'p' || page_id AS key, url, '' AS title, '' AS content FROM pages UNION ALL SELECT 'd' || doc_id, '', source, text FROM documents)"


def _classed(spark, sf):
    pages = table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("key"), "url", F.lit("").alias("title"), F.lit("").alias("content"))
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), F.lit("").alias("url"), F.col("source").alias("title"), F.col("text").alias("content"))
    both = pages.unionByName(docs)
    return both.select("key", classify.category(F.col("url"), F.col("title"), F.col("content")).alias("category"))


@query(_CLASSED)
def classify_documents(spark, sf):
    return _classed(spark, sf)


@query(f"SELECT category, count(*) AS n FROM ({_CLASSED}) GROUP BY category")
def category_counts(spark, sf):
    return classify.counts(_classed(spark, sf))


def _gated(spark, sf):
    d = _docs(spark, sf)
    c = F.col("content")
    return d.select(F.col("doc_id").alias("chunk_id"), "content", "title", T.tokens_by_chars(c).alias("token_count"), c.contains("|").alias("has_table"), c.contains("!").alias("has_list"))


_JUDGED = rf"""WITH k AS (SELECT doc_id AS chunk_id, {_STRIP % "text"} AS c, greatest(1, length(text) // 4) AS tok, contains(text, '|') AND contains(text, '!') AS crowded FROM documents),
j AS (SELECT *, CASE WHEN tok < {rules.GATE_TOKENS} THEN 'too_small' WHEN {" OR ".join(f"contains(lower(c), '{w}')" for w in rules.ERROR_WORDS)} THEN 'error_pages'
WHEN crowded AND tok < {rules.MENU_TOKENS} AND len(regexp_extract_all(c, '\[')) > len(regexp_extract_all(c, '[.।]')) THEN 'navigation' END AS own FROM k),
u AS (SELECT *, row_number() OVER (PARTITION BY sha256(c) ORDER BY chunk_id) AS rn FROM j WHERE own IS NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY lower({_STRIP % f"left(c, {rules.PREFIX_CHARS})"}) ORDER BY tok DESC, chunk_id) AS pn FROM u WHERE rn = 1)
SELECT chunk_id, own AS reason FROM j WHERE own IS NOT NULL UNION ALL SELECT chunk_id, 'exact_dupes' FROM u WHERE rn > 1 UNION ALL SELECT chunk_id, CASE WHEN pn > 1 THEN 'near_dupes' ELSE 'clean' END FROM n"""


@query(_JUDGED)
def chunk_gate(spark, sf):
    return quality.judged_chunks(_gated(spark, sf)).select("chunk_id", F.coalesce("reason", F.lit("clean")).alias("reason"))


@query(f"SELECT reason, count(*) AS n FROM ({_JUDGED}) GROUP BY reason")
def chunk_gate_report(spark, sf):
    return quality.report(quality.judged_chunks(_gated(spark, sf)))


@query(r"SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) >= CASE WHEN lang = 'en' THEN 10 ELSE 5 END")
def near_empty(spark, sf):
    docs = _docs(spark, sf).withColumn("source_type", F.when(F.col("lang") == "en", "html").otherwise("md"))
    return quality.enough_words(docs).select("doc_id")


# ---- query analysis

ASKED = [
    (1, "DM office phone number"), (2, "hello there"), (3, "how do i apply for a birth certificate"), (4, "tell me a joke"), (5, "pension scheme in Tripura"), (6, "ki kora lagbe"),
    (7, ""), (8, "thanks"), (9, "where is the sdm office of the block development officer in the old town of Agartala near market"), (10, "list of holidays"), (11, "okay"), (12, "BDO and DM contact"), (13, "what is ai"),
]


def _like(column: str, source: str) -> str:
    return f"regexp_matches({column}, '{source}', 'i')"


def _ascii(source: str) -> str:
    """Alternatives without Bengali: RE2 has no word edges that see it, and the fixture holds none."""
    parts = [p for p in source.replace("|\\b(নম্বর|ফোন|যোগাযোগ|ঠিকানা|কোথায়|কে)\\b", "").split("|") if all(ord(c) < 128 for c in p) or ")" in p]
    joined = "|".join("".join(c for c in p if ord(c) < 128) for p in parts)
    return joined.replace("||", "|").replace("|)", ")")


_N = "trim(query)"
for _p, _r in rules.ABBREVIATIONS:
    _N = f"regexp_replace({_N}, '{_p}', '{_r}', 'gi')"
_N = f"(SELECT trim(CASE WHEN contains(lower(n), 'tripura') THEN n ELSE n || ' West Tripura' END) FROM (SELECT {_N} AS n))"
_INTENT = f"""CASE WHEN query = '' OR {_like("query", _ascii(rules.GREETING))} OR {_like("query", _ascii(rules.THANKS))} OR lower(query) IN ('ok', 'okay', 'bye') THEN 'conversational'
WHEN {_like("query", rules.GENERAL)} THEN 'general_knowledge' WHEN {_like("query", _ascii(rules.SIMPLE_FACT))} AND len(list_filter(string_split(query, ' '), lambda x: x <> '')) <= 12 THEN 'simple_fact' ELSE 'rag_query' END"""
_LANG = f"CASE WHEN len(list_intersect(regexp_extract_all(lower(query), '[a-z]+'), [{', '.join(f"'{w}'" for w in rules.ROMANISED)}])) > 0 THEN 'bn_en' ELSE 'en' END"
_OFFICE = "CASE " + " ".join(f"WHEN {_like('query', _ascii(p))} THEN '{n}'" for n, p in rules.OFFICES) + " END"
_TOPIC2 = "CASE " + " ".join(f"WHEN {_like('query', _ascii(p))} THEN '{n}'" for n, p in rules.TOPICS_V2) + " END"
_ALL = f"(SELECT * FROM {_values(ASKED, 'query_id, query')} UNION ALL SELECT 1000 + item_id, text FROM benchmark)"
_ANALYSED = f"""SELECT query_id, language, intent, topic, office, trim(concat_ws(' ', n, office, topic, CASE WHEN topic = 'procedure' THEN '{rules.PROCEDURE_EXPANSION}' END)) AS retrieval_query
FROM (SELECT query_id, {_LANG} AS language, {_INTENT} AS intent, {_TOPIC2} AS topic, {_OFFICE} AS office, {_N} AS n FROM {_ALL})"""


def _all_asked(spark, sf):
    return _fixture(spark, ASKED, "query_id long, query string").unionByName(_asked(spark, sf).withColumn("query_id", F.col("query_id") + 1000))


@query(_ANALYSED)
def query_analysis_v2(spark, sf):
    found = query_analysis.analyze_v2(_all_asked(spark, sf))
    return found.select("query_id", "language", "intent", "topic", F.try_element_at("entities", F.lit(1)).alias("office"), "retrieval_query")


_V1 = [f"CASE WHEN {_like('query', _ascii(p))} THEN '{n}' END" for n, p in rules.OFFICES]
_TOPIC1 = "CASE " + " ".join(f"WHEN {_like('query', _ascii(p))} THEN '{n}'" for n, p in rules.TOPICS_V1) + " END"


@query(f"SELECT query_id, concat_ws(',', {', '.join(_V1)}) AS entities, coalesce({', '.join(_V1[::-1])}) AS office, {_TOPIC1} AS topic FROM {_ALL}")
def query_analysis_v1(spark, sf):
    found = query_analysis.analyze_v1(_all_asked(spark, sf))
    return found.select("query_id", F.array_join("entities", ",").alias("entities"), F.try_element_at("filters", F.lit("office")).alias("office"), "topic")


# ---- chunk relations, sessions


def _turns(spark, sf):
    """conversations as chunks of documents."""
    t = table(spark, sf, "conversations")
    own = t.select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("title"), F.lit("").alias("section"), F.col("text").alias("content"), F.concat(F.lit("c"), "conv_id").alias("url"))
    return chunks.linked(own)


@query("""SELECT conv_id || '-' || turn AS chunk_id, conv_id AS document_id, row_number() OVER w - 1 AS chunk_index, lag(conv_id || '-' || turn) OVER w AS previous_chunk_id, lead(conv_id || '-' || turn) OVER w AS next_chunk_id,
count(*) OVER (PARTITION BY conv_id) AS total_chunks FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def chunk_links(spark, sf):
    return _turns(spark, sf).select("chunk_id", "document_id", "chunk_index", "previous_chunk_id", "next_chunk_id", "total_chunks")


@query("""SELECT md5('c' || conv_id || '::' || (n - 1)) AS chunk_id, conv_id AS document_id, n - 1 AS chunk_index, n AS total_chunks, role AS section, 'top' AS sub_section, 2 AS heading_depth, 'en' AS language
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)""")
def chunk_enrichment(spark, sf):
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.concat(F.lit("c"), "conv_id").alias("url"), F.col("turn").alias("place"), F.array(F.lit("top"), F.col("role")).alias("heading_chain"), "text")
    return chunks.enriched(t).drop("url", "text")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def session_history(spark, sf):
    return sessions.last_turns(table(spark, sf, "conversations"), key="conv_id").select("conv_id", "turn", "role")


@query(f"""SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= {rules.SESSION_TTL * 1_000_000} THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_windows(spark, sf):
    return sessions.session_windows(table(spark, sf, "events"), "user_id")


_RATE = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, n, [t] AS held, true AS allowed, 0 AS retry_after FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, n, CASE WHEN len(h) < %d THEN list_append(h, t) ELSE h END, len(h) < %d, CASE WHEN len(h) < %d THEN 0 ELSE CAST((h[1] + %d - t) // 1000000 + 1 AS INTEGER) END
FROM (SELECT e.*, list_filter(w.held, lambda x: x > e.t - %d) AS h FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT user_id, event_id, allowed, retry_after FROM w"""
BUSY = 5, 6 * 3600  # requests and seconds at which the given events are refused now and then


@query(_RATE % (BUSY[0], BUSY[0], BUSY[0], BUSY[1] * 1_000_000, BUSY[1] * 1_000_000))
def rate_limit(spark, sf):
    return sessions.rate_limited(table(spark, sf, "events"), "user_id", limit=BUSY[0], window=BUSY[1])


@query(_RATE % (rules.RATE_LIMIT, rules.RATE_LIMIT, rules.RATE_LIMIT, rules.RATE_WINDOW * 1_000_000, rules.RATE_WINDOW * 1_000_000))
def rate_limit_as_served(spark, sf):
    return sessions.rate_limited(table(spark, sf, "events"), "user_id")


# ---- joins, merges, summaries


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def manifest_left_join(spark, sf):
    return documents.with_manifest(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


@query("SELECT DISTINCT doc_id AS url FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti_join(spark, sf):
    named = lambda n: table(spark, sf, n).select(F.col("doc_id").alias("url"))
    return documents.pending(named("documents"), named("labels"))


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def reusable_semi_join(spark, sf):
    named = lambda n: table(spark, sf, n).select(F.col("doc_id").alias("url"))
    return documents.reusable(named("documents"), named("labels"))[0].select(F.col("url").alias("doc_id"))


@query("SELECT doc_id, quality, CASE WHEN quality = 0 THEN 7 ELSE toxic END AS toxic FROM labels UNION ALL SELECT doc_id, 9, 9 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def keyed_merge(spark, sf):
    old = table(spark, sf, "labels")
    kind = old.schema["quality"].dataType
    changed = old.where("quality = 0").withColumn("toxic", F.lit(7).cast(old.schema["toxic"].dataType))
    added = table(spark, sf, "documents").select("doc_id", F.lit(9).cast(kind).alias("quality"), F.lit(9).cast(old.schema["toxic"].dataType).alias("toxic"))
    known = old.unionByName(added.join(old.select("doc_id"), "doc_id", "left_anti"))
    return sinks.merged(known, changed, "doc_id")


@query("SELECT vec_id, CASE WHEN label = 3 THEN 30 ELSE label END AS label FROM embeddings WHERE label <> 5")
def vector_upsert_delete(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    merged = sinks.merged(e, e.where("label = 3").withColumn("label", F.lit(30).cast(e.schema["label"].dataType)), "vec_id")
    return sinks.without(merged, e.where("label = 5"), "vec_id")


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'vectors', count(*) FROM embeddings")
def corpus_health(spark, sf):
    return documents.corpus_health({"documents": table(spark, sf, "documents"), "pages": table(spark, sf, "pages"), "vectors": table(spark, sf, "embeddings")})


@query("SELECT lang AS language, count(*) AS n, count(*) FILTER (contains(text, '|')) AS with_tables FROM documents GROUP BY lang")
def language_counts(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("language"), F.col("text").contains("|").alias("has_table"))
    return documents.languages(d)


# ---- parsers and chunkers. The SQL walks lines, sentences or windows by recursion, each step from the state before it.


def _documents(spark, sf):
    return _docs(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("document_id"), "title", "url", F.col("lang").alias("language"), "content")


# The given documents are plain lines; parsers get them with marks set before and after, in turn, by line and document.
MARKS = [
    ("# ", ""), ("", ""), ("", ""), ("- ", ""), ("  more ", ""), ("", ""), ("| ", " | b |"), None, ("| c | ", " |"), ("1. ", ""), ("", ""), ("### ", ""), ("```", None), ("- code ", ""), ("```py", None),
    ("", ""), ("---", None), ("* ", ""), ("|", "|"), ("#### ", ""), ("", None), ("> ", ""), ("##### ", ""), ("##", ""), ("i. ", ""), ("", ""), ("", None), ("## ", " ##"),
]
_RULE = "|---|:-:|"


def _marked(spark, sf):
    def mark(line, i):
        turn = F.pmod(i + F.col("doc_id"), F.lit(len(MARKS)))
        out = F.lit(None).cast("string")
        for k, m in enumerate(MARKS):
            text = F.lit(_RULE) if m is None else F.lit(m[0]) if m[1] is None else F.concat(F.lit(m[0]), line, F.lit(m[1]))
            out = F.when(turn == k, text).otherwise(out)
        return out

    d = _docs(spark, sf).withColumn("content", F.array_join(F.transform(F.split("content", "\n"), mark), "\n"))
    return d.select(F.concat(F.lit("d"), "doc_id").alias("document_id"), "title", "url", F.col("lang").alias("language"), "content")


_MARK = "CASE (i - 1 + doc_id) % " + str(len(MARKS)) + " " + " ".join(f"WHEN {k} THEN " + (f"'{_RULE}'" if m is None else f"'{m[0]}'" if m[1] is None else f"'{m[0]}' || x || '{m[1]}'") for k, m in enumerate(MARKS)) + " END"
_LINED = f"l AS (SELECT * FROM (SELECT 'd' || doc_id AS key, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {_MARK})) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS lines FROM documents) WHERE x <> '' OR n < lines)"
_BLOCKS = rf"""WITH RECURSIVE {_LINED},
k AS (SELECT *, CASE WHEN regexp_full_match(x, '```\w*') THEN 'code' WHEN regexp_full_match(x, '#{{1,6}}\s+.+') THEN 'heading' WHEN regexp_full_match(x, '[-*_]{{3,}}') THEN 'divider' WHEN regexp_full_match(x, '\s*\|.+\|\s*') THEN 'table'
WHEN regexp_matches(x, '^\s*([-*+]|\d+[.)])\s+') THEN 'list' WHEN trim(x) <> '' THEN 'paragraph' ELSE 'blank' END AS kind FROM l),
s AS (SELECT key, n, x, kind, kind AS block, 1 AS id, kind IN ('code', 'table', 'list', 'paragraph') AS open, false AS closes FROM k WHERE n = 1
UNION ALL SELECT key, n, x, kind, CASE WHEN stays THEN block ELSE kind END, CASE WHEN stays THEN id ELSE id + 1 END, CASE WHEN stays THEN NOT shut ELSE kind IN ('code', 'table', 'list', 'paragraph') END, stays AND shut
FROM (SELECT k.*, s.block, s.id, s.open AND s.block = 'code' AND k.kind = 'code' AS shut,
s.open AND (s.block = 'code' OR (s.block = 'table' AND k.kind = 'table') OR (s.block = 'paragraph' AND k.kind = 'paragraph') OR (s.block = 'list' AND (starts_with(k.x, '  ') OR regexp_matches(k.x, '^\s*([-*+]|\d+[.)])\s+')))) AS stays
FROM s JOIN k ON k.key = s.key AND k.n = s.n + 1)),
b AS (SELECT key, id, first(block) AS type, min(n) AS n1, string_agg(x, chr(10) ORDER BY n) FILTER (NOT closes) AS body, count(*) FILTER (NOT closes) AS size, count(*) FILTER (kind = 'list') AS items,
count(*) FILTER (NOT regexp_full_match(x, '\s*\|[\s|:\-]+\|\s*')) AS data, arg_min(x, n) AS x FROM s WHERE block <> 'blank' GROUP BY key, id)
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY n1) - 1 AS INTEGER) AS position, type, md5(CASE WHEN type = 'code' THEN body || CASE WHEN size = 1 THEN chr(10) ELSE '' END || chr(10) || '```' ELSE body END) AS digest,
CASE WHEN type = 'heading' THEN length(regexp_extract(x, '^(#+)', 1)) ELSE 0 END AS level, CASE WHEN type = 'table' THEN greatest(data - 1, 0) ELSE 0 END AS n_rows, CASE WHEN type = 'list' THEN items ELSE 0 END AS n_items FROM b"""


@query(_BLOCKS)
def block_parse(spark, sf):
    return chunks.blocks(_marked(spark, sf)).select("key", "position", "type", F.md5("text").alias("digest"), "level", F.size("rows").alias("n_rows"), F.size("items").alias("n_items"))


_SECTIONS = rf"""WITH {_LINED},
k AS (SELECT *, CASE WHEN length(regexp_extract(trim(x), '^(#+)\s', 1)) BETWEEN 1 AND 4 THEN length(regexp_extract(trim(x), '^(#+)\s', 1)) END AS level, starts_with(trim(x), '|') AND ends_with(trim(x), '|') AS tab,
regexp_matches(trim(x), '^([-*+]\s|\d+[.)]\s)') OR regexp_matches(lower(trim(x)), '^[ivxlcdm]+[.)]\s') AS item FROM l),
c AS (SELECT key, n, x, CASE WHEN level IS NOT NULL THEN 'heading' WHEN tab THEN 'table' WHEN item THEN 'list' ELSE 'text' END AS kind, level FROM k),
r AS (SELECT *, sum((kind = 'heading')::INT) OVER o AS part, sum((kind = 'table' AND coalesce(lag_kind, '') <> 'table')::INT) OVER o AS seg, sum((kind = 'list' AND coalesce(lag_kind, '') <> 'list')::INT) OVER o AS run
FROM (SELECT *, lag(kind) OVER (PARTITION BY key ORDER BY n) AS lag_kind FROM c) WINDOW o AS (PARTITION BY key ORDER BY n)),
piece AS (SELECT key, part, seg, CASE kind WHEN 'table' THEN 0 WHEN 'list' THEN 1 ELSE 2 END AS turn, CASE kind WHEN 'text' THEN 'paragraph' ELSE kind END AS kind, min(n) AS n1,
CASE WHEN kind = 'text' THEN regexp_replace(string_agg(x, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') ELSE string_agg(x, chr(10) ORDER BY n) END AS body FROM r WHERE kind <> 'heading' GROUP BY key, part, seg, kind, CASE WHEN kind = 'list' THEN run END),
whole AS (SELECT key, part, string_agg(kind, ',' ORDER BY seg, turn, n1) AS types, md5(string_agg(body, chr(31) ORDER BY seg, turn, n1)) AS digest FROM piece WHERE body <> '' GROUP BY key, part),
h AS (SELECT key, part, level, regexp_replace(regexp_replace(x, '^#+\s+', ''), '^\s+|\s+$', '', 'g') AS name FROM r WHERE kind = 'heading'),
chain AS (SELECT w.key, w.part, string_agg(a.name, ' > ' ORDER BY a.part) AS chain FROM (SELECT key, part FROM whole) w JOIN h a ON a.key = w.key AND a.part <= w.part
WHERE NOT EXISTS (SELECT 1 FROM h z WHERE z.key = w.key AND z.part > a.part AND z.part <= w.part AND z.level <= a.level) GROUP BY w.key, w.part)
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY part) - 1 AS INTEGER) AS place, coalesce(chain, '') AS chain, types, digest FROM whole LEFT JOIN chain USING (key, part)"""


@query(_SECTIONS)
def heading_sections(spark, sf):
    found = chunks.sections(_marked(spark, sf))
    return found.select("key", "place", F.array_join("heading_chain", " > ").alias("chain"), F.array_join("types", ",").alias("types"), F.md5(F.array_join("texts", "\x1f")).alias("digest"))


_ITEM = r"^\s*([-*+]|\d+[.)])\s+"
_TREE = rf"""WITH RECURSIVE {_LINED},
k AS (SELECT key, n, x, CASE WHEN regexp_full_match(x, '```\w*') THEN 'code' WHEN regexp_full_match(x, '#{{1,6}}\s+.+') THEN 'heading' WHEN regexp_full_match(x, '[-*_]{{3,}}') THEN 'none'
WHEN regexp_matches(x, '{_ITEM}') AND NOT regexp_full_match(x, '\s*\|.+\|\s*') THEN 'list' WHEN regexp_matches(x, '^\s*>') THEN 'quote' WHEN trim(x) <> '' THEN 'text' ELSE 'none' END AS kind FROM l),
s AS (SELECT key, n, x, kind, kind AS block, 1 AS id, kind NOT IN ('heading', 'none') AS open, false AS closes FROM k WHERE n = 1
UNION ALL SELECT key, n, x, kind, CASE WHEN stays THEN block ELSE kind END, CASE WHEN stays THEN id ELSE id + 1 END, CASE WHEN stays THEN NOT shut ELSE kind NOT IN ('heading', 'none') END, stays AND shut
FROM (SELECT k.*, s.block, s.id, s.open AND s.block = 'code' AND k.kind = 'code' AS shut,
s.open AND (s.block = 'code' OR (s.block IN ('text', 'quote') AND k.kind = s.block) OR (s.block = 'list' AND (k.kind = 'list' OR starts_with(k.x, '  ')))) AS stays FROM s JOIN k ON k.key = s.key AND k.n = s.n + 1)),
b AS (SELECT key, id, min(n) AS n1, first(block) AS block, list(x ORDER BY n) FILTER (NOT closes) AS own FROM s WHERE block <> 'none' GROUP BY key, id),
o AS (SELECT key, n1, 0 AS j, CASE block WHEN 'code' THEN 'code_block' WHEN 'quote' THEN 'blockquote' WHEN 'list' THEN 'list' ELSE 'paragraph' END AS type,
array_to_string(CASE block WHEN 'code' THEN own[2:] WHEN 'quote' THEN list_transform(own, lambda x: regexp_replace(x, '^\s*>\s?', '')) ELSE own END, chr(10)) AS text FROM b WHERE block <> 'heading'
UNION ALL SELECT key, n1, 1, 'paragraph', array_to_string(list_transform(own, lambda x: regexp_replace(x, '^\s*>\s?', '')), chr(10)) FROM b WHERE block = 'quote'
UNION ALL SELECT key, n1, j, 'paragraph', x FROM (SELECT key, n1, unnest(own) AS raw, generate_subscripts(own, 1) AS j, regexp_replace(regexp_replace(raw, '^\s*[-*+\d.]+\s+', ''), '^\s+|\s+$', '', 'g') AS x FROM b WHERE block = 'list') WHERE x <> ''),
h AS (SELECT key, n1, length(regexp_extract(own[1], '^(#+)', 1)) AS level, regexp_replace(regexp_replace(regexp_replace(own[1], '^#+\s+', ''), '\s+$', ''), '\s+#+$', '') AS name FROM b WHERE block = 'heading'),
chain AS (SELECT p.key, p.n1, string_agg(a.name, ' > ' ORDER BY a.n1) AS chain FROM (SELECT DISTINCT key, n1 FROM o) p JOIN h a ON a.key = p.key AND a.n1 < p.n1
WHERE NOT EXISTS (SELECT 1 FROM h z WHERE z.key = p.key AND z.n1 > a.n1 AND z.n1 < p.n1 AND z.level <= a.level) GROUP BY p.key, p.n1)
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY n1, j) - 1 AS INTEGER) AS place, coalesce(chain, '') AS chain, type, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM o LEFT JOIN chain USING (key, n1)"""


@query(_TREE)
def document_tree(spark, sf):
    return chunks.tree(_marked(spark, sf)).select("key", "place", F.array_join("heading_chain", " > ").alias("chain"), "type", "text")


@query()
def production_chunks(spark, sf):
    return chunks.production(_documents(spark, sf))


@query()
def word_chunks(spark, sf):
    return chunks.by_words(_documents(spark, sf))


@query()
def section_chunks(spark, sf):
    return chunks.by_section(_documents(spark, sf))


@query()
def semantic_chunks(spark, sf):
    return chunks.semantic(_documents(spark, sf))


def _last(mark: str) -> str:
    """Place from 0 of the last `mark` in win, or null."""
    return f"CASE WHEN strpos(reverse(win), '{mark[::-1]}') > 0 THEN length(win) - strpos(reverse(win), '{mark[::-1]}') - {len(mark) - 1} END".replace("\n", "' || chr(10) || '")


_HALF = rules.FIXED_CHARS // 2
_SHORT = rf"{_STRIP % 'x'}"
_FIXED = rf"""WITH RECURSIVE d AS (SELECT * FROM (SELECT 'd' || doc_id AS key, {_STRIP % f"regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: length({_SHORT}) >= 3 OR {_SHORT} = ''), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')"} AS t FROM documents) WHERE length(t) >= {rules.FIXED_LEAST_CHARS}),
w AS (SELECT key, 0 AS start, 0 AS stop, '' AS piece, 0 AS k FROM d
UNION ALL SELECT key, CASE WHEN stop - {rules.FIXED_OVERLAP} > start THEN stop - {rules.FIXED_OVERLAP} ELSE stop END, stop, substr(t, start + 1, stop - start), k + 1 FROM
(SELECT *, start + CASE WHEN start + {rules.FIXED_CHARS} >= length(t) THEN length(t) - start WHEN p0 > 0 THEN p0 + 2 WHEN p1 > {_HALF} THEN p1 + 2 WHEN p2 > {_HALF} THEN p2 + 2 WHEN p3 > {_HALF} THEN p3 + 2 WHEN p4 > {_HALF} THEN p4 + 1 WHEN p5 > 0 THEN p5 ELSE {rules.FIXED_CHARS} END AS stop
FROM (SELECT *, {", ".join(f"{_last(m)} AS p{i}" for i, m in enumerate([chr(10) * 2, ". ", "! ", "? ", chr(10), " "]))} FROM
(SELECT w.key, w.start, w.k, d.t, substr(d.t, w.start + 1, {rules.FIXED_CHARS}) AS win FROM w JOIN d USING (key) WHERE w.start < length(d.t))))),
p AS (SELECT key, k, {_STRIP % "piece"} AS text FROM w WHERE k > 0),
n AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY key) AS total, text FROM p WHERE text <> '')
SELECT key, CAST(i AS INTEGER) AS chunk_index, CAST(total AS INTEGER) AS total_chunks, text, md5(key || '::' || i) AS chunk_id, length(text) AS char_count FROM n"""


@query(_FIXED)
def fixed_chunks(spark, sf):
    return chunks.fixed(_documents(spark, sf), "document_id")


_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace(%s, '([.!?।])\s+', '\1' || chr(1), 'g'), '\n\n+', chr(1), 'g'), chr(1)), lambda x: {_SHORT}), lambda x: x <> '')"
_COUNT = "CAST(floor(len(list_filter(string_split_regex(%s, '\\s+'), lambda y: y <> '')) * 1.3 + 1e-9) AS INTEGER)"
_RUN = -(-rules.SPLIT_TARGET * 10 // int(rules.TOKENS_PER_WORD * 10))  # words of a run
_OVERLAP = rf"""WITH RECURSIVE c AS (SELECT doc_id::VARCHAR AS key, text, source, greatest(1, length(text) // 4) AS tok FROM documents),
t AS (SELECT key, {_SENTENCES % (_STRIP % "text")} AS parts FROM c WHERE tok > {rules.SPLIT_MAX}),
q AS (SELECT key, unnest(parts) AS x, generate_subscripts(parts, 1) AS a FROM t),
v AS (SELECT key, a, 0 AS b, x, {_COUNT % "x"} AS counted FROM q WHERE {_COUNT % "x"} <= {rules.SPLIT_TARGET}
UNION ALL SELECT key, a, b, array_to_string(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')[b + 1:b + {_RUN}], ' '), 0 FROM (SELECT *, unnest(range(0, len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')), {_RUN})) AS b FROM q WHERE {_COUNT % "x"} > {rules.SPLIT_TARGET})),
u AS (SELECT key, row_number() OVER o - 1 AS i, x, counted, coalesce(sum({_COUNT % "x"}) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sums FROM v WINDOW o AS (PARTITION BY key ORDER BY a, b)),
f AS (SELECT u.key, u.i, min(z.i) AS back FROM u JOIN u z ON z.key = u.key AND z.i <= u.i AND u.sums - z.sums <= {rules.SPLIT_OVERLAP} GROUP BY u.key, u.i),
g AS (SELECT u.*, f.back FROM u JOIN f USING (key, i)),
w AS (SELECT key, i, 0::BIGINT AS first, counted::HUGEINT AS filled, NULL::BIGINT AS done FROM g WHERE i = 0
UNION ALL SELECT key, i, CASE WHEN over THEN greatest(first, back) ELSE first END, CASE WHEN over THEN sums - (SELECT z.sums FROM g z WHERE z.key = y.key AND z.i = greatest(y.first, y.back)) ELSE filled END + counted, CASE WHEN over THEN first END
FROM (SELECT g.key, g.i, g.counted, g.sums, g.back, w.first, w.filled, g.counted > 0 AND w.filled + g.counted > {rules.SPLIT_TARGET} AS over FROM w JOIN g ON g.key = w.key AND g.i = w.i + 1) y),
e AS (SELECT key, done AS a, i AS z FROM w WHERE done IS NOT NULL UNION ALL (SELECT key, first, i + 1 FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1)),
p AS (SELECT e.key, e.z, string_agg(u.x, ' ' ORDER BY u.i) AS content FROM e JOIN u ON u.key = e.key AND u.i >= e.a AND u.i < e.z GROUP BY e.key, e.z),
m AS (SELECT key, content, row_number() OVER (PARTITION BY key ORDER BY z) - 1 AS k, count(*) OVER (PARTITION BY key) AS total FROM p)
SELECT key AS chunk_id, text AS content, source AS title, tok AS token_count, contains(text, '|') AS has_table, contains(text, '!') AS has_list FROM c WHERE tok <= {rules.SPLIT_MAX}
UNION ALL SELECT key || '_part_' || k, content, CASE WHEN total > 1 THEN source || ' (Part ' || (k + 1) || '/' || total || ')' ELSE source END, {_COUNT % "content"}, contains(text, '|'), contains(text, '!') FROM m JOIN c USING (key)"""


@query(_OVERLAP)
def overlap_split(spark, sf):
    d = _gated(spark, sf).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    return chunks.split_large(d)


@query(f"SELECT doc_id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS place FROM (SELECT doc_id, {_SENTENCES % 'text'} AS s FROM documents)")
def sentence_split(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("content"))).alias("place", "sentence"))


@query()
def clean_pages(spark, sf):
    c = F.col("content")
    return _docs(spark, sf).select("doc_id", F.md5(T.clean_page(c)).alias("page"), F.md5(T.clean_document(c)).alias("document"), F.md5(T.clean_for_chunks(c)).alias("chunks"), F.md5(T.drop_short_lines(c)).alias("lines"))


@query()
def canonical_documents(spark, sf):
    pages = table(spark, sf, "pages").select(F.lit("html").alias("source_type"), F.col("page_id").cast("string").alias("stem"), "url", F.lit("").alias("title"), T.html_text(F.col("html")).alias("content"))
    docs = table(spark, sf, "documents").select(F.lit("md").alias("source_type"), F.col("doc_id").cast("string").alias("stem"), F.concat_ws("/", "source", "lang", "n_chars").alias("url"), F.col("source").alias("title"), F.col("text").alias("content"))
    none = {"depth": "int", "score": "double", "crawled_at": "string", "page_count": "int", "parser_used": "string"}
    both = pages.unionByName(docs).select("*", *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    return documents.canonical(both)
