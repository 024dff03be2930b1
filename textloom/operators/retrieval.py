"""Hybrid retrieval over tables: BM25, cosine neighbours, rank fusion, url cap, reranking, confidence, context.

Every function answers many queries at once. Result lists are tables with query_id and a rank; ties are decided by
explicit columns, never by partition order. Scores are rounded to nine places before ranking, so that the order of a
distributed sum does not decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.functions import rules
from textloom.functions import text as T
from textloom.sources.storage import spread

Keep = Callable[[DataFrame], DataFrame]
#: rows of a batch sent on, terms that a task counts before it sends them on, entries of queries' terms that are sent to every task, scores held at once
BATCH_ROWS, HELD_TERMS, SENT_ENTRIES, HELD_SCORES = 100_000, 200_000, 200_000, 2_000_000

# ---- index tables


def admitted(docs: DataFrame, content: str = "content") -> DataFrame:
    """Documents long enough to be indexed."""
    return docs.where(F.length(T.trim(T.text_or_empty(F.col(content)))) > rules.MIN_INDEXED_CHARS)


def unique(docs: DataFrame, key: str) -> bool:
    """Whether no key stands twice. One job over the keys alone; where it holds, a document is one row and its terms need no shuffle."""
    return docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0


def _worded(docs: DataFrame, key: str, content: str) -> DataFrame:
    """key, words: a document's terms with blanks between them, which no term holds."""
    return docs.select(key, F.array_join(T.terms(F.col(content)), " ").alias("words"))


def postings(docs: DataFrame, key: str = "doc_id", content: str = "content", single: bool = False) -> DataFrame:
    """key, term, tf. single: no key stands twice, so that each row is counted by itself; otherwise the count is partial before its shuffle."""
    if not single:
        return docs.select(key, F.explode(T.terms(F.col(content))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms, counts = [], [], []
            for i, words in enumerate(b.column(1).to_pylist()):
                own = Counter(words.split())
                at.append(np.full(len(own), i))
                terms.extend(own)
                counts.extend(own.values())
                if len(terms) >= BATCH_ROWS or i == b.num_rows - 1:
                    yield pa.record_batch([b.column(0).take(pa.array(np.concatenate(at))), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], [key, "term", "tf"])
                    at, terms, counts = [], [], []

    return _worded(docs, key, content).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, term string, tf long")


def doc_stats(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """key, dl: a document's number of terms."""
    return docs.select(key, F.size(T.terms(F.col(content))).cast("long").alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl."""
    return stats.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_stats(posts: DataFrame, corpus: DataFrame) -> DataFrame:
    """term, df, idf. A negative idf is replaced by a share of the mean idf of all terms."""
    return _weighed(posts.groupBy("term").agg(F.count("*").alias("df")), corpus)


def _weighed(df: DataFrame, corpus: DataFrame) -> DataFrame:
    weight = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    raw = df.crossJoin(F.broadcast(corpus.select("n_docs"))).select("term", "df", F.when(F.col("term") > " ", weight).alias("raw")).where("raw IS NOT NULL")
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, rules.BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def term_counts(docs: DataFrame, content: str = "content") -> DataFrame:
    """term, n of documents of which each is one row: in how many a term stands. The empty term's n is the number of
    documents, that of a blank the number of all terms, so that one pass tells them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(met.keys(), pa.string()), pa.array(met.values(), pa.int64())], ["term", "n"])
            met.clear()
            return made

        for b in batches:
            for words in b.column(0).to_pylist():
                own = words.split()
                met.update(set(own))
                met[""] += 1
                met[" "] += len(own)
                if len(met) >= HELD_TERMS:
                    yield out()
        yield out()

    worded = docs.select(F.array_join(T.terms(F.col(content)), " ").alias("words"))
    return worded.mapInArrow(run, "term string NOT NULL, n long").groupBy("term").agg(F.sum("n").alias("n"))


def counted_stats(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """term_stats and corpus_stats from term_counts, by columns and not by filters, so that Spark counts once for both."""
    n, total = (F.max(F.when(F.col("term") == t, F.col("n"))) for t in ("", " "))
    corpus = counts.agg(F.coalesce(n, F.lit(0)).alias("n_docs"), (total / F.nullif(n, F.lit(0))).alias("avgdl"))
    return _weighed(counts.withColumnRenamed("n", "df"), corpus), corpus


def query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """query_id, term, qtf: repeats count."""
    return queries.select("query_id", F.explode(T.terms(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


# ---- ranking


def top_k(scored: DataFrame, k: int, order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each query; each partition keeps its own k before the shuffle."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col(rank) <= k)


def bm25_scores(queries: DataFrame, posts: DataFrame, stats: DataFrame, terms: DataFrame, corpus: DataFrame, key: str = "doc_id", query: str = "query") -> DataFrame:
    """query_id, key, score of every document that shares a term with a query.

    Query terms meet the postings by an equi-join on the term; only their postings go on, and lengths are joined to
    those alone.
    """
    wanted = query_terms(queries, query).join(terms, "term")
    hit = posts.join(wanted, "term").join(stats, key).crossJoin(F.broadcast(corpus.select("avgdl")))
    k1, b = rules.BM25_K1, rules.BM25_B
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", key).agg(F.round(F.sum(part), 9).alias("score"))


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int = rules.CANDIDATES, key: str = "doc_id", content: str = "content", query: str = "query", index: dict[str, DataFrame] | None = None, keep: Keep | None = None) -> DataFrame:
    """query_id, key, score, rank: the best k of each query, scores over zero.

    index: postings, doc_stats, term_stats and corpus_stats built before; without it docs are scored as they are read.
    keep: a filter of scored rows before the best are chosen.
    """
    if index:
        scored = bm25_scores(queries, index["postings"], index["doc_stats"], index["term_stats"], index["corpus_stats"], key, query)
    else:
        scored = bm25_of(queries, docs, key, content, query, None if keep else k)
    return top_k(keep(scored) if keep else scored, k, [F.desc("score"), F.asc(key)]).where("score > 0")


def build_index(docs: DataFrame, key: str = "doc_id", content: str = "content") -> dict[str, DataFrame]:
    return _indexed(admitted(spread(docs.select(key, content)), content), unique(docs, key), key, content)


def _indexed(own: DataFrame, single: bool, key: str, content: str) -> dict[str, DataFrame]:
    posts, stats = postings(own, key, content, single), doc_stats(own, key, content)
    if single:
        terms, corpus = counted_stats(term_counts(own, content))
    else:
        terms, corpus = term_stats(posts, corpus_stats(stats)), corpus_stats(stats)
    return {"postings": posts, "doc_stats": stats, "corpus_stats": corpus, "term_stats": terms}


def bm25_of(queries: DataFrame, docs: DataFrame, key: str = "doc_id", content: str = "content", query: str = "query", k: int | None = None) -> DataFrame:
    """query_id, key, score of every document that shares a term with a query, without an index; k: those at least that
    are among a query's best k.

    Two passes over the documents, without a shuffle of their terms: one counts all terms, one scores each document
    against all queries where it is read. The queries' terms with their weights are sent to every task; where they are
    too many for that, or a key stands more than once, an index is built and its tables are joined.
    """
    own, single = admitted(spread(docs.select(key, content)), content), unique(docs, key)
    index = _indexed(own, single, key, content)
    wanted = query_terms(queries, query).join(index["term_stats"], "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    entries = wanted.crossJoin(F.broadcast(index["corpus_stats"].select("avgdl"))).limit(SENT_ENTRIES + 1).collect() if single else []
    if not single or len(entries) > SENT_ENTRIES:
        return bm25_scores(queries, index["postings"], index["doc_stats"], index["term_stats"], index["corpus_stats"], key, query)
    ids = list(dict.fromkeys(e["query_id"] for e in entries))
    number, at = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(dict.fromkeys(e["term"] for e in entries))}
    entries.sort(key=lambda e: at[e["term"]])
    of = np.array([number[e["query_id"]] for e in entries], np.int64)
    weight = np.array([e["weight"] for e in entries])
    ends = np.cumsum(np.bincount([at[e["term"]] for e in entries], minlength=len(at))) if at else np.zeros(0, np.int64)
    avgdl, wide, k1, b = entries[0]["avgdl"] if entries else 1.0, max(len(ids), 1), rules.BM25_K1, rules.BM25_B
    firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if at else ends
    of_type, held = to_arrow_type(queries.schema["query_id"].dataType), max(1, HELD_SCORES // wide)

    def scored(keys: pa.Array, found: list[list[int]], sizes: list[int]) -> pa.RecordBatch:
        n = len(found)
        doc = np.repeat(np.arange(n), [len(f) for f in found])
        code, tf = np.unique(doc * len(at) + np.fromiter(chain.from_iterable(found), np.int64, len(doc)), return_counts=True)
        doc, term = np.divmod(code, max(len(at), 1))
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.array(sizes, float)[doc] / avgdl))
        many, score, met = ends[term] - firsts[term], np.zeros(n * wide), np.zeros(n * wide, bool)
        upto = np.cumsum(many)
        start = 0
        while start < len(term):  # some terms' queries at a time
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + HELD_SCORES, "right")))
            m = many[start:stop]
            spot = np.arange(m.sum()) + np.repeat(firsts[term[start:stop]] - (np.cumsum(m) - m), m)
            place = np.repeat(doc[start:stop] * wide, m) + of[spot]
            score += np.bincount(place, weight[spot] * np.repeat(part[start:stop], m), n * wide)
            met[place] = True
            start = stop
        if k is not None:  # what rounding to nine places may tie with the k-th stays
            met &= score > 0
            if n > k:
                table = np.where(met, score, 0.0).reshape(n, wide)
                met &= (table >= np.partition(table, n - k, axis=0)[n - k] - 2e-9).ravel()
        rows = np.flatnonzero(met)
        asked = pa.array(ids, of_type).take(pa.array(rows % wide))
        return pa.record_batch([asked, keys.take(pa.array(rows // wide)), pa.array(score[rows])], ["query_id", key, "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            for first in range(0, batch.num_rows, held):
                found, sizes = [], []
                for text in words.slice(first, held).to_pylist():
                    own = text.split()
                    found.append([at[w] for w in own if w in at])
                    sizes.append(len(own))
                made = scored(batch.column(0).slice(first, held), found, sizes)
                for at_row in range(0, made.num_rows, BATCH_ROWS):
                    yield made.slice(at_row, BATCH_ROWS)

    kinds = [f"`{n}` {t.simpleString()}" for n, t in (("query_id", queries.schema["query_id"].dataType), (key, docs.schema[key].dataType))]
    made = _worded(own, key, content).mapInArrow(run, ", ".join([*kinds, "score double"]))
    return made.select("query_id", key, F.round("score", 9).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_scores(queries: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, key, score for each query vector and each vector: a stated set of queries, sent to every task, against
    all rows, whose norms are computed once and which stay dealt out. A vector of zeros has no direction and no score."""
    q = queries.select("query_id", F.struct(F.col("embedding").alias("v"), norm(F.col("embedding")).alias("n")).alias("asked")).where("asked.n > 0")
    v = spread(vectors).select(F.col(key), F.struct(F.col("embedding").alias("v"), norm(F.col("embedding")).alias("n")).alias("held")).where("held.n > 0")
    return v.join(F.broadcast(q)).select("query_id", key, F.round(dot(F.col("held.v"), F.col("asked.v")) / (F.col("held.n") * F.col("asked.n")), 9).alias("score"))


def eligible(queries: DataFrame, rows: DataFrame, key: str, names: list[str]) -> Keep:
    """A filter of scored(query_id, key, score) before the best are chosen: queries(query_id, filters) are maps of wanted
    values, rows(key, ...) have the columns. A filter holds where its query states it and rows have its column."""
    held = [n for n in names if n in rows.columns]
    wanted = queries.select("query_id", F.struct(*[F.col("filters")[n].alias(n) for n in held]).alias("wanted")) if held else None

    def keep(scored: DataFrame) -> DataFrame:
        if wanted is None:
            return scored
        known = rows.select(key, F.struct(*held).alias("known"))
        fits = [F.col("wanted")[n].isNull() | F.coalesce(F.col("wanted")[n] == F.col("known")[n], F.lit(False)) for n in held]
        met = scored.join(wanted, "query_id").join(known, key)
        return met.where(reduce(Column.__and__, fits)).drop("wanted", "known")

    return keep


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = rules.CANDIDATES, key: str = "doc_id", filters: dict[str, str] | None = None, floor: float | None = None, keep: Keep | None = None) -> DataFrame:
    """query_id, key, score, rank by cosine. filters: equalities on columns that vectors have; floor: a least score;
    keep: a filter of scored rows."""
    for name, value in (filters or {}).items():
        if name in vectors.columns:
            vectors = vectors.where(F.col(name) == value)
    scored = cosine_scores(queries, vectors, key)
    scored = scored if floor is None else scored.where(F.col("score") >= floor)
    return top_k(keep(scored) if keep else scored, k, [F.desc("score"), F.asc(key)])


def candidate_count(top: int) -> int:
    return max(rules.CANDIDATES, top * rules.CANDIDATES_PER_HIT)


def fuse(dense: DataFrame, sparse: DataFrame, key: str = "doc_id", alpha: float = rules.ALPHA, rrf_k: int = rules.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: query_id, key, dense_rank, sparse_rank, score, source, rank."""
    lists = dense.select("query_id", key, F.col("rank").alias("dense_rank")).join(sparse.select("query_id", key, F.col("rank").alias("sparse_rank")), ["query_id", key], "full")
    score = F.coalesce(alpha / (rrf_k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce((1 - alpha) / (rrf_k + F.col("sparse_rank")), F.lit(0.0))
    source = F.when(F.col("sparse_rank").isNull(), rules.SOURCE_DENSE).when(F.col("dense_rank").isNull(), rules.SOURCE_SPARSE).otherwise(rules.SOURCE_BOTH)
    fused = lists.select("*", F.round(score, 9).alias("fused"), source.alias("source"))
    order = [F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank")]
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).withColumn("score", F.round("fused", 5)).drop("fused")


def cap_per_url(hits: DataFrame, k: int, most: int = rules.MAX_PER_URL, url: str = "url") -> DataFrame:
    """At most `most` hits of a url (blank urls are not counted), then the first k; ranks are counted anew."""
    within = Window.partitionBy("query_id", url).orderBy("rank")
    kept = hits.withColumn("_n", F.row_number().over(within)).where((F.col("_n") <= most) | (T.text_or_empty(F.col(url)) == "")).drop("_n")
    return top_k(kept.withColumnRenamed("rank", "_rank"), k, [F.asc("_rank")]).drop("_rank")


def with_texts(hits: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """hits with the columns of docs. The few best of each query go to the texts, which are read where they lie and not shuffled."""
    return F.broadcast(hits).join(docs, key)


def rerank(queries: DataFrame, hits: DataFrame, k: int = rules.RERANK_TOP_K, key: str = "doc_id", query: str = "query", content: str = "content", title: str = "title") -> DataFrame:
    """hits(query_id, rank, content, title) by share of the query's distinct terms in content and title."""
    own = F.array_distinct(T.terms(F.col(query)))
    share = lambda c: F.size(F.array_intersect("_terms", T.terms(c))) / F.greatest(F.size("_terms"), F.lit(1))
    met = hits.join(queries.select("query_id", own.alias("_terms")), "query_id")
    scored = met.withColumn("lexical_overlap", share(F.col(content))).withColumn("rerank_score", F.round(F.least(F.lit(1.0), 0.8 * F.col("lexical_overlap") + 0.2 * share(F.col(title))), 9))
    scored = scored.withColumn("entity_match", F.lit(0.0)).withColumnRenamed("rank", "_rank")
    return top_k(scored.drop("_terms"), k, [F.desc("rerank_score"), F.asc("_rank")]).drop("_rank")


def rerank_with(scorer: str, queries: DataFrame, hits: DataFrame, k: int = rules.RERANK_TOP_K, query: str = "query", content: str = "content") -> DataFrame:
    """hits(query_id, rank, content) by a registered scorer of pairs, such as a cross-encoder; it finds no lexical overlap."""
    from textloom.functions.providers import pair_score

    met = hits.join(queries.select("query_id", F.col(query).alias("_query")), "query_id")
    scored = met.withColumn("rerank_score", F.round(pair_score(F.col("_query"), F.col(content), scorer), 9)).drop("_query")
    scored = scored.withColumn("lexical_overlap", F.lit(0.0)).withColumn("entity_match", F.lit(0.0)).withColumnRenamed("rank", "_rank")
    return top_k(scored, k, [F.desc("rerank_score"), F.asc("_rank")]).drop("_rank")


def confidence(queries: DataFrame, reranked: DataFrame) -> DataFrame:
    """query_id, score, level, reason of every query, those without a hit too."""
    by = F.min_by
    first = reranked.groupBy("query_id").agg(
        by("rerank_score", "rank").alias("r"), by("lexical_overlap", "rank").alias("l"), by("entity_match", "rank").alias("e"), F.count("*").alias("n"), F.max(F.when(F.col("rank") == 2, F.col("rerank_score"))).alias("second")
    )
    w = rules.CONFIDENCE_WEIGHTS
    gap = F.greatest(F.lit(0.0), F.coalesce(F.col("r") - F.col("second"), F.lit(0.0)))
    total = w["rerank"] * F.col("r") + w["lexical"] * F.col("l") + w["entity"] * F.col("e") + w["support"] * F.least("n", F.lit(3)) / 3 + w["gap"] * F.least(gap * 5, F.lit(1.0))
    met = queries.select("query_id").join(first, "query_id", "left")
    scored = met.select("query_id", F.col("n").isNull().alias("_none"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(total, F.lit(0.0)))), 9).alias("score"))
    level, reason = F.lit(rules.CONFIDENCE_LEVELS[-1][1]), F.lit(rules.CONFIDENCE_LEVELS[-1][2])
    for least, name, why in rules.CONFIDENCE_LEVELS[-2::-1]:
        level, reason = F.when(F.col("score") >= least, name).otherwise(level), F.when(F.col("score") >= least, why).otherwise(reason)
    return scored.select("query_id", "score", level.alias("level"), F.when(F.col("_none"), rules.NO_CANDIDATES).otherwise(reason).alias("reason"))


# ---- context


def expand_context(primaries: DataFrame, chunks: DataFrame, most: int = rules.MAX_EXTRA_CHUNKS) -> DataFrame:
    """primaries(query_id, chunk_id, rank) and up to `most` related chunks each: parent, previous, next.

    Related chunks are of the same document and, where a section is given, of the same section. Neighbours are found by
    equi-joins; a query's short list is then walked in rank order, so that no chunk stands twice. Result: query_id,
    place, chunk_id, role.
    """
    known = chunks.select("chunk_id", "document_id", "section", *[c if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in ("parent_chunk_id", "previous_chunk_id", "next_chunk_id")])
    few = F.broadcast(primaries.select("chunk_id").distinct())  # what was found goes to the chunks, not they to it
    own = primaries.select("query_id", "rank", "chunk_id").join(known.join(few, "chunk_id", "left_semi"), "chunk_id", "left")
    asked = own.select("query_id", "rank", F.col("document_id").alias("_d"), F.col("section").alias("_s"), F.posexplode(F.array("parent_chunk_id", "previous_chunk_id", "next_chunk_id")).alias("slot", "chunk_id")).where("chunk_id <> ''")
    related = F.broadcast(asked).join(known.select("chunk_id", "document_id", "section"), "chunk_id").where((F.col("document_id") == F.col("_d")) & ((T.text_or_empty(F.col("_s")) == "") | (F.col("section") == F.col("_s"))))
    extra = related.groupBy("query_id", "rank").agg(F.array_sort(F.collect_list(F.struct("slot", "chunk_id"))).alias("extra"))
    lists = primaries.select("query_id", "rank", "chunk_id").join(extra, ["query_id", "rank"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "extra"))).alias("hits"))
    names = F.array(F.lit("parent"), F.lit("previous"), F.lit("next"))
    start = F.array().cast("array<struct<chunk_id:string,role:string>>")

    def add_extra(state, e):
        fits = (state["n"] < most) & ~F.exists(state["out"], lambda o: o["chunk_id"] == e["chunk_id"])
        put = F.concat(state["out"], F.array(F.struct(e["chunk_id"].cast("string").alias("chunk_id"), F.element_at(names, e["slot"] + 1).alias("role"))))
        return F.struct(F.when(fits, put).otherwise(state["out"]).alias("out"), (state["n"] + fits.cast("int")).alias("n"))

    def add_hit(out, hit):
        seen = F.exists(out, lambda o: o["chunk_id"] == hit["chunk_id"])
        begun = F.concat(out, F.array(F.struct(hit["chunk_id"].cast("string").alias("chunk_id"), F.lit("primary").alias("role"))))
        more = F.coalesce(hit["extra"], F.array().cast("array<struct<slot:int,chunk_id:string>>"))
        grown = F.aggregate(more, F.struct(begun.alias("out"), F.lit(0).alias("n")), add_extra, lambda s: s["out"])
        return F.when(seen, out).otherwise(grown)

    walked = lists.select("query_id", F.aggregate("hits", start, add_hit).alias("out"))
    return walked.select("query_id", F.posexplode("out").alias("place", "o")).select("query_id", "place", "o.chunk_id", "o.role")


def sources(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """query_id, sources: title, url, section and id of each distinct url, in order of place."""
    own = hits.where(T.text_or_empty(F.col("url")) != "")
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("place"))).where("_n = 1")
    listed = F.array_sort(F.collect_list(F.struct("place", "title", "url", "section", F.col(key).alias("chunk_id"))))
    return first.groupBy("query_id").agg(F.transform(listed, lambda s: F.struct(s["title"].alias("title"), s["url"].alias("url"), s["section"].alias("section"), s["chunk_id"].alias("chunk_id"))).alias("sources"))


def context(hits: DataFrame) -> DataFrame:
    """query_id, context: blocks of title, section and content, in order of place."""
    title = T.first_filled(F.col("title"), default=rules.DEFAULT_SOURCE_TITLE)
    block = F.concat(F.lit("--- "), title, F.lit(" | "), T.text_or_empty(F.col("section")), F.lit(" ---\n"), F.col("content"))
    own = hits.where(T.text_or_empty(F.col("content")) != "").select("query_id", F.struct("place", block.alias("b")).alias("s"))
    return own.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["b"]), "\n\n").alias("context"))


def document_links(hits: DataFrame, key: str = "query_id", place: str = "place") -> DataFrame:
    """key, place, title, url, document_type of the links to documents in contents and url columns; of a url the last title and the first place."""
    named = [F.col(c) for c in ("document_url", "download_url", "file_url") if c in hits.columns]
    found = F.concat(F.array_compact(F.array(*named)) if named else F.array().cast("array<string>"), F.regexp_extract_all(T.text_or_empty(F.col("content")), F.lit(rules.LINK), 0))
    title = T.first_filled(F.col("title"), default=rules.DEFAULT_SOURCE_TITLE)
    rows = hits.select(key, F.col(place).alias("_hit"), title.alias("title"), F.posexplode(found).alias("_n", "_url")).where("_url <> ''")
    rows = rows.withColumn("url", F.regexp_replace("_url", r"[.,;)\]]+$", "")).withColumn("_kind", T.url_extension(F.col("url"), [e for e, _ in rules.LINK_TYPES])).where("_kind <> ''")
    spot = F.struct("_hit", "_n")
    kept = rows.groupBy(key, "url").agg(F.min(spot).alias("_first"), F.max_by("title", spot).alias("title"), F.first("_kind").alias("_kind"))
    kinds = F.create_map(*[F.lit(x) for pair in rules.LINK_TYPES for x in pair])
    ranked = kept.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy("_first")))
    return ranked.select(key, place, "title", "url", kinds[F.col("_kind")].alias("document_type"))
