"""The engine: ingest, search, answer and stats over tables below one folder. Every call works on whole tables of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import providers, rules
from textloom.functions import text as T
from textloom.functions.chunking import estimate_or_none
from textloom.operators import chunks as chunking
from textloom.operators import documents, quality, query_analysis, retrieval, sessions
from textloom.sources import sinks
from textloom.sources.sinks import Table

TOP_K_RANGE, PAGES_RANGE = (1, 20), (1, 2000)
PROMPT = "Answer the question from the official context alone.\n\nQUESTION: %s\n\nCONTEXT:\n%s"
PROMPT_GENERAL = "Answer the general question briefly.\n\nQUESTION: %s"


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: str = "hashed", generator: str = "extractive", vocabulary: str | None = None):
        """vocabulary: a byte-pair vocabulary file by which chunks' budgets count tokens; without it they are estimated by length."""
        self.tokens = providers.bpe_tokens(vocabulary) if vocabulary else estimate_or_none
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder, self.generator = embedder, generator
        keys = {"documents": "document_id", "parts": "chunk_id", "chunks": "chunk_id", "vectors": "chunk_id", "postings": "chunk_id", "doc_stats": "chunk_id", "term_stats": "term", "corpus_stats": "n_docs", "cache": "key"}
        self.tables = {name: Table(spark, f"{self.root}/{name}", key) for name, key in keys.items()}

    # ---- ingestion

    def ingest(self, pages: DataFrame, clear: bool = False, min_tokens: int = rules.GATE_TOKENS) -> dict:
        """pages(file, stem, url, depth, crawled_at, frontmatter, body) -> documents, chunks and index tables.

        A page replaces what its url had before. Only the pages' own documents are cut into chunks; the table of parts
        holds all documents' chunks before the gate, which looks at the whole again, as a chunk's twin may have come or
        gone. Uploaded chunks stay unless clear.
        """
        docs = documents.preprocessed(pages)
        known, parts, old = (None if clear else self.tables[n].read() for n in ("documents", "parts", "chunks"))
        table = self.tables["documents"]
        if known is None:
            table.replace(docs)
            made = chunking.production(table.read(), tokens=self.tokens)
        else:
            named = docs.where("url <> ''").select("url").distinct()
            kept = known.join(named, "url", "left_anti").select(known.columns)
            table.replace(sinks.merged(kept, docs, "document_id"))
            stay = sinks.without(kept, docs, "document_id").select("document_id")
            made = parts.join(stay, "document_id", "left_semi").select(parts.columns).unionByName(chunking.production(sinks.without(table.read(), stay, "document_id"), tokens=self.tokens))
        self.tables["parts"].replace(made)
        gated = quality.clean_chunks(self.tables["parts"].read()).where(F.col("token_count") >= min_tokens)
        if old is not None:
            uploads = sinks.without(old, known, "document_id")
            gated = gated.unionByName(uploads, allowMissingColumns=True)
        self.tables["chunks"].replace(gated)
        return self.reindex()

    def append_document(self, files: DataFrame) -> dict:
        """Uploaded files(path, content) as one chunk each."""
        own = chunking.uploaded(files)
        if own.where(T.trim(F.col("content")) == "").limit(1).count():
            raise ValueError("an uploaded file is empty")
        known = self.tables["chunks"].read()
        shaped = own.select("chunk_id", F.col("chunk_id").alias("document_id"), "chunk_index", "total_chunks", "title", "content", T.script_language(F.col("content")).alias("language"), T.tokens_by_chars(F.col("content")).alias("token_count"))
        if known is None:
            empty = self.spark.createDataFrame([], chunking.CHUNK_DDL)
            self.tables["chunks"].replace(empty.unionByName(shaped, allowMissingColumns=True))
        else:
            self.tables["chunks"].upsert(known.limit(0).unionByName(shaped, allowMissingColumns=True))
        return self.reindex()

    def reindex(self) -> dict:
        """Postings and statistics of all chunks, vectors of those that have none yet or changed text."""
        own = self.tables["chunks"].read()
        index = retrieval.build_index(own, "chunk_id", "content")
        for name in ("postings", "doc_stats"):
            self.tables[name].replace(index[name])
        stats, posts = self.tables["doc_stats"].read(), self.tables["postings"].read()
        self.tables["corpus_stats"].replace(retrieval.corpus_stats(stats))
        self.tables["term_stats"].replace(retrieval.term_stats(posts, self.tables["corpus_stats"].read()))
        text = quality.embeddable(own, 0).select("chunk_id", "embedding_text", "language", F.sha2("embedding_text", 256).alias("text_hash")) if "heading_chain" in own.columns else own
        old = self.tables["vectors"].read()
        fresh = text if old is None else text.join(old.select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_anti")
        self.last_embedding = quality.embedding_counts(own, 0) if "heading_chain" in own.columns else None
        made = fresh.select("chunk_id", "language", "text_hash", providers.embed(F.col("embedding_text"), self.embedder).alias("embedding"))
        if old is None:
            self.tables["vectors"].replace(made)
        else:
            kept = old.join(text.select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_semi")
            self.tables["vectors"].replace(kept.select(made.columns).unionByName(made))
        return self.stats()

    # ---- search

    def _index(self) -> dict[str, DataFrame]:
        return {n: self.tables[n].read() for n in ("postings", "doc_stats", "term_stats", "corpus_stats")}

    def _fused(self, queries: DataFrame, query: str, k: int, filtered: bool) -> DataFrame:
        """Hits of each query with chunk columns: two lists fused, urls capped."""
        own = self.tables["chunks"].read()
        vectors = self.tables["vectors"].read()
        asked = queries.select("query_id", providers.embed(F.col(query), self.embedder).alias("embedding"))
        keep = retrieval.eligible(queries, own, "chunk_id", ["office"]) if filtered else None  # before the best are chosen
        dense = retrieval.dense_top_k(asked, vectors, k, "chunk_id", keep=keep)
        sparse = retrieval.bm25_top_k(queries, own, k, "chunk_id", "content", query, self._index(), keep)
        fused = retrieval.fuse(dense, sparse, "chunk_id").join(own.select("chunk_id", "document_id", "content", "title", "url", "section"), "chunk_id")
        return retrieval.cap_per_url(fused, k)

    def search(self, queries: DataFrame, top_k: int = rules.TOP_K) -> DataFrame:
        """queries(query_id, query) -> query_id, rank, chunk_id, score, source, content, title, url, section."""
        if not TOP_K_RANGE[0] <= top_k <= TOP_K_RANGE[1]:
            raise ValueError(f"top_k lies between {TOP_K_RANGE[0]} and {TOP_K_RANGE[1]}")
        own = queries.where(T.text_or_empty(F.col("query")) != "").withColumn("retrieval_query", query_analysis.normalize(F.col("query")))
        hits = self._fused(own, "retrieval_query", retrieval.candidate_count(top_k), False)
        return hits.where(F.col("rank") <= top_k).select("query_id", "rank", "chunk_id", "score", "source", "content", "title", "url", "section")

    # ---- answers

    def answer(self, queries: DataFrame, top_k: int = rules.TOP_K) -> DataFrame:
        """queries(query_id, query, session_id) -> query_id, session_id, answer, sources, documents, mode, grounded, confidence, retrieval_query.

        Small talk and general questions are answered at once; official ones from reranked context, retried on the
        plain query where confidence is low; where it stays low the answer says that nothing could be verified.
        """
        asked = query_analysis.analyze_v2(queries).persist()
        official = asked.where(F.col("intent").isin("rag_query", "simple_fact"))
        k = max(top_k, rules.CANDIDATES)
        first = retrieval.rerank(official, self._fused(official, "retrieval_query", retrieval.candidate_count(k), True), key="chunk_id", query="retrieval_query").persist()
        sure = retrieval.confidence(official, first)
        weak = official.join(sure.where("level = 'low'").select("query_id"), "query_id", "left_semi")
        plain = weak.withColumn("retrieval_query", query_analysis.normalize(F.col("query")))
        second = retrieval.rerank(plain, self._fused(plain, "retrieval_query", retrieval.candidate_count(rules.CANDIDATES), False), key="chunk_id", query="query")
        again = retrieval.confidence(plain, second)
        final = sure.where("level <> 'low'").unionByName(again)
        hits = first.join(weak.select("query_id"), "query_id", "left_anti").unionByName(second)
        good = hits.join(final.where("level <> 'low'").select("query_id"), "query_id", "left_semi")
        own = self.tables["chunks"].read()
        placed = retrieval.expand_context(good.select("query_id", "rank", "chunk_id"), own).join(own, "chunk_id")
        links = retrieval.document_links(placed).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title", "url", "document_type"))), lambda d: F.struct(d["title"].alias("title"), d["url"].alias("url"), d["document_type"].alias("document_type"))).alias("documents"))
        told = retrieval.context(placed).join(retrieval.sources(placed), "query_id", "left").join(links, "query_id", "left")
        met = asked.join(final.select("query_id", F.col("score").alias("confidence")), "query_id", "left").join(told, "query_id", "left")
        grounded = F.col("context").isNotNull()
        prompt = F.when(grounded, F.format_string(PROMPT, "query", "context")).when(F.col("intent") == "general_knowledge", F.format_string(PROMPT_GENERAL, "query"))
        spoken = T.trim(T.text_or_empty(providers.generate(prompt, self.generator)))
        more = sessions.documents_text(F.col("language"), F.coalesce("documents", F.array().cast("array<struct<title:string,url:string,document_type:string>>")))
        verified = F.when((more == "") | spoken.contains(more), spoken).otherwise(F.concat(spoken, F.lit("\n\n"), more))
        not_verified = query_analysis.message(rules.NOT_VERIFIED, F.col("language"))
        text = F.when(F.col("intent") == "conversational", query_analysis.small_talk(F.col("query"), F.col("language"))).when(grounded, verified).when(F.col("intent") == "general_knowledge", T.first_filled(spoken, query_analysis.message(rules.DISCLAIMER, F.col("language")))).otherwise(not_verified)
        mode = F.when(F.col("intent") == "conversational", "conversational").when(grounded, "official_rag").otherwise("general_llm")
        session = "session_id" if "session_id" in queries.columns else F.lit(None).cast("string").alias("session_id")
        return met.select("query_id", "query", session, text.alias("answer"), "sources", "documents", mode.alias("mode"), grounded.alias("grounded"), "confidence", F.when(mode != "conversational", F.col("retrieval_query")).alias("retrieval_query"))

    def remember(self, answers: DataFrame) -> None:
        """Grounded answers into the cache table."""
        self.tables["cache"].upsert(_cached(answers.where("grounded")))

    def recall(self, queries: DataFrame) -> DataFrame:
        from textloom.sources.sinks import cache_lookup

        cache = self.tables["cache"].read()
        return queries.withColumn("cached", F.lit(None).cast("string")) if cache is None else cache_lookup(queries, cache, F.current_timestamp())

    def stats(self) -> dict:
        return {name: t.count() for name, t in self.tables.items() if name in ("documents", "chunks", "vectors", "postings")}

    def health(self) -> dict:
        return {"status": "ok", **self.stats()}


def _cached(answers: DataFrame) -> DataFrame:
    from textloom.sources.sinks import cached_answers

    return cached_answers(answers, F.current_timestamp())
