"""Documents from pages and extracted files: joins with manifests and metadata, canonical records, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import classify, dedup, quality


def with_manifest(pages: DataFrame, manifest: DataFrame, key: str = "url") -> DataFrame:
    """pages with the manifest's columns that they lack; left equi-join, the small side sent to all if Spark finds it small."""
    more = [c for c in manifest.columns if c == key or c not in pages.columns]
    return pages.join(manifest.select(*more), key, "left")


def with_metadata(docs: DataFrame, files: DataFrame, prefer_file: bool, key: str = "stem") -> DataFrame:
    """Maps of metadata merged on the stem: the file's entries hold for markdown, the document's own for JSON."""
    empty = F.create_map().cast("map<string,string>")
    own, other = F.coalesce("metadata", empty), F.coalesce("_file", empty)
    first, second = (other, own) if prefer_file else (own, other)
    merged = F.map_concat(F.map_filter(second, lambda k, v: ~F.map_contains_key(first, k)), first)
    return docs.join(files.select(key, F.col("metadata").alias("_file")), key, "left").withColumn("metadata", merged).drop("_file")


def pending(urls: DataFrame, manifest: DataFrame) -> DataFrame:
    """Urls that the manifest doesn't have."""
    return urls.select("url").distinct().join(manifest.select("url"), "url", "left_anti")


def reusable(links: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets of links that are there already, and links still to fetch."""
    return assets.join(links.select("url").distinct(), "url", "left_semi"), links.join(assets.select("url"), "url", "left_anti")


def orphans(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Files whose doc_id is not kept."""
    return files.join(kept.select("doc_id").distinct(), "doc_id", "left_anti")


def cleaned(pages: DataFrame) -> DataFrame:
    """Records of usable pages: ids, title, domain, content, lengths, category."""
    own = quality.usable_pages(pages)
    title = F.initcap(F.replace(F.element_at(F.split("stem", "__"), 1), F.lit("_"), F.lit(" ")))
    shaped = own.select(
        T.url_slug(F.col("url")).alias("doc_id"), title.alias("title"), "url", T.url_domain(F.col("url")).alias("domain"), "depth", F.col("score").cast("int").alias("score"), "crawled_at",
        F.col("file").alias("file"), "clean_content", F.length("body").alias("raw_char_count"), F.length("clean_content").alias("clean_char_count"),
    )
    return shaped.withColumn("category", classify.category(F.col("url"), F.col("title"), F.col("clean_content")))


def preprocessed(pages: DataFrame, whole_file: bool = False) -> DataFrame:
    """Documents of markdown pages: noise out, ids, title, language, hash. The greedy url and hash rule decides what stays.

    whole_file: hash and inspect the frontmatter too, as the body alone otherwise.
    """
    content = T.clean_document(F.col("body"))
    front = F.concat(F.lit("---\n"), F.array_join(F.transform(F.filter(F.map_entries("frontmatter"), lambda e: e["value"] != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"), F.lit("\n---\n"))
    own = pages.withColumn("content", F.concat(front, content) if whole_file else content).where(T.trim(F.col("content")) != "")
    own = own.withColumn("content_hash", T.content_hash(F.col("content")))
    keep = dedup.greedy(own.select("url", F.col("content_hash").alias("hash"), "file"), "file").select("file")
    return own.join(keep, "file", "left_semi").select(
        T.preprocessed_id(F.col("url"), F.col("stem"), F.col("content_hash")).alias("document_id"), F.col("file").alias("source_path"), "url", "depth", "crawled_at",
        T.heading_title(F.col("content"), F.col("stem")).alias("title"), "content", T.detect_language(F.col("content")).alias("language"), "content_hash",
    )


def canonical(sources: DataFrame) -> DataFrame:
    """sources(source_type, stem, url, title, content, depth, score, crawled_at, page_count, parser_used) as canonical documents.

    html comes before markdown, that before JSON; the first of an id holds, and only then do short documents go.
    """
    rank = F.when(F.col("source_type") == "html", 0).when(F.col("source_type") == "md", 1).otherwise(2)
    own = sources.withColumn("content", T.clean_text(F.col("content"))).withColumn("document_id", T.document_id(F.col("url"), F.col("stem")))
    first = dedup.first_of(own, ["document_id"], [rank, F.col("stem")])
    return quality.enough_words(first).select(
        "document_id", "source_type", T.first_filled(F.col("title"), default="").alias("title"), "url", "content",
        F.struct(
            F.col("url").alias("source_url"), T.url_domain(F.col("url")).alias("source_domain"), T.detect_language(F.col("content")).alias("language"), T.word_count(F.col("content")).alias("word_count"),
            "page_count", T.markdown_table_count(F.col("content")).alias("table_count"), T.content_hash(F.col("content")).alias("content_hash"), F.col("crawled_at").alias("crawl_date"), "parser_used", "depth", "score",
        ).alias("metadata"),
    )


def extract_record(files: DataFrame) -> DataFrame:
    """Manifest records of extracted files(url, text, content bytes, seconds, parser, pages)."""
    name = F.element_at(F.split(T.url_part(F.col("url"), "PATH"), "/"), -1)
    return files.select(
        T.extract_base_name(F.col("url")).alias("id"), "url", name.alias("file_name"), T.document_kind(F.col("url")).alias("content_type"),
        F.when(T.text_or_empty(F.col("text")) == "", "failed").otherwise("success").alias("extraction_status"), F.col("seconds").alias("extraction_time_s"), F.col("parser").alias("parser_used"),
        T.word_count(F.col("text")).alias("word_count"), F.col("pages").alias("page_count"), T.markdown_table_count(F.col("text")).alias("tables"),
        F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("file_size_bytes"),
    )


def summary(docs: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """One row: documents, chunks, chunks for each document to one place, mean tokens to two, chunks with tables and lists."""
    made = chunks.agg(F.count("*").alias("chunks"), F.round(F.avg("token_count"), 2).alias("average_tokens"), F.count_if("has_table").alias("chunks_with_tables"), F.count_if("has_list").alias("chunks_with_lists"))
    return docs.agg(F.count("*").alias("documents")).join(made).withColumn("chunks_per_document", F.round(F.col("chunks") / F.greatest("documents", F.lit(1)), 1))


def document_index(docs: DataFrame) -> DataFrame:
    """What an index of canonical documents holds: their ids, urls, titles, types and word counts."""
    return docs.select(*[c for c in ("document_id", "url", "title", "source_type", "file", "word_count") if c in docs.columns])


def chunk_index(chunks: DataFrame) -> DataFrame:
    """What an index of word-budget chunks holds."""
    return chunks.select("chunk_id", "document_id", "heading", "title", "url", "word_count")


def languages(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("language").agg(F.count("*").alias("n"), F.count_if("has_table").alias("with_tables"))


def corpus_health(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
