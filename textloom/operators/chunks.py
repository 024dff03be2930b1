"""Chunk tables: each strategy of `textloom.functions.chunking` over a table of documents.

The work of a document is a walk over its lines, which no built-in expresses; it runs in Arrow batches, without a
shuffle, and rows go out as they are made. Ids, neighbours and counts follow from a document's chunks alone, so they
are set in the same pass. Blocks, headings and sentences that built-ins can express are Columns in `functions.text`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import chunking as C
from textloom.functions import markdown as M
from textloom.functions import rules
from textloom.functions import text as T
from textloom.sources.storage import release, spread

#: rows and bytes of text of a batch sent on, and documents read at once
BATCH_ROWS, BATCH_BYTES, READ_ROWS = 1000, 4 << 20, 256


def per_document(docs: DataFrame, make: Callable[..., Iterable[tuple]], columns: list[str], schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows that `make` yields for each document's columns. Few documents and rows are held at once, whatever Spark's own
    batches hold, and at a task's end its worker gives memory back."""

    def own(b: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(0, b.num_rows, READ_ROWS):
            part = b.slice(at, READ_ROWS)
            for values in zip(*(part.column(c).to_pylist() for c in columns), strict=True):
                yield from make(*values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                held, size = [], 0
                for row in own(b):
                    held.append(row)
                    size += sum(len(v) for v in row if isinstance(v, str))
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield _batch(schema, held)
                        held, size = [], 0
                if held:
                    yield _batch(schema, held)
        finally:
            release()

    return docs.select(*columns).mapInArrow(run, ddl)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_S, _I, _B, _L = pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string())
_CHUNK = pa.schema([("chunk_id", _S), ("document_id", _S), ("chunk_index", _I), ("total_chunks", _I), ("previous_chunk_id", _S), ("next_chunk_id", _S), ("title", _S), ("url", _S), ("heading_chain", _L), ("section", _S), ("sub_section", _S), ("content", _S), ("language", _S), ("token_count", _I), ("character_count", _I), ("has_table", _B), ("has_list", _B), ("sha256", _S)])
CHUNK_DDL = "chunk_id string, document_id string, chunk_index int, total_chunks int, previous_chunk_id string, next_chunk_id string, title string, url string, heading_chain array<string>, section string, sub_section string, content string, language string, token_count int, character_count int, has_table boolean, has_list boolean, sha256 string"


def _rows(document: str, title: str | None, url: str | None, language: str | None, chunks: list[C.Chunk]) -> Iterator[tuple]:
    ids = [f"{document}__chunk_{i:04d}" for i in range(len(chunks))]
    for i, c in enumerate(chunks):
        before, after = ids[i - 1] if i else "", ids[i + 1] if i + 1 < len(ids) else ""
        yield (ids[i], document, i, len(chunks), before, after, title or "", url or "", c.chain, c.section, c.sub_section, c.text, language or "", c.tokens, len(c.text), c.has_table, c.has_list, c.sha256)


_DOC = ["document_id", "title", "url", "language", "content"]


def production(docs: DataFrame, target: int = rules.TARGET_TOKENS, most: int = rules.MAX_TOKENS, least: int = rules.MIN_TOKENS, tokens: C.Tokens = C.estimate_or_none) -> DataFrame:
    """Chunks along the heading hierarchy of cleaned documents: docs(document_id, title, url, language, content)."""
    budget = C.Budget(target, most, least, tokens)
    cleaned = spread(docs).withColumn("content", T.clean_for_chunks(F.col("content")))

    def make(d, title, url, language, text):  # short texts go here, where a filter would clean them a second time
        return _rows(d, title, url, language, C.hierarchy_of(text, title or "", budget)) if len(text) >= rules.MIN_CHUNKED_CHARS else ()

    return per_document(cleaned, make, _DOC, _CHUNK, CHUNK_DDL)


def by_section(docs: DataFrame) -> DataFrame:
    """Chunks of heading sections under their chain's line; a document without sections is one."""

    def make(d, title, url, language, text):
        parts = M.sections(M.heading_tree(text or "")) or [([title or ""], [("paragraph", text or "")])]
        return _rows(d, title, url, language, C.section_chunks(parts))

    return per_document(docs, make, _DOC, _CHUNK, CHUNK_DDL)


def semantic(docs: DataFrame, least: int = rules.SEMANTIC_MIN_TOKENS) -> DataFrame:
    """Paragraph runs and single blocks of the document tree."""
    make = lambda d, title, url, language, text: _rows(d, title, url, language, C.semantic_chunks(M.document_tree(text or "", title or ""), least))
    return per_document(docs, make, _DOC, _CHUNK, CHUNK_DDL)


_WORDS = pa.schema([("chunk_id", _S), ("document_id", _S), ("chunk_index", _I), ("title", _S), ("heading", _S), ("content", _S), ("url", _S), ("word_count", _I), ("content_hash", _S)])


def by_words(docs: DataFrame, most: int = rules.LEGACY_MAX_WORDS, least: int = rules.LEGACY_MIN_WORDS) -> DataFrame:
    """Chunks within a word budget."""
    import hashlib

    def make(d, title, url, language, text):
        for i, (heading, own) in enumerate(C.word_chunks(M.parse_blocks(text or ""), most, least)):
            yield (f"{d}__chunk_{i:04d}", d, i, title or "", heading, own, url or "", len(own.split()), hashlib.sha256(own.encode()).hexdigest())

    cleaned = docs.withColumn("content", T.clean_text(F.col("content")))
    return per_document(cleaned, make, _DOC, _WORDS, "chunk_id string, document_id string, chunk_index int, title string, heading string, content string, url string, word_count int, content_hash string")


_PIECE = pa.schema([("key", _S), ("chunk_index", _I), ("total_chunks", _I), ("text", _S)])
_PIECE_DDL = "key string, chunk_index int, total_chunks int, text string"


def _pieces(docs: DataFrame, key: str, content: str, split: Callable[[str], list[str]]) -> DataFrame:
    def make(k, text):
        parts = split(text or "")
        return [(k, i, len(parts), p) for i, p in enumerate(parts)]

    return per_document(docs.select(F.col(key).cast("string").alias("key"), F.col(content).alias("text")), make, ["key", "text"], _PIECE, _PIECE_DDL)


def fixed(docs: DataFrame, key: str = "url", content: str = "content", size: int = rules.FIXED_CHARS, overlap: int = rules.FIXED_OVERLAP) -> DataFrame:
    """Character windows: key, chunk_index, total_chunks, text, chunk_id, char_count. Short bodies have none."""
    own = spread(docs).withColumn(content, T.drop_short_lines(F.col(content))).where(F.length(content) >= rules.FIXED_LEAST_CHARS)
    parts = _pieces(own, key, content, lambda t: C.fixed_chunks(t, size, overlap))
    return parts.withColumn("chunk_id", T.url_chunk_id(F.col("key"), F.col("chunk_index"))).withColumn("char_count", F.length("text"))


def split_large(chunks: DataFrame, most: int = rules.SPLIT_MAX) -> DataFrame:
    """Chunks over `most` tokens as overlapping parts; the others as they are."""
    small, large = chunks.where(F.col("token_count") <= most), chunks.where(F.col("token_count") > most)
    parts = _pieces(large.withColumn("content", T.trim(F.col("content"))), "chunk_id", "content", C.overlap_chunks)
    named = large.drop("content", "token_count").withColumnRenamed("chunk_id", "_whole").join(parts, F.col("_whole") == F.col("key"))
    several = F.when(F.col("_total") > 1, F.concat(F.col("title"), F.lit(" (Part "), (F.col("_i") + 1).cast("string"), F.lit("/"), F.col("_total").cast("string"), F.lit(")"))).otherwise(F.col("title"))
    made = (
        named.drop("key").withColumn("_i", parts["chunk_index"]).withColumn("_total", parts["total_chunks"]).drop(parts["chunk_index"]).drop(parts["total_chunks"])
        .withColumn("chunk_id", F.concat(F.col("_whole"), F.lit("_part_"), F.col("_i").cast("string")))
        .withColumn("title", several)
        .withColumn("content", F.col("text"))
        .withColumn("token_count", T.tokens_by_words(F.col("text")))
    )
    return small.unionByName(made.select(small.columns))


_BLOCK = pa.schema([("key", _S), ("position", _I), ("type", _S), ("text", _S), ("level", _I), ("heading_text", _S), ("headers", _L), ("rows", pa.list_(_L)), ("items", _L), ("ordered", _B), ("language", _S)])


def blocks(docs: DataFrame, key: str = "document_id", content: str = "content") -> DataFrame:
    """Typed blocks of each document."""
    make = lambda k, t: ((k, b.position, b.kind, b.text, b.level, b.heading, b.headers, b.rows, b.items, b.ordered, b.language) for b in M.parse_blocks(t or ""))
    own = docs.select(F.col(key).cast("string").alias("key"), F.col(content).alias("text"))
    return per_document(own, make, ["key", "text"], _BLOCK, "key string, position int, type string, text string, level int, heading_text string, headers array<string>, rows array<array<string>>, items array<string>, ordered boolean, language string")


_SECTION = pa.schema([("key", _S), ("place", _I), ("heading_chain", _L), ("types", _L), ("texts", _L)])


def sections(docs: DataFrame, key: str = "document_id", content: str = "content") -> DataFrame:
    """Heading sections with content: chain, and types and texts of the content."""
    make = lambda k, t: ((k, i, chain, [x for x, _ in own], [x for _, x in own]) for i, (chain, own) in enumerate(M.sections(M.heading_tree(t or ""))))
    own = docs.select(F.col(key).cast("string").alias("key"), F.col(content).alias("text"))
    return per_document(own, make, ["key", "text"], _SECTION, "key string, place int, heading_chain array<string>, types array<string>, texts array<string>")


_NODE = pa.schema([("key", _S), ("place", _I), ("heading_chain", _L), ("type", _S), ("text", _S)])


def tree(docs: DataFrame, key: str = "document_id", content: str = "content") -> DataFrame:
    """Blocks of the document tree in reading order, each with its heading chain."""
    make = lambda k, t: ((k, i, chain, kind, text) for i, (chain, kind, text) in enumerate(M.tree_blocks(M.document_tree(t or ""))))
    own = docs.select(F.col(key).cast("string").alias("key"), F.col(content).alias("text"))
    return per_document(own, make, ["key", "text"], _NODE, "key string, place int, heading_chain array<string>, type string, text string")


def chat_messages(answers: DataFrame, key: str = "session_id", text: str = "answer") -> DataFrame:
    """Answers as messages of bounded length."""
    return _pieces(answers, key, text, C.chat_pieces)


# ---- chunk relations, in built-ins


def linked(chunks: DataFrame, document: str = "document_id", order: str = "chunk_index", key: str = "chunk_id") -> DataFrame:
    """chunks renumbered from 0, with previous and next ids and the document's count."""
    w = Window.partitionBy(document).orderBy(order)
    return chunks.select(
        *[c for c in chunks.columns if c not in (order, "previous_chunk_id", "next_chunk_id", "total_chunks")],
        (F.row_number().over(w) - 1).alias(order),
        F.lag(key).over(w).alias("previous_chunk_id"),
        F.lead(key).over(w).alias("next_chunk_id"),
        F.count("*").over(Window.partitionBy(document)).alias("total_chunks"),
    )


def enriched(chunks: DataFrame, order: str = "place") -> DataFrame:
    """Section names from the chain's end, depth, script language, url-based ids; total_chunks counts the chunks so far."""
    n = F.row_number().over(Window.partitionBy("document_id").orderBy(order))
    chain = F.coalesce("heading_chain", F.array().cast("array<string>"))
    return chunks.select(
        T.url_chunk_id(F.col("url"), n - 1).alias("chunk_id"), "document_id", "url", (n - 1).alias("chunk_index"), n.alias("total_chunks"),
        F.coalesce(F.try_element_at(chain, F.lit(-1)), F.lit("")).alias("section"), F.coalesce(F.try_element_at(chain, F.lit(-2)), F.lit("")).alias("sub_section"),
        F.size(chain).alias("heading_depth"), T.script_language(F.col("text")).alias("language"), "text",
    )


def payload(chunks: DataFrame) -> DataFrame:
    """What a vector store keeps of a chunk: its vector's id, and a map without empty values."""
    chain = F.coalesce("heading_chain", F.array().cast("array<string>"))
    pairs = {
        "chunk_id": F.col("chunk_id"), "document_id": F.col("document_id"), "title": F.col("title"), "url": F.col("url"),
        "section": F.try_element_at(chain, F.lit(1)), "sub_section": F.when(F.size(chain) > 1, F.try_element_at(chain, F.lit(-1))),
        "heading_chain": F.to_json(chain), "language": F.coalesce(F.col("language"), F.lit("unknown")), "has_table": F.col("has_table").cast("string"), "has_list": F.col("has_list").cast("string"),
        "chunk_index": F.col("chunk_index").cast("string"), "total_chunks": F.col("total_chunks").cast("string"), "token_count": F.col("token_count").cast("string"), "content": F.col("content"),
    }
    filled = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values())), lambda k, v: T.text_or_empty(v) != "")
    return chunks.select(T.vector_id(F.col("chunk_id")).alias("id"), filled.alias("metadata"))


def normalized(raw: DataFrame, fallback: str = "file") -> DataFrame:
    """Chunks of any producer under one set of names; blank contents go."""
    have = lambda *names: [F.col(n) for n in names if n in raw.columns]
    pick = lambda default, *names: T.first_filled(*have(*names), default=default)
    content = pick("", "content", "text", "chunk_text")
    ident = [c.cast("string") for c in have("chunk_id", "id", fallback)]
    optional = lambda n: (F.col(n) if n in raw.columns else F.lit(None).cast("string")).alias(n)
    shaped = raw.select(
        T.first_filled(*ident, default="").alias("chunk_id"), pick("", "document_id", "doc_id").alias("document_id"), content.alias("content"),
        pick(rules.DEFAULT_TITLE, "title", "doc_title", "document_title").alias("title"), pick("", "url", "source_url", "page_url").alias("url"),
        pick("", "section", "heading", "sub_section").alias("section"),
        T.first_filled(*have("previous_chunk_id", "prev_chunk_id")).alias("previous_chunk_id") if have("previous_chunk_id", "prev_chunk_id") else F.lit(None).cast("string").alias("previous_chunk_id"),
        optional("next_chunk_id"), optional("parent_chunk_id"), optional("language"),
    )
    return shaped.where(T.trim(F.col("content")) != "")


def uploaded(files: DataFrame) -> DataFrame:
    """files(path, content binary) -> one chunk each, undecodable bytes replaced."""
    stem = F.element_at(F.split("path", "/"), -1)
    ident = F.concat(F.lit("upload-"), F.substring(F.md5(F.concat_ws(":", "path", F.md5("content"))), 1, 8), F.lit("-0"))
    return files.select(ident.alias("chunk_id"), stem.alias("title"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"))
