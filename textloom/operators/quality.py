"""Gates on pages, documents and chunks, and the report of what they refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import rules
from textloom.functions import text as T
from textloom.operators import dedup
from textloom.sources.storage import spread


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages with a url that are no error pages and, cleaned, have enough characters."""
    cleaned = pages.where((T.text_or_empty(F.col("url")) != "") & ~T.is_error_page(F.col("body"))).withColumn("clean_content", T.clean_page(F.col("body")))
    return cleaned.where(F.length("clean_content") >= rules.MIN_CLEAN_CHARS)


def enough_words(docs: DataFrame, source_type: str = "source_type", content: str = "content") -> DataFrame:
    """HTML documents of ten words or more, others of five."""
    least = F.when(F.col(source_type) == "html", rules.HTML_LEAST_WORDS).otherwise(rules.OTHER_LEAST_WORDS)
    return docs.where(T.word_count(F.col(content)) >= least)


def has_error_words(content: Column) -> Column:
    low, found = F.lower(T.text_or_empty(content)), F.lit(False)
    for word in rules.ERROR_WORDS:
        found = found | low.contains(word)
    return found


def is_navigation(content: Column, title: Column, tokens: Column, has_table: Column, has_list: Column) -> Column:
    """Few tokens with table and list and more links than sentences; or a menu's title and mostly links."""
    links = F.regexp_count(T.text_or_empty(content), F.lit(r"\["))
    periods = F.regexp_count(T.text_or_empty(content), F.lit(r"\."))
    ends = F.regexp_count(T.text_or_empty(content), F.lit("[.।]"))
    crowded = F.coalesce(has_table & has_list, F.lit(False)) & (tokens < rules.MENU_TOKENS) & (links > ends)
    return crowded | (F.lower(T.text_or_empty(title)).isin(rules.MENU_TITLES) & (links > rules.MENU_LINKS) & (periods < rules.MENU_PERIODS))


def refusal(content: Column, title: Column, tokens: Column, has_table: Column, has_list: Column) -> Column:
    """The first reason to refuse a chunk by itself, or null."""
    own = T.trim(T.text_or_empty(content))
    return F.when(tokens < rules.GATE_TOKENS, "too_small").when(has_error_words(own), "error_pages").when(is_navigation(own, title, tokens, has_table, has_list), "navigation")


def judged_chunks(chunks: DataFrame) -> DataFrame:
    """chunks with reason: too_small, error_pages, navigation, exact_dupes, near_dupes, blank, or null for those that stay.

    Reasons come in that order and only chunks that passed the earlier ones count for the later.
    """
    c, own_id = F.col("content"), F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))
    reason = refusal(c, F.col("title"), F.col("token_count"), F.col("has_table"), F.col("has_list"))
    # the patterns run once, and only narrow rows go through the windows; refused chunks have keys of their own there
    narrow = spread(chunks).select("chunk_id", "token_count", reason.alias("own"), T.content_hash(T.trim(T.text_or_empty(c))).alias("hash"), dedup.prefix_of(c).alias("prefix"))
    keyed = narrow.select("chunk_id", "token_count", "own", *[F.when(F.col("own").isNull(), F.col(n)).otherwise(own_id).alias(n) for n in ("hash", "prefix")])
    twin = keyed.withColumn("twin", F.row_number().over(Window.partitionBy("hash").orderBy("chunk_id")) > 1)
    near = F.row_number().over(Window.partitionBy("twin", "prefix").orderBy(F.desc("token_count"), "chunk_id")) > 1
    late = F.when(F.col("twin"), "exact_dupes").when(F.col("prefix") == "", "blank").when(near, "near_dupes")
    verdict = twin.select("chunk_id", F.coalesce("own", late).alias("reason"))
    return chunks.join(verdict, "chunk_id", "left").select(*chunks.columns, "reason")


def clean_chunks(chunks: DataFrame) -> DataFrame:
    return judged_chunks(chunks).where("reason is null").drop("reason")


def report(judged: DataFrame) -> DataFrame:
    """Rows for each reason; clean for those that stay."""
    return judged.groupBy(F.coalesce("reason", F.lit("clean")).alias("reason")).agg(F.count("*").alias("n"))


def embeddable(chunks: DataFrame, least: int = rules.GATE_TOKENS) -> DataFrame:
    """Chunks of enough tokens with their embedding text, where that has enough characters."""
    ready = chunks.where(F.col("token_count") >= max(least, rules.GATE_TOKENS))
    ready = ready.withColumn("embedding_text", T.embedding_text(F.col("heading_chain"), F.col("title"), F.col("content")))
    return ready.where((T.trim(F.col("embedding_text")) != "") & (F.length("embedding_text") >= rules.EMBED_LEAST_CHARS))


def embedding_counts(chunks: DataFrame, least: int = rules.GATE_TOKENS) -> DataFrame:
    """One row of an embedding run: total, below_tokens, too_short (blank or under the least characters), submitted."""
    text = T.embedding_text(F.col("heading_chain"), F.col("title"), F.col("content"))
    small = F.coalesce(F.col("token_count") < max(least, rules.GATE_TOKENS), F.lit(True))
    bare = (T.trim(text) == "") | (F.length(text) < rules.EMBED_LEAST_CHARS)
    marked = chunks.select(small.alias("small"), F.coalesce(bare, F.lit(True)).alias("bare"))
    return marked.agg(F.count("*").alias("total"), F.count_if("small").alias("below_tokens"), F.count_if(F.expr("bare and not small")).alias("too_short"), F.count_if(F.expr("not bare and not small")).alias("submitted"))


def needs_ocr(text: Column, pages: Column) -> Column:
    return (T.trim(T.text_or_empty(text)) == "") | (T.word_count(text) / F.greatest(pages, F.lit(1)) < rules.OCR_WORDS_PER_PAGE)
