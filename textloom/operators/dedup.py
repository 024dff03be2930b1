"""Deduplication by url, hash, prefix and first sight, and the greedy rule that couples url and hash."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import rules
from textloom.functions import text as T
from textloom.functions.names import free_name
from textloom.operators.components import connected
from textloom.sources.storage import checkpointed


def first_of(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each key; the window keeps one row a key before the shuffle already."""
    place = free_name("place", df.columns)
    ranked = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(place) == 1).drop(place)


def by_url(pages: DataFrame) -> DataFrame:
    """Of each url the page of least depth, the oldest crawl, the last file."""
    return first_of(pages, ["url"], [F.col("depth"), T.text_or_empty(F.col("crawled_at")), F.col("file").desc()])


def by_content(docs: DataFrame, content: str = "clean_content") -> DataFrame:
    """Of equal contents the document with the shortest url, the first where that ties."""
    return first_of(docs, [T.content_hash(F.col(content))], [F.length("url"), F.col("url"), F.col("doc_id")])


def first_seen(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union of sources; of each key the row of the earliest source, in its order."""
    source = free_name("source", [c for s in sources for c in s.columns])
    rows = [s.withColumn(source, F.lit(i)) for i, s in enumerate(sources)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r, allowMissingColumns=True)
    return first_of(union, [key], [F.col(source), F.col(order)]).drop(source)


def exact_chunks(chunks: DataFrame, content: str = "content", order: str = "chunk_id") -> DataFrame:
    """The first chunk of each content."""
    return first_of(chunks, [T.content_hash(T.trim(T.text_or_empty(F.col(content))))], [F.col(order)])


def prefix_of(content: Column) -> Column:
    return F.lower(T.trim(F.substring(T.trim(T.text_or_empty(content)), 1, rules.PREFIX_CHARS)))


def by_prefix(chunks: DataFrame, content: str = "content", tokens: str = "token_count", order: str = "chunk_id") -> DataFrame:
    """Of chunks that begin alike the one of most tokens; blank beginnings go."""
    prefix = prefix_of(F.col(content))
    return first_of(chunks.where(prefix != ""), [prefix], [F.col(tokens).desc(), F.col(order)])


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key with its first place."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def _accept(rows: pd.DataFrame) -> pd.DataFrame:
    """In order, rows whose url and hash no accepted row has; an empty url repeats nothing."""
    urls, hashes, kept = set(), set(), []
    for url, digest in zip(rows["url"], rows["hash"], strict=True):
        ok = not (url and url in urls) and digest not in hashes
        kept.append(ok)
        if ok:
            urls.add(url)
            hashes.add(digest)
    return rows[kept]


def greedy(docs: DataFrame, order: str) -> DataFrame:
    """docs(url, hash, order): what a walk in order accepts that refuses seen urls and seen hashes.

    Rows that can only be refused go first, by counts and minima: repeats of a pair of url and hash; of rows whose url
    no other row has, all but the first of their hash, which that row uses up; likewise all but the first of their url
    among rows whose hash stands alone. So a hash that a third of all pages share (an empty or boilerplate page) leaves
    one row of those whose urls are their own. Rows that still share something hang together in groups, found by
    distributed union-find, and each group is walked by itself; all others are accepted.
    """
    rows = docs.select("url", "hash", order).groupBy("url", "hash").agg(F.min(order).alias(order))
    hashes = rows.groupBy("hash").agg(F.count("*").alias("n_hash"))
    urls = rows.where("url <> ''").groupBy("url").agg(F.count("*").alias("n_url"))
    marked = rows.join(hashes, "hash").join(urls, "url", "left").select("url", "hash", order, (F.col("n_hash") == 1).alias("own_hash"), (F.coalesce("n_url", F.lit(1)) == 1).alias("own_url"))
    marked = checkpointed(marked)
    first = marked.groupBy("hash").agg(F.min(F.when(F.col("own_url"), F.col(order))).alias("first_of_hash"))
    left = marked.join(first, "hash").where(~F.col("own_url") | (F.col(order) == F.col("first_of_hash")))
    first = marked.where("url <> ''").groupBy("url").agg(F.min(F.when(F.col("own_hash"), F.col(order))).alias("first_of_url"))
    left = left.join(first, "url", "left").where(~F.col("own_hash") | (F.col("url") == "") | (F.col(order) == F.col("first_of_url")))
    left = checkpointed(left.select("url", "hash", order))
    to_hash = left.groupBy("hash").agg(F.min(order).alias("b"))
    to_url = left.where("url <> ''").groupBy("url").agg(F.min(order).alias("b"))
    links = left.join(to_hash, "hash").select(F.col(order).alias("a"), "b").unionByName(left.join(to_url, "url").select(F.col(order).alias("a"), "b"))
    found = connected(links)
    grouped = left.join(found, left[order] == found["node"], "left").select("url", "hash", order, "root")
    walk = lambda pdf: _accept(pdf.sort_values(order))[["url", "hash", order]]
    schema = left.schema
    return grouped.where("root is null").select("url", "hash", order).unionByName(grouped.where("root is not null").groupBy("root").applyInPandas(walk, schema))
