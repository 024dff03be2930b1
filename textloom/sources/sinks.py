"""Writers and keyed tables: append, last-wins merge, upsert, delete, dead letters, answers with a lifetime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import rules
from textloom.functions import text as T
from textloom.functions.names import free_name


def merged(old: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Rows of both; of a key the last new row holds. One shuffle on the key.

    order: by what new rows of one key follow each other; where not given, the order in which Spark reads them.
    """
    age = free_name("age", [*old.columns, *new.columns])
    place = free_name("place", [*old.columns, *new.columns])
    number = F.monotonically_increasing_id() if order is None else order
    later = new.withColumn(age, F.struct(F.lit(1).alias("new"), number.alias("number")))
    both = old.withColumn(age, F.lit(None).cast(later.schema[age].dataType)).unionByName(later, allowMissingColumns=True)
    ranked = both.withColumn(place, F.row_number().over(Window.partitionBy(F.col(f"`{key}`")).orderBy(F.desc_nulls_last(age))))
    return ranked.where(F.col(place) == 1).drop(place, age)


def without(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return old.join(ids.select(key).distinct(), key, "left_anti")


class Table:
    """A keyed Parquet table below a path: each change writes a version of its own and then moves the pointer to it,
    so readers see a whole version and a lost task leaves only files that nothing points to."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _versions(self) -> DataFrame:
        return self.spark.read.schema("version long, place string").json(f"{self.path}/versions")

    def _exists(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def version(self) -> tuple[int, str | None]:
        if not self._exists():
            return 0, None
        last = self._versions().orderBy(F.desc("version")).first()
        return last["version"], last["place"]

    def read(self) -> DataFrame | None:
        place = self.version()[1]
        return None if place is None else self.spark.read.parquet(place)

    def replace(self, rows: DataFrame) -> None:
        n = self.version()[0] + 1
        place = f"{self.path}/data-{n:08d}"
        rows.write.mode("overwrite").parquet(place)
        self.spark.createDataFrame([(n, place)], "version long, place string").coalesce(1).write.mode("append").json(f"{self.path}/versions")

    def upsert(self, rows: DataFrame) -> None:
        old = self.read()
        self.replace(rows if old is None else merged(old, rows, self.key))

    def delete(self, ids: DataFrame) -> None:
        if (old := self.read()) is not None:
            self.replace(without(old, ids, self.key))

    def clear(self) -> None:
        if (old := self.read()) is not None:
            self.replace(old.limit(0))

    def count(self) -> int:
        old = self.read()
        return 0 if old is None else old.count()

    def health(self) -> dict:
        return {"status": "ok", "count": self.count()}


def page_markdown(url: Column, depth: Column, crawled_at: Column, body: Column, document_urls: Column) -> Column:
    """A page's file: frontmatter, body, and its documents as a list."""
    front = T.write_frontmatter([("url", url), ("depth", depth.cast("string")), ("crawled_at", crawled_at)])
    links = F.array_join(F.transform(document_urls, lambda u: F.concat(F.lit("- "), u)), "\n")
    listed = F.when(F.size(document_urls) > 0, F.concat(F.lit("\n\n## Official documents\n\n"), links)).otherwise("")
    return F.concat(front, F.lit("\n"), body, listed)


def asset_markdown(assets: DataFrame) -> DataFrame:
    """file and raw: pages made of downloaded documents, assets(local_path, title, source_url, url, extension, text)."""
    name = F.regexp_replace(F.element_at(F.split("local_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    title, source = T.first_filled(F.col("title"), name, default=""), T.first_filled(F.col("source_url"), default=rules.HOME)
    front = F.concat(F.lit("---\nurl: "), "url", F.lit("\nsource_url: "), source, F.lit("\ndocument_url: "), "url", F.lit("\ndocument_type: "), F.regexp_replace("extension", r"^\.+", ""), F.lit("\ntitle: "), title, F.lit("\ndepth: 0\n---\n\n"))
    head = F.concat(F.lit("# "), title, F.lit(f"\n\nOfficial document from {rules.DISTRICT} District.\n\nSource page: "), source, F.lit("\n\nDocument download: "), "url", F.lit("\n\n## Document content\n\n"))
    return assets.where(T.trim(F.col("text")) != "").select(F.concat(F.lit("document__"), name, F.lit(".md")).alias("file"), F.concat(front, head, "text", F.lit("\n")).alias("raw"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as Parquet with a global number in order of document and index. Numbers come from a range sort and counts
    of its partitions, not from one task."""
    numbered(chunks, ["document_id", "chunk_index"], "global_index").write.mode("overwrite").parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a number from 0 in the given order."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()).persist()
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = sizes.select("_p", "_first", F.coalesce(before, F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_id") - F.col("_first")).drop("_p", "_id", "_first", "_start")


def write_index(entries: DataFrame, path: str) -> int:
    """An index's entries as JSON lines, and beside them their number; returns the number."""
    entries.write.mode("overwrite").json(f"{path}/entries")
    n = entries.sparkSession.read.text(f"{path}/entries").count()
    entries.sparkSession.createDataFrame([(n,)], "total long").coalesce(1).write.mode("overwrite").json(f"{path}/total")
    return n


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def dead_letters(rows: DataFrame, stage: str, key: str = "path") -> DataFrame:
    """file, stage, error, timestamp of the rows with an error."""
    return rows.where(F.col("error").isNotNull()).select(F.col(key).alias("file"), F.lit(stage).alias("stage"), "error", F.current_timestamp().alias("timestamp"))


def cached_answers(answers: DataFrame, now: Column, ttl: int = rules.CACHE_TTL) -> DataFrame:
    """key, value as JSON, expires_at of answers(query, ...)."""
    return answers.select(T.cache_key(F.col("query")).alias("key"), F.to_json(F.struct(*answers.columns)).alias("value"), (now + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"))


def cache_lookup(queries: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """queries with the value of a cached answer that has not expired, or null."""
    live = cache.where(F.col("expires_at") > now).groupBy("key").agg(F.max_by("value", "expires_at").alias("cached"))
    return queries.withColumn("_key", T.cache_key(F.col("query"))).join(live, F.col("_key") == F.col("key"), "left").drop("_key", "key")
