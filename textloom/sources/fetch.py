"""Pages and documents over HTTP (or any other fetcher), with retries; and a crawl whose state is tables.

A fetcher is a function of a url to (status, content type, bytes); it raises where there is no answer. It runs in the
tasks, a few urls at once in each, so `fetched` reads a table of urls as a source reads files.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import rules
from textloom.sources import readers
from textloom.sources.sinks import Table

Fetch = Callable[[str], tuple[int, str, bytes]]
AT_ONCE, RETRIES, BASE_DELAY, JITTER, TIMEOUT = 3, 3, 2.0, 0.3, 60
PERMANENT = (403, 404, 410)  # answers that another try would not change
BATCH = 40

_FETCHED = pa.schema([("url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("content", pa.binary()), ("error", pa.string()), ("attempts", pa.int32()), ("seconds", pa.float64())])
_FETCHED_DDL = "url string, status int, content_type string, content binary, error string, attempts int, seconds double"


def http(url: str) -> tuple[int, str, bytes]:
    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:  # noqa: S310
            return answer.status, answer.headers.get("Content-Type", ""), answer.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type", ""), b""


def delay(url: str, attempt: int, base: float = BASE_DELAY) -> float:
    """Seconds before a try: doubling, with a jitter that follows from the url."""
    wait = base * 2 ** (attempt - 1)
    return wait * (1 + JITTER * (zlib.crc32(f"{url} {attempt}".encode()) % 1000) / 1000)


def with_retries(url: str, fetch: Fetch, retries: int = RETRIES, base: float = BASE_DELAY) -> tuple:
    begun, status, kind, error = time.monotonic(), None, "", ""
    attempt = 0
    while True:
        try:
            status, kind, data = fetch(url)
            if status == 200:
                return url, status, kind, data, None, attempt + 1, time.monotonic() - begun
            error = f"HTTP {status}"
        except Exception as e:  # noqa: BLE001  whatever a fetcher raises is that url's error
            status, error = None, f"{type(e).__name__}: {e}"
        if attempt == retries or status in PERMANENT:
            return url, status, kind, None, error, attempt + 1, time.monotonic() - begun
        attempt += 1
        time.sleep(delay(url, attempt, base))


def fetched(urls: DataFrame, fetch: Fetch = http, retries: int = RETRIES, base: float = BASE_DELAY, at_once: int = AT_ONCE) -> DataFrame:
    """urls(url) -> url, status, content_type, content, error, attempts, seconds. A url that fails has its error and no content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                for row in pool.map(lambda u: with_retries(u, fetch, retries, base), b.column("url").to_pylist()):
                    yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _FETCHED, strict=True)], schema=_FETCHED)

    return urls.select("url").mapInArrow(run, _FETCHED_DDL)


class Crawl:
    """A best-first crawl below a folder. After each step found urls and pages are whole versions of tables, so a crawl
    that was stopped, or lost its driver, goes on from its last step."""

    def __init__(self, spark: SparkSession, root: str, fetch: Fetch = http, most: int = rules.MAX_PAGES, depth: int = rules.MAX_DEPTH, batch: int = BATCH, base: float = BASE_DELAY):
        if not 1 <= most <= rules.MOST_PAGES:
            raise ValueError(f"a crawl has between 1 and {rules.MOST_PAGES} pages")
        self.fetch, self.most, self.depth, self.batch, self.base, self.spark = fetch, most, depth, batch, base, spark
        self.found, self.pages, self.got = (Table(spark, f"{root.rstrip('/')}/{n}", "url") for n in ("found", "pages", "got"))

    def start(self, *urls: str) -> None:
        """Begin anew, from urls that begin with http."""
        if not urls or not all(u.startswith("http") for u in urls):
            raise ValueError("a crawl starts from urls that begin with http")
        self.found.replace(self.spark.createDataFrame([(u, 0) for u in urls], "url string, depth int"))
        if self.pages.read() is not None:
            self.pages.clear()

    def step(self) -> int:
        """Fetch the best open urls, at most a batch; the number of pages that came of it or failed."""
        known = self.pages.read()
        seen = self.spark.createDataFrame([], "url string") if known is None else known.select("url")
        left = min(self.batch, self.most - (0 if known is None else known.count()))
        if left <= 0:
            return 0
        todo = readers.frontier(self.found.read(), seen, left, self.depth)
        self.got.replace(todo.join(fetched(todo.repartition(AT_ONCE), self.fetch, base=self.base), "url"))
        got = self.got.read()
        page = F.coalesce(F.make_valid_utf8(F.col("content").cast("string")), F.lit(""))
        new = got.select(F.xxhash64("url").alias("page_id"), "url", "depth", "score", "status", "error", page.alias("html"), F.current_timestamp().alias("crawled_at"))
        links = readers.anchors(new.where("error is null")).select("page_id", "url").join(new.select("page_id", (F.col("depth") + 1).alias("depth")), "page_id").select("url", "depth")
        self.found.replace(self.found.read().unionByName(links).groupBy("url").agg(F.min("depth").alias("depth")))
        self.pages.upsert(new)  # last: a step that ends before is done again
        return got.count()

    def run(self) -> dict:
        """Steps until the bound is met or nothing is open."""
        while self.step():
            pass
        done = self.pages.read()
        return {} if done is None else done.agg(F.count_if(F.col("error").isNull()).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed")).first().asDict()
