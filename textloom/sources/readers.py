"""Readers: markdown pages, JSON envelopes, manifests, crawl logs, chunks, office files, HTML links."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import pdf, rules
from textloom.functions import text as T
from textloom.functions.names import free_name

MANIFEST = "url string, file string, depth int, score double, char_count int, document_urls array<string>, crawled_at string"
ENVELOPE = "metadata map<string,string>, content string"
CHUNK = (
    "chunk_id string, id string, document_id string, doc_id string, content string, text string, chunk_text string, title string, doc_title string, "
    "document_title string, url string, source_url string, page_url string, heading_chain array<string>, section string, heading string, sub_section string, language string, "
    "previous_chunk_id string, prev_chunk_id string, next_chunk_id string, parent_chunk_id string, chunk_index int, total_chunks int, token_count int, has_table boolean, has_list boolean"
)
BAD = "_corrupt_record"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files: file, stem, raw, frontmatter's url, depth, score, crawled_at, the map itself, and the body."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).withColumn("file", F.input_file_name())
    return with_frontmatter(raw.select("file", stem(F.col("file")).alias("stem"), F.col("value").alias("raw")))


def with_frontmatter(raw: DataFrame, column: str = "raw") -> DataFrame:
    front = raw.withColumn("frontmatter", T.frontmatter(F.col(column)))
    value = lambda k: F.coalesce(F.try_element_at("frontmatter", F.lit(k)), F.lit(""))
    number = lambda k, kind: F.coalesce(F.nullif(value(k), F.lit("")).try_cast(kind), F.lit(0).cast(kind))
    return front.select("*", value("url").alias("url"), number("depth", "int").alias("depth"), number("score", "double").alias("score"), value("crawled_at").alias("crawled_at"), T.body(F.col(column)).alias("body"))


def envelopes(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of metadata and content, content as text whatever its shape; broken files are kept with their error column filled."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).withColumn("file", F.input_file_name())
    parsed = F.try_parse_json("value")
    return raw.select("file", stem(F.col("file")).alias("stem"), F.from_json("value", ENVELOPE).alias("e"), parsed.isNull().alias("broken"), F.try_variant_get(parsed, "$.content", "string").alias("content_json")).select("file", "stem", "e.metadata", "content_json", "broken")


def docling_markdown(content: Column) -> Column:
    """Markdown of an extractor's JSON content: its text, or else the texts of body items, page cells and texts, in that order."""
    parsed = F.from_json(content, "text string, markdown string, body struct<items array<struct<text string>>>, pages array<struct<cells array<struct<text string>>>>, texts array<struct<text string>>")
    of = lambda items: F.transform(F.coalesce(items, F.array().cast("array<struct<text:string>>")), lambda i: i["text"])
    cells = F.flatten(F.transform(F.coalesce(parsed["pages"], F.array().cast("array<struct<cells:array<struct<text:string>>>>")), lambda p: of(p["cells"])))
    parts = F.filter(F.concat(of(parsed["body"]["items"]), cells, of(parsed["texts"])), lambda x: T.text_or_empty(x) != "")
    return T.first_filled(parsed["text"], parsed["markdown"], F.array_join(parts, "\n\n"), default="")


def sheet_tables(content: Column) -> Column:
    """Tables of a workbook's JSON: sheet name, headers and rows."""
    parsed = F.from_json(content, "sheets array<struct<name string, headers array<string>, rows array<array<string>>>>")
    return F.coalesce(parsed["sheets"], F.array().cast("array<struct<name:string,headers:array<string>,rows:array<array<string>>>>"))


def manifest(spark: SparkSession, path: str, key: str = "url", schema: str = MANIFEST) -> DataFrame:
    """JSON lines, bad lines skipped; of a key the last line holds. A line's place is its file and row, so `last` is well defined."""
    rows = spark.read.option("mode", "DROPMALFORMED").schema(schema).json(path)
    rows = rows.where(F.col(key).isNotNull()).select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))
    return last_by(rows, key, "_at")


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    place = free_name("place", rows.columns)
    ranked = rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return ranked.where(F.col(place) == 1).drop(place, order)


def failed_urls(spark: SparkSession, path: str) -> DataFrame:
    """Urls of a crawl log's failures; they may hold blanks."""
    found = F.regexp_extract("value", r"FAILED\s+\[.*?\]:\s+(.+)", 1)
    return spark.read.text(path).select(F.trim(found).alias("url")).where("url <> ''").distinct()


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of *.json files (an object or a list each), or of *.jsonl where no JSON chunk is found."""
    reader = lambda glob: spark.read.option("pathGlobFilter", glob).option("multiLine", glob == "*.json").option("mode", "DROPMALFORMED").schema(CHUNK).json(path).withColumn("file", stem(F.input_file_name()))
    whole = reader("*.json")
    return whole if whole.limit(1).count() else reader("*.jsonl")


def text_files(spark: SparkSession, path: str, glob: str = "*.{csv,txt}") -> DataFrame:
    """CSV and TXT as raw text, bytes that are no UTF-8 left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return raw.select("path", stem(F.col("path")).alias("stem"), T.trim(F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))).alias("text"))


# ---- office files: zip archives of XML

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_paragraphs(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_W}body")
    out = ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in (body if body is not None else []) if p.tag == f"{_W}p"]
    return [p for p in out if p.strip()]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cell texts) of each sheet, cells at their columns."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_X}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in root.iter(f"{_X}row"):
                cells: dict[int, str] = {}
                for i, c in enumerate(row.iter(f"{_X}c")):
                    v = c.find(f"{_X}v")
                    if c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_X}t"))
                    elif v is None or v.text is None:
                        continue
                    else:
                        value = shared[int(v.text)] if c.get("t") == "s" else v.text
                    cells[_column(c.get("r")) if c.get("r") else i] = value
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            out.append((sheet.get("name"), rows))
    return out


def sheet_table(rows: list[list[str]], most: int = 100_000) -> tuple[list[str], list[list[str]]]:
    """Headers and rows: the first row names columns (Col{n} for blanks, trailing blanks left out); blank rows are skipped."""
    if not rows:
        return [], []
    first = [c.strip() for c in rows[0]]
    while first and not first[-1]:
        first.pop()
    headers = [c or f"Col{i + 1}" for i, c in enumerate(first)]
    body = [[*[c.strip() for c in r[: len(headers)]], *[""] * (len(headers) - len(r))] for r in rows[1:]]
    return headers, [r for r in body if any(r)][:most]


def sheet_text(sheets: list[tuple[str, list[list[str]]]]) -> str:
    lines = []
    for name, rows in sheets:
        lines.append(f"## Sheet: {name}")
        lines += [" | ".join(own) for r in rows if (own := [c.strip() for c in r if c.strip()])]
    return "\n".join(lines).strip()


Pages = Callable[[bytes], list[str]]


def pdf_text(data: bytes, pages: Pages = pdf.pages, ocr: Pages | None = None) -> str:
    """Text of a PDF's pages; by ocr, where given, if the pages have too few words to have been written as text."""
    own = pages(data)
    words = sum(len((p or "").split()) for p in own)
    if ocr and (not words or words / max(len(own), 1) < rules.OCR_WORDS_PER_PAGE):
        own = ocr(data)
    return "\n\n".join(p or "" for p in own).strip()


def extract_text(name: str, data: bytes, pdf_pages: Pages = pdf.pages, ocr: Pages | None = None) -> str:
    kind = name.lower().rsplit(".", 1)[-1]
    if kind == "docx":
        return "\n".join(docx_paragraphs(data)).strip()
    if kind == "xlsx":
        return sheet_text(xlsx_sheets(data))
    if kind in ("csv", "txt"):
        return data.decode("utf-8", "ignore").strip()
    if kind == "pdf":
        return pdf_text(data, pdf_pages, ocr)
    raise ValueError(f"no reader for .{kind}")


def office_texts(spark: SparkSession, path: str, pdf_pages: Pages = pdf.pages, ocr: Pages | None = None) -> DataFrame:
    """path, stem, text, error of every file; one that can't be read has its error and no text. The functions travel to the tasks."""
    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows.append((name, extract_text(name, data, pdf_pages, ocr), None))
                except Exception as e:  # noqa: BLE001  any broken file is a row of its own
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, text string, error string").withColumn("stem", stem(F.col("path")))


# ---- HTML


def _resolve(base: Column, href: Column) -> Column:
    """href against a page's url, without fragment: absolute, //host, /path and relative forms."""
    scheme, host = F.coalesce(F.try_parse_url(base, F.lit("PROTOCOL")), F.lit("https")), T.url_part(base, "AUTHORITY")
    folder = F.regexp_replace(T.url_part(base, "PATH"), "[^/]*$", "")
    root = F.concat(scheme, F.lit("://"), host)
    bare = F.regexp_replace(href, "#.*$", "")
    path = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), bare)
    plain = F.regexp_replace(F.regexp_replace(path, r"/\./", "/"), r"(?<!\.\.)/[^/]+/\.\./", "/")
    return F.when(bare.rlike("(?i)^[a-z][a-z0-9+.-]*:"), bare).when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare)).when(bare.startswith("/"), F.concat(root, bare)).when(bare == "", F.regexp_replace(base, "#.*$", "")).otherwise(F.concat(root, plain))


def anchors(pages_: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """page_id, place, href resolved, text of every anchor with an href."""
    tags = F.regexp_extract_all(T.text_or_empty(F.col(html)), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)[^>]*>.*?(?:</a\s*>|(?=<a\s)|$)"), 0)
    rows = pages_.select("page_id", F.col(url).alias("source_url"), F.posexplode(tags).alias("place", "tag"))
    raw = F.regexp_extract("tag", r"(?is)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 0)
    href = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?is)^href\s*=\s*", ""), "^[\"']|[\"']$", ""))
    inner = F.regexp_replace(F.regexp_replace("tag", r"(?is)^<a\s[^>]*>", ""), r"(?is)</a\s*>$", "")
    text = F.array_join(F.split(T.html_text(inner), "\n"), " ")
    ok = (href != "") & ~F.lower(href).rlike("^(javascript|mailto|tel):")
    return rows.withColumn("href", href).withColumn("text", text).where(ok).select("page_id", "source_url", "place", _resolve(F.col("source_url"), F.col("href")).alias("url"), "text")


def discovered_links(pages_: DataFrame, trusted_only: bool = True) -> DataFrame:
    """page_id, url, title, source_url of document links: a document's extension, or a text that says download or view. Of a page's url the last anchor holds."""
    found = anchors(pages_).where((T.asset_extension(F.col("url")) != "") | F.lower("text").rlike("download|view"))
    if trusted_only:
        found = found.where(T.trusted_host(F.col("url")))
    last = found.groupBy("page_id", "source_url", "url").agg(F.max_by("text", "place").alias("text"))
    return last.select("page_id", "url", T.first_filled(F.col("text"), F.element_at(F.split("url", "/"), -1), default="").alias("title"), "source_url")


def frontier(links: DataFrame, seen: DataFrame, most: int = rules.MAX_PAGES, depth: int = rules.MAX_DEPTH) -> DataFrame:
    """The next urls to crawl: links(url, depth) on the site, not seen, not too deep, best by priority words, at most `most`: a crawl's stated bound."""
    open_ = links.where((F.col("depth") <= depth) & T.crawlable(F.col("url"))).join(seen.select("url"), "url", "left_anti")
    scored = open_.groupBy("url").agg(F.min("depth").alias("depth")).withColumn("score", F.round(T.crawl_priority(F.col("url")), 9))
    return scored.orderBy(F.desc("score"), "depth", "url").limit(most)
