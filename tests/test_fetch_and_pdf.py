import zlib

import pytest
from pyspark.sql import functions as F

from textloom.functions import pdf, providers
from textloom.operators import documents, quality
from textloom.sources import fetch, readers, sinks


def make_pdf(pages, fonts=b""):
    """A file of pages, each given by its content operators; contents are deflated, resources stand on the tree's root."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = []
    for i, content in enumerate(pages):
        data = zlib.compress(content)
        page, stream = 10 + 2 * i, 11 + 2 * i
        kids.append(b"%d 0 R" % page)
        objects[page] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % stream
        objects[stream] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data)
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << %s >> >> >>" % (b" ".join(kids), len(pages), fonts)
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0995> <0002> <0020> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    objects[5] = b"<< /Type /Font /ToUnicode 6 0 R >>"
    objects[6] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


CONTENTS = [
    b"BT /F1 12 Tf 72 700 Td (Hello \\(world\\)) Tj 0 -14 Td [(Sec) 20 (ond) -300 (line \\351)] TJ ET",
    b"BT /F2 12 Tf 1 0 0 1 72 700 Tm <0001000200100011> Tj T* <0012> Tj ET",
]


def test_pdf_pages():
    assert pdf.pages(make_pdf(CONTENTS, b"/F1 9 0 R /F2 5 0 R")) == ["Hello (world)\nSecond line é", "ক ab\nc"]
    assert pdf.pages(make_pdf([b""])) == [""]
    with pytest.raises(ValueError):
        pdf.pages(b"plain text")


def test_office_files_with_pdf_and_ocr(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make_pdf([b"BT (" + b"word " * 30 + b") Tj ET"]))
    (tmp_path / "scan.pdf").write_bytes(make_pdf([b"", b""]))
    (tmp_path / "broken.pdf").write_bytes(b"nothing")
    (tmp_path / "n.txt").write_bytes(b" text \n")
    out = {r["stem"]: r for r in readers.office_texts(spark, str(tmp_path), ocr=lambda data: ["read by eye"]).collect()}
    assert out["a"]["text"].split() == ["word"] * 30 and out["scan"]["text"] == "read by eye" and out["n"]["text"] == "text"
    assert out["broken"]["text"] is None and "ValueError" in out["broken"]["error"]
    own = {r["stem"]: r["text"] for r in readers.office_texts(spark, str(tmp_path), pdf_pages=lambda data: ["page one", None]).collect()}
    assert own["a"] == "page one"


SITE = {
    "https://westtripura.nic.in/": '<a href="/service">Service</a> <a href="/a">A</a> <a href="https://elsewhere.org/">out</a>',
    "https://westtripura.nic.in/service": '<a href="/form">Form</a> <a href="/gone">Gone</a> <a href="/login">no</a>',
    "https://westtripura.nic.in/a": '<a href="/">home</a> <a href="/deep/1">deep</a>',
    "https://westtripura.nic.in/form": "<p>form</p>",
    "https://westtripura.nic.in/deep/1": '<a href="/deep/2">2</a>',
}


def site_fetcher():
    """A function made here travels to the tasks by value, as the tests' module is unknown there."""
    pages = dict(SITE)
    return lambda url: (200, "text/html", pages[url].encode()) if url in pages else (404, "", b"")


from_site = site_fetcher()


def test_fetch_retries_and_stops(spark):
    tries = {}

    def flaky(url):
        tries[url] = tries.get(url, 0) + 1
        if url == "bad":
            raise OSError("no route")
        return (200, "text/plain", b"body") if tries[url] > 2 else (503, "", b"")

    assert fetch.with_retries("u", flaky, 3, 0)[1:6] == (200, "text/plain", b"body", None, 3)
    assert fetch.with_retries("bad", flaky, 2, 0)[1:6] == (None, "", None, "OSError: no route", 3)
    assert fetch.with_retries("https://x/none", from_site, 3, 0)[4:6] == ("HTTP 404", 1)
    assert [round(fetch.delay("u", n)) >= 2**n for n in (1, 2, 3)] == [True] * 3 and fetch.delay("u", 1) <= 2.6
    urls = spark.createDataFrame([("https://westtripura.nic.in/form",), ("https://westtripura.nic.in/none",)], "url string")
    out = {r["url"][-4:]: r for r in fetch.fetched(urls, from_site, base=0).collect()}
    assert out["form"]["content"] == b"<p>form</p>" and out["none"]["error"] == "HTTP 404" and out["none"]["content"] is None


def test_crawl_goes_on_where_it_stopped(spark, tmp_path):
    make = lambda **more: fetch.Crawl(spark, f"file://{tmp_path}/crawl", from_site, batch=2, depth=2, base=0, **more)
    crawl = make()
    crawl.start("https://westtripura.nic.in/")
    assert crawl.step() == 1 and crawl.step() == 2
    assert make().run() == {"pages": 5, "failed": 1}  # another object, as after a restart; /deep/2 is too deep
    pages = {r["url"]: r for r in make().pages.read().collect()}
    assert set(pages) == {*SITE, "https://westtripura.nic.in/gone"} and pages["https://westtripura.nic.in/gone"]["error"] == "HTTP 404"
    assert make(most=6).step() == 0
    for bad in (lambda: make(most=2001), lambda: make().start("ftp://x")):
        with pytest.raises(ValueError):
            bad()


def test_byte_pair_tokens():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    count = providers.bpe_tokens(path)
    assert count(" \n") == 0 and count("the office of the district") == len(Tokenizer.from_file(path).encode("the office of the district", add_special_tokens=False).ids)


def test_indexes_and_embedding_counts(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "d", "h", "t", "u", 3, "x" * 400, 60, ["a"]), ("c2", "d", "h", "t", "u", 3, "x", 2, ["a"]), ("c3", "d", "h", "", "u", 3, "", 60, [])], "chunk_id string, document_id string, heading string, title string, url string, word_count int, content string, token_count int, heading_chain array<string>")
    assert sinks.write_index(documents.chunk_index(chunks), f"file://{tmp_path}/index") == 3
    assert spark.read.json(f"file://{tmp_path}/index/total").first()["total"] == 3
    assert set(spark.read.json(f"file://{tmp_path}/index/entries").columns) == {"chunk_id", "document_id", "heading", "title", "url", "word_count"}
    assert quality.embedding_counts(chunks).first().asDict() == {"total": 3, "below_tokens": 1, "too_short": 1, "submitted": 1}
    assert documents.document_index(chunks.withColumn("source_type", F.lit("md"))).columns == ["document_id", "url", "title", "source_type", "word_count"]
