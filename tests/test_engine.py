import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import sessions
from textloom.plans.engine import Engine
from textloom.sources import readers, sinks
from textloom.streaming import state

BODY = " ".join(f"The district office opens at nine on day {i} and serves every citizen of the town." for i in range(12))


def write_pages(tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "a.md").write_text(f"---\nurl: https://x.y/a\ndepth: 1\ncrawled_at: 2024\n---\n# Birth certificate\n\nApply for a birth certificate at the registrar. Form: https://x.y/birth.pdf\n\n{BODY}\n")
    (folder / "b.md").write_text(f"---\nurl: https://x.y/b\n---\n# Pension scheme\n\nThe pension scheme pays every month. {BODY.replace('nine', 'ten')}\n")
    (folder / "c.md").write_text(f"---\nurl: https://x.y/a\n---\n# Again\n\nThe same url once more. {BODY}\n")
    return str(folder)


def test_ingest_search_answer(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    stats = engine.ingest(readers.pages(spark, write_pages(tmp_path)))
    assert stats["documents"] == 2 and stats["chunks"] >= 2 and stats["vectors"] == stats["chunks"]
    asked = spark.createDataFrame([(1, "how to apply for a birth certificate", "s1"), (2, "hello", "s1"), (3, "quantum zebra", "s2"), (4, "tell me a joke", "s2")], "query_id long, query string, session_id string")
    hits = engine.search(asked, 3).where("query_id = 1").orderBy("rank").collect()
    assert hits[0]["url"] == "https://x.y/a" and len(hits) <= 3
    with pytest.raises(ValueError):
        engine.search(asked, 21)
    answers = spark.createDataFrame(engine.answer(asked).collect(), engine.answer(asked).schema)
    out = {r["query_id"]: r for r in answers.collect()}
    assert out[1]["mode"] == "official_rag" and out[1]["grounded"] and "birth" in out[1]["answer"].lower() and out[1]["sources"][0]["url"] == "https://x.y/a"
    assert out[1]["documents"][0]["url"] == "https://x.y/birth.pdf" and "https://x.y/birth.pdf" in out[1]["answer"]
    assert out[2]["mode"] == "conversational" and out[3]["mode"] == "general_llm" and "couldn't verify" in out[3]["answer"] and out[4]["mode"] == "general_llm"
    engine.remember(answers)
    cached = {r["query_id"]: r["cached"] for r in engine.recall(asked).collect()}
    assert json.loads(cached[1])["mode"] == "official_rag" and cached[3] is None
    before = engine.stats()
    again = engine.append_document(spark.createDataFrame([("/u/note.txt", bytearray(("A note on water supply. " * 10).encode()))], "path string, content binary"))
    assert again["chunks"] == before["chunks"] + 1
    assert engine.search(spark.createDataFrame([(9, "water supply note")], "query_id long, query string")).orderBy("rank").first()["chunk_id"].startswith("upload-")
    assert engine.health()["status"] == "ok"


def test_command_line(spark, tmp_path, capsys):
    from textloom.cli import main

    store = ["--store", f"file://{tmp_path}/cli"]
    assert main([*store, "ingest", write_pages(tmp_path), "--clear-index"], spark) == 0
    (tmp_path / "q.txt").write_text("birth certificate\n\npension scheme\n")
    main([*store, "search", str(tmp_path / "q.txt"), "--top-k", "2", "--output", str(tmp_path / "hits")], spark)
    assert spark.read.json(str(tmp_path / "hits")).select("query_id").distinct().count() == 2
    main([*store, "stats"], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["documents"] == 2


def test_keyed_tables(spark, tmp_path):
    t = sinks.Table(spark, f"file://{tmp_path}/t", "k")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    assert t.count() == 0 and t.read() is None
    t.upsert(rows((1, "a"), (2, "b")))
    t.upsert(rows((2, "c"), (3, "d")))
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    t.delete(rows((1, "")))
    assert t.count() == 2
    t.clear()
    assert t.count() == 0


def test_manifests_logs_and_chunks(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"url": "u", "file": "1"}\nnot json\n{"url": "u", "file": "2"}\n{"url": "v", "file": "3"}\n')
    got = {r["url"]: r["file"] for r in readers.manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert got == {"u": "2", "v": "3"}
    (tmp_path / "crawl.log").write_text("INFO ok\n2024 FAILED [404]: https://a.b/c d.pdf\n")
    assert [r["url"] for r in readers.failed_urls(spark, str(tmp_path / "crawl.log")).collect()] == ["https://a.b/c d.pdf"]
    folder = tmp_path / "chunks"
    folder.mkdir()
    (folder / "one.jsonl").write_text('{"chunk_id": "j", "content": "from lines"}\n')
    assert readers.chunk_files(spark, str(folder)).first()["chunk_id"] == "j"
    (folder / "two.json").write_text('[{"id": "a", "text": "x"}, {"id": "b", "text": "y"}]')
    assert readers.chunk_files(spark, str(folder)).count() == 2
    (folder / "e.json").unlink(missing_ok=True)
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "d.json").write_text('{"metadata": {"a": "b"}, "content": {"pages": [{"cells": [{"text": "c1"}]}], "texts": [{"text": "t1"}]}}')
    (docs / "bad.json").write_text("{")
    rows = {r["stem"]: r for r in readers.envelopes(spark, str(docs)).select("*", readers.docling_markdown(F.col("content_json")).alias("md")).collect()}
    assert rows["bad"]["broken"] and rows["d"]["md"] == "c1\n\nt1" and rows["d"]["metadata"] == {"a": "b"}


def office_files(tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    x = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    folder = tmp_path / "office"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{x}" xmlns:r="{r}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{x}"><si><t>Name</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{x}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Age</t></is></c></row><row/><row><c r="A2" t="inlineStr"><is><t>Ana</t></is></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    (folder / "b.xlsx").write_bytes(data.getvalue())
    (folder / "c.txt").write_bytes(b"plain \xff text ")
    (folder / "d.docx").write_bytes(b"broken")
    return folder, data.getvalue()


def test_office_files(spark, tmp_path):
    folder, book = office_files(tmp_path)
    out = {r["stem"]: r for r in readers.office_texts(spark, str(folder)).collect()}
    assert out["a"]["text"] == "One\nTwo" and out["b"]["text"] == "## Sheet: S\nName | Age\nAna | 7" and out["c"]["text"] == "plain  text"
    assert out["d"]["text"] is None and "BadZipFile" in out["d"]["error"]
    assert readers.sheet_table(readers.xlsx_sheets(book)[0][1]) == (["Name", "Col2", "Age"], [["Ana", "", "7"]])
    assert sinks.dead_letters(readers.office_texts(spark, str(folder)), "extract").count() == 1


def test_links(spark):
    html = "<a href='/f.pdf#x'>Form</a> <a class=b href=\"g.html\">Download it</a><a href='javascript:x'>no</a><a href=\"//cdn.s3waas.gov.in/h.docx\">H <b>doc</b></a><a href='/f.pdf'>Later</a><a href='/plain'>plain</a>"
    pages = spark.createDataFrame([(1, "https://westtripura.nic.in/dir/page", html)], "page_id int, url string, html string")
    got = {r["url"]: r["title"] for r in readers.discovered_links(pages).collect()}
    assert got == {"https://westtripura.nic.in/f.pdf": "Later", "https://westtripura.nic.in/dir/g.html": "Download it", "https://cdn.s3waas.gov.in/h.docx": "H doc"}


def test_asset_pages_round_trip(spark):
    assets = spark.createDataFrame([("/d/form_1.pdf", "Form", None, "https://a/f.pdf", ".pdf", "text")], "local_path string, title string, source_url string, url string, extension string, text string")
    page = readers.with_frontmatter(sinks.asset_markdown(assets)).first()
    assert page["file"] == "document__form_1.md" and page["frontmatter"]["document_type"] == "pdf" and page["url"] == "https://a/f.pdf" and page["body"].startswith("# Form\n\nOfficial document")


def test_numbering(spark):
    rows = spark.createDataFrame([(f"d{i % 7}", i) for i in range(200)], "document_id string, chunk_index int").repartition(5)
    got = sorted((r["document_id"], r["chunk_index"], r["n"]) for r in sinks.numbered(rows, ["document_id", "chunk_index"], "n").collect())
    assert [n for _, _, n in got] == list(range(200))


# ---- sessions and streams


def brute_limit(times, limit, window):
    held, out = [], []
    for t in times:
        held = [h for h in held if h > t - window]
        if len(held) >= limit:
            out.append((False, int(held[0] + window - t) + 1))
        else:
            held.append(t)
            out.append((True, 0))
    return out


def requests(spark):
    import random

    rng = random.Random(4)
    rows = [(i, f"c{rng.randrange(3)}", float(rng.randrange(0, 400))) for i in range(300)]
    rows += [(1000 + i, "steady", i * 50.0) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, client string, s double").select("event_id", "client", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))
    wanted = {}
    for c in {r[1] for r in rows}:
        own = sorted((t, i) for i, k, t in rows if k == c)
        wanted |= {i: v for (_, i), v in zip(own, brute_limit([t for t, _ in own], 5, 30), strict=True)}
    return df, wanted


def test_rate_limit_batch(spark):
    df, wanted = requests(spark)
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in sessions.rate_limited(df, limit=5, window=30).collect()}
    assert got == wanted and not all(a for a, _ in wanted.values())


def stream(spark, tmp_path, df, parts, name, make, mode):
    folder = tmp_path / name
    for i, p in enumerate(parts):
        df.where(p).coalesce(1).write.parquet(str(folder / f"{i}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    until = time.monotonic() + 120
    while q.isActive and time.monotonic() < until and sum(p["numInputRows"] > 0 for p in q.recentProgress) < len(parts):
        time.sleep(0.3)  # state with a timeout keeps the query alive after its last file
    q.stop()
    return spark.table(name).collect()


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    df, wanted = requests(spark)
    rows = stream(spark, tmp_path, df, ["ts < timestamp_seconds(200)", "ts >= timestamp_seconds(200)"], "limits", lambda s: state.rate_limited(s, limit=5, window=30), "append")
    assert {r["event_id"]: (r["allowed"], r["retry_after"]) for r in rows} == wanted


def test_session_stream_keeps_last_turns(spark, tmp_path):
    df = spark.createDataFrame([("s", i, f"u{i}", f"a{i}") for i in range(10)], "session_id string, turn int, user string, assistant string")
    rows = stream(spark, tmp_path, df, ["turn < 6", "turn >= 6"], "chats", state.sessions, "update")
    last = max(rows, key=lambda r: (r["n_turns"], r["history"]))
    assert last["n_turns"] == 8 and last["history"].startswith("User: u6\nAssistant: a6") and last["history"].endswith("a9")
    batch = sessions.history(df).first()["history"]
    assert batch == last["history"]


def test_new_urls_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "url string, s int").select("url", F.timestamp_seconds("s").alias("crawled_at"))
    assert sorted(r["url"] for r in stream(spark, tmp_path, df, ["url = 'a'", "url = 'b'"], "fresh", state.new_urls, "append")) == ["a", "b"]


def test_session_numbers_and_replies(spark):
    turns = spark.createDataFrame([("s", 0), ("s", 7200), ("s", 14401)], "session_id string, t int").select("session_id", F.timestamp_seconds("t").alias("ts"))
    assert [r["session_no"] for r in sessions.session_ids(turns).orderBy("ts").collect()] == [0, 0, 1]
    row = spark.range(1).select(sessions.reply(F.lit("Answer"), F.array(F.struct(F.lit("T").alias("title"), F.lit("U").alias("url"))), F.lit(None).cast("array<struct<title:string,url:string>>")).alias("r")).first()
    assert row["r"] == "Answer\n\nSources:\n1. T - U"
    messages = spark.createDataFrame([("message", ("1", False, "x", " hi ")), ("message", ("2", True, "x", "self")), ("other", ("3", False, "x", "y")), ("message", ("4", False, "x", " "))], "event string, data struct<id:string,fromMe:boolean,from:string,body:string>")
    assert [r["query"] for r in sessions.incoming(messages).collect()] == ["hi"]
