import re

import corpus_pipeline
from textloom.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
        ids = [r["doc_id"] for r in docs.collect()]
        assert len(ids) == len(set(ids))
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[-1] > 0.6 * sizes[0]


def windows_of(text, size=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    k = min(size, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def test_no_benchmark_window_survives(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = set().union(*(windows_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()))
    hit = {r["doc_id"] for r in docs.collect() if windows_of(r["text"]) & held}
    kept = {r["doc_id"] for r in corpus_pipeline.decontamination_stage(spark, docs, sf).collect()}
    assert hit and kept == {r["doc_id"] for r in docs.collect()} - hit


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_exact_copies_with_short_lines_leave_no_stub(spark, make_docs, sf):
    text = "Title\nthis line is long enough to take part in it all\nHaanth.\nand so is this other line of the document"
    docs = make_docs([(1, text), (2, text), (3, text + "\n"), (4, "Title\nwords of its own that no other document has in it")])
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, sf).collect()}
    assert kept == {1: text, 4: "words of its own that no other document has in it"}


def test_stages_on_odd_rows(spark, sf):
    names = ["text_key", "near_id", "dropped", "rest", "own_doc_id", "rid", "hits", "fp", "h", "root", "kept", "score"]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    own = " ".join(f"word{i} of{i % 7} text{i % 11}" for i in range(60))
    texts = [(1, own), (1, own), (2, None), (3, ""), (None, own + " without an id"), (4, own), (5, f"{own}\nmore lines {own[::-1]}"), (6, " ".join(f"w{i}" for i in range(60_000))), (7, " \n\t")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *names) for i, t in texts], ddl)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert out.columns == docs.columns, name
        assert all([r[n] for n in names] == names for r in rows), name
        assert 6 in {r["doc_id"] for r in rows}, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len({(r["doc_id"], r["piece"]) for r in packed}) >= 8 and {r["doc_id"] for r in packed} == {i for i, _ in texts}


def test_run_packs_what_is_kept(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50


def test_every_operator_has_a_query():
    assert sorted(queries.queries(), key=lambda q: int(q[2:].split("_")[0])) == [q for n in range(1, 11) for q in queries.queries() if q.startswith(f"op{n}_")]
