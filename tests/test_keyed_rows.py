import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import components, dedup, retrieval
from textloom.plans.engine import Engine
from textloom.sources import readers, sinks


def walk(rows):
    """Rows (url, hash, order) that a plain walk in order accepts."""
    urls, hashes, kept = set(), set(), []
    for url, digest, n in sorted(rows, key=lambda r: r[2]):
        if not (url and url in urls) and digest not in hashes:
            urls.add(url)
            hashes.add(digest)
            kept.append(n)
    return kept


@pytest.mark.parametrize("seed", range(2))
def test_greedy_equals_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["", *map(str, range(40))]), f"h{rng.randrange(40)}", i) for i in range(120)]
    rows += [(f"own{i}", "the empty page", 200 + i) for i in range(150)]  # one hash of many urls
    rows += [("the same url", f"version {i}", 400 + i) for i in range(50)]
    chain = [(f"c{(i + 1) // 2}", f"d{i // 2}", 1000 + i) for i in range(260)]  # each shares its hash or its url with the next
    rng.shuffle(chain)
    rows += [(u, h, 1000 + k) for k, (u, h, _) in enumerate(chain)]
    df = spark.createDataFrame(rows, "url string, hash string, place long")
    assert sorted(r["place"] for r in dedup.greedy(df, "place").collect()) == walk(rows)


def test_components_of_a_long_chain(spark):
    links = spark.range(300).selectExpr("id a", "id + 1 b")
    assert {tuple(r) for r in components.connected(links).collect()} == {(i, 0) for i in range(301)}
    assert components.connected(links.limit(0)).count() == 0


def test_the_last_new_row_of_a_key_holds(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "id long, value string, age string")
    new = spark.createDataFrame([(1, "c", "y"), (3, "d", "y"), (1, "e", "y"), (3, "f", "y")], "id long, value string, age string").coalesce(1)
    assert {tuple(r) for r in sinks.merged(old, new, "id").collect()} == {(1, "e", "y"), (2, "b", "x"), (3, "f", "y")}
    by_value = sinks.merged(old, new.repartition(3), "id", F.col("value"))
    assert {tuple(r) for r in by_value.collect()} == {(1, "e", "y"), (2, "b", "x"), (3, "f", "y")}


def test_columns_named_like_inner_ones_stay(spark):
    names = ["place", "_rank", "source", "age", "_hash", "_prefix", "_age"]
    rows = spark.createDataFrame([(i, f"u{i % 2}", f"content {i % 3}", i, *names) for i in range(6)], "doc_id long, url string, content string, token_count int, " + ", ".join(f"`{n}` string" for n in names))
    outs = [
        dedup.first_of(rows, ["url"], [F.col("doc_id")]),
        dedup.by_content(rows, "content"),
        dedup.first_seen([rows, rows], "url", "doc_id"),
        dedup.exact_chunks(rows, order="doc_id"),
        dedup.by_prefix(rows, order="doc_id"),
        sinks.merged(rows, rows, "doc_id"),
    ]
    for out in outs:
        assert out.columns == rows.columns
        for r in out.collect():
            assert [r[n] for n in names] == names


def test_vectors_of_zeros_have_no_score(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 0.0])], "query_id long, embedding array<double>")
    out = [(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.dense_top_k(asked, vectors, 5).orderBy("rank").collect()]
    assert out == [(7, 1, 1), (7, 3, 2)]


def test_filters_hold_before_the_best_are_chosen(spark):
    vectors = spark.createDataFrame([(i, [1.0, i / 100], "dm" if i >= 90 else "sdm") for i in range(100)], "doc_id long, embedding array<double>, office string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], {"office": "dm", "absent": "x"}), (2, [1.0, 0.0], {})], "query_id long, embedding array<double>, filters map<string,string>")
    keep = retrieval.eligible(asked, vectors, "doc_id", ["office", "absent"])
    out = retrieval.dense_top_k(asked, vectors, 3, keep=keep).collect()
    assert {(r["query_id"], r["doc_id"]) for r in out} == {(1, 90), (1, 91), (1, 92), (2, 0), (2, 1), (2, 2)}
    assert retrieval.eligible(asked, vectors.drop("office"), "doc_id", ["office"])(vectors) is vectors


def test_uploads_and_other_documents_outlive_an_ingest(spark, tmp_path):
    body = " ".join(f"Sentence number {i} of the page speaks of the office and its hours." for i in range(30))

    def pages(folder, names):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / f"{n}.md").write_text(f"---\nurl: https://x.y/{n}\n---\n# Page {n}\n\nWords of {n} in {folder}. {body.replace('office', n)}\n")
        return readers.pages(spark, str(tmp_path / folder))

    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.ingest(pages("one", ["a", "b"]))
    upload = spark.createDataFrame([("/u/note.txt", bytearray(("A note on water supply. " * 10).encode()))], "path string, content binary")
    engine.append_document(upload)
    before = engine.tables["chunks"].read().select("chunk_id", "document_id", "content").collect()
    engine.ingest(pages("two", ["b", "c"]))
    after = engine.tables["chunks"].read().select("chunk_id", "document_id", "content").collect()
    uploads = [r for r in before if r["chunk_id"].startswith("upload-")]
    assert len(uploads) == 1 and uploads == [r for r in after if r["chunk_id"].startswith("upload-")]
    told = " ".join(r["content"] for r in after)
    assert "Words of a in one" in told and "Words of b in two" in told and "Words of c in two" in told and "Words of b in one" not in told
