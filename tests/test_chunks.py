import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import chunking as C
from textloom.functions import markdown as M
from textloom.functions import rules
from textloom.operators import chunks

DOC = "# Title\n\nIntro line one.\nline two.\n\n## Part A\n- item one\n- item two\n  continued\n\n| h1 | h2 |\n|----|----|\n| 1 | 2 |\n\n```py\ncode\n```\n\n> quote here\n\n### Sub\nText under sub.\n\n***\n\n1) first\n2) second\n"
LINE = st.sampled_from(["# A", "## B", "### C", "##### E", "para one two three.", "more words here! And again?", "- item", "1. step", "| a | b |", "|---|---|", "```", "---", "", "  indented", "> q", "*", "word " * 30])


def test_blocks():
    blocks = M.parse_blocks(DOC)
    assert [b.kind for b in blocks] == ["heading", "paragraph", "heading", "list", "table", "code", "paragraph", "heading", "paragraph", "divider", "list"]
    assert [b.position for b in blocks] == list(range(11))
    assert blocks[3].items == ["item one", "item two"] and not blocks[3].ordered and blocks[3].text.endswith("  continued")
    assert blocks[4].headers == ["h1", "h2"] and blocks[4].rows == [["1", "2"]]
    assert blocks[5].language == "py" and blocks[5].text == "```py\ncode\n```" and blocks[10].ordered
    assert M.headings(blocks) == [(1, "Title"), (2, "Part A"), (3, "Sub")] and M.title_of(blocks) == "Title" and M.title_of([], "x") == "x"


@settings(max_examples=200, deadline=None)
@given(st.lists(LINE, max_size=25))
def test_blocks_keep_every_line_in_order(lines):
    blocks = M.parse_blocks("\n".join(lines))
    inside = [x for x in "\n".join(b.text for b in blocks).split("\n") if x.strip() and not x.startswith("```")]
    assert inside == [x for x in "\n".join(lines).split("\n") if x.strip() and not x.startswith("```")]


def test_heading_sections():
    tree = M.heading_tree("pre\n# A\npara\n- l1\n## B\n|a|\nx\n##### deep\n# C")
    assert M.sections(tree) == [([], [("paragraph", "pre")]), (["A"], [("list", "- l1"), ("paragraph", "para")]), (["A", "B"], [("table", "|a|"), ("paragraph", "x\n##### deep")])]


def test_document_tree():
    tree = M.document_tree(DOC)
    kinds = [(tuple(c), k) for c, k, _ in M.tree_blocks(tree)]
    assert (("Title", "Part A"), "list") in kinds and (("Title", "Part A"), "blockquote") in kinds and (("Title", "Part A", "Sub"), "paragraph") in kinds
    assert tree.children[0].title == "Title" and tree.children[0].children[1].title == "Part A"


def words(n, tag="w"):
    return " ".join(f"{tag}{i}." for i in range(n))


def test_hierarchy_chunks_follow_headings_and_budget():
    budget = C.Budget(target=40, most=50, least=8, tokens=lambda t: len(t.split()))
    text = f"# A\n{words(20)}\n\n## B\n{words(120, 'b')}\n\n### C\n{words(10, 'c')}\n\n---\n\n{words(12, 'd')}\n\n## E\n{words(3, 'e')}"
    made = C.hierarchy_of(text, "T", budget)
    assert all(c.tokens <= 50 for c in made)
    assert [c.section for c in made][:2] == ["A", "A"] and made[-1].chain
    joined = " ".join(c.text for c in made)
    assert [w for w in re.findall(r"[a-z]+\d+\.", joined)] == [w for w in re.findall(r"[a-z]+\d+\.", text)]


def test_hierarchy_chain_rules():
    budget = C.Budget(target=40, most=50, least=2, tokens=lambda t: len(t.split()))
    groups = C._groups(M.parse_blocks("### X\na b\n## Y\nc d\n#### Z\ne f\n---\ng h"), budget)
    assert [g[0] for g in groups] == [["X"], ["X", "Y"], []]
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| r{i} | x |" for i in range(40))
    parts = C._pieces(table, "table", budget)
    assert len(parts) > 1 and all(p.startswith("| a | b |\n|---|---|\n") for p in parts)
    assert C._merged_chain(["A", "B"], ["A", "C", "D"]) == ["A", "C"] and C._merged_chain([], ["Q"]) == ["Q"]


def test_small_neighbours_merge_only_along_the_chain():
    budget = C.Budget(target=40, most=50, least=10, tokens=lambda t: len(t.split()))
    a, b, c = (C.Chunk(words(4), chain, 4) for chain in (["A"], ["A", "B"], ["C"]))
    made = C._merge_small([a, b, c], budget)
    assert [x.chain for x in made] == [["A", "B"], ["C"]] and made[0].tokens == 8


@settings(max_examples=150, deadline=None)
@given(st.lists(LINE, max_size=40))
def test_chunkers_never_lose_a_word(lines):
    text = "\n".join(lines)
    blocks = [b for b in M.parse_blocks(text) if b.kind != "divider"]
    wanted = set(re.findall(r"[a-z]+", " ".join(b.text for b in blocks)))
    for made in ([c.text for c in C.hierarchy_of(text)], C.fixed_chunks(text), C.overlap_chunks(text)):
        assert wanted <= set(re.findall(r"[a-z]+", " ".join(made)))


def test_fixed_chunks():
    text = "Sentence one is here. " * 60
    made = C.fixed_chunks(text, 200, 40)
    assert all(len(m) <= 200 for m in made) and all(m.endswith(".") for m in made)
    assert C.fixed_chunks("", 10, 2) == [] and C.fixed_chunks("abc", 10, 2) == ["abc", "bc"]  # a tail of the overlap's length


def test_overlap_chunks():
    text = " ".join(f"This is sentence number {i} of the text." for i in range(150))
    made = C.overlap_chunks(text, 100, 20)
    for a, b in zip(made, made[1:], strict=False):
        first = C.split_sentences(b)[0]
        assert first in a
    assert C.overlap_chunks("w " * 1000, 100, 20) == [" ".join(" ".join(["w"] * 77) for _ in range(13))[: 2 * 1000 - 1]]


def test_word_and_section_and_semantic_chunks():
    made = C.word_chunks(M.parse_blocks(f"# A\n{words(40)}\n\n## B\n{words(2)}\n\n| {words(60)} |"), 50, 10)
    assert [h for h, _ in made] == ["A", "B", "B"]
    assert C.word_chunks(M.parse_blocks("# A"), 50, 10) == []
    parts = M.sections(M.heading_tree(f"# A\n{words(10)}\n|t|\n{words(5, 'z')}\n- list"))
    texts = [c.text for c in C.section_chunks(parts)]
    assert all(t.startswith("A\n\n") for t in texts)
    assert words(10) in texts[0] and words(10) in texts[3] and "z0." in texts[3]  # a buffer that a table ends stands again
    tree = M.document_tree(f"# A\n{words(200)}\n\n- x\n- y\n\nshort.")
    made = C.semantic_chunks(tree)
    assert [c.has_list for c in made] == [False, True] and made[0].chain == ["A"]


def test_chat_pieces():
    text = "line of text\n" * 900
    made = C.chat_pieces(text)
    assert all(len(m) <= rules.CHAT_CHARS for m in made) and "".join(m.replace("\n", "") for m in made) == text.replace("\n", "")
    assert C.chat_pieces("x" * 9000) == ["x" * 4000, "x" * 4000, "x" * 1000] and C.chat_pieces("") == []


def test_chunk_tables(spark):
    docs = spark.createDataFrame([("d1", "T", "u", "en", f"---\nurl: u\n---\n# Real\n{words(900)}"), ("d2", "T", "u", "en", "tiny"), ("d3", None, None, None, None)], "document_id string, title string, url string, language string, content string")
    rows = sorted(chunks.production(docs).collect(), key=lambda r: r["chunk_index"])
    assert {r["document_id"] for r in rows} == {"d1"} and [r["chunk_index"] for r in rows] == list(range(len(rows))) and len(rows) > 1
    assert rows[0]["next_chunk_id"] == rows[1]["chunk_id"] and rows[1]["previous_chunk_id"] == rows[0]["chunk_id"] and all(r["total_chunks"] == len(rows) for r in rows)
    for fn in (chunks.by_words, chunks.by_section, chunks.semantic, chunks.blocks, chunks.sections, chunks.tree):
        assert fn(docs).count() >= 0
    assert chunks.fixed(docs, "document_id").where("char_count > 600").count() == 0
    large = spark.createDataFrame([("c1", "Big", words(900), 1170), ("c2", "Small", "x", 5)], "chunk_id string, title string, content string, token_count int")
    out = {r["chunk_id"]: r for r in chunks.split_large(large).collect()}
    n = len(out) - 1
    assert out["c2"]["title"] == "Small" and out["c1_part_0"]["title"] == f"Big (Part 1/{n})" and n > 1


def test_normalized_uploaded_payload(spark):
    raw = spark.createDataFrame([("", None, "text a", "f1"), ("x", None, "  ", "f2"), ("y", "c", None, "f3")], "chunk_id string, content string, text string, file string")
    out = {r["chunk_id"]: r["content"] for r in chunks.normalized(raw).collect()}
    assert out == {"f1": "text a", "y": "c"}
    up = chunks.uploaded(spark.createDataFrame([("/a/b.txt", bytearray(b"hi \xff"))], "path string, content binary")).first()
    assert up["title"] == "b.txt" and up["content"].startswith("hi") and re.fullmatch(r"upload-[0-9a-f]{8}-0", up["chunk_id"])
    docs = spark.createDataFrame([("d1", "T", "", "en", f"# Real\n{words(30)}")], "document_id string, title string, url string, language string, content string")
    got = chunks.payload(chunks.production(docs)).first()["metadata"]
    assert got["section"] == "Real" and "url" not in got and got["chunk_id"] == "d1__chunk_0000"
    assert chunks.enriched(spark.createDataFrame([("d", "u", 1, ["A", "B"], "x")], "document_id string, url string, place int, heading_chain array<string>, text string")).select(F.col("section")).first()[0] == "B"


def test_few_documents_and_rows_are_held(monkeypatch):
    """Of a large Arrow batch only some documents are read and only some text is held before it goes on."""
    import pyarrow as pa

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    taken = []
    make = lambda k, t: taken.append(k) or [(k, 0, 1, t)]
    run = chunks.per_document(Docs(), make, ["key", "text"], chunks._PIECE, chunks._PIECE_DDL)
    n, text = 900, "x" * 20_000
    sizes = [b.num_rows for b in run(iter([pa.record_batch([[str(i) for i in range(n)], [text] * n], ["key", "text"])]))]
    assert sum(sizes) == n == len(taken) and max(sizes) * len(text) <= chunks.BATCH_BYTES + len(text)


def test_tokens_of_long_texts_are_told_without_a_look_at_each_character():
    import timeit

    text = "é" + "plain words " * 100_000
    slow = timeit.timeit(lambda: sum("ঀ" <= c <= "৿" for c in text), number=1)
    assert timeit.timeit(lambda: C.estimate(text), number=1) < slow / 2 and C.estimate("শাসক" * 9 + "a") == 37 // 3
