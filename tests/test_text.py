import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import rules
from textloom.functions import text as T

PAGES = [
    "[ Skip to main content ](#a)\n* Search Search\n# Title\n\n\n\nText  one\n| - | - |\n![logo](x/logo.png)\nCopyright 2024 all\n---\nlast",
    "# Server Error\n404",
    "High Contrast mode\n* Font Size Increase\nplain\n|[a](b)|[c](d)|\n| cell | é |\n[Back to Top](#t)\nHome\n** About **\nPrivacy Policy here",
    "Accessibility Tools\nstill here\nText Size big\nmore",
    "---\nurl: x\n---\n# More Menu\n* [a](b)\n## Real start\nপাঠ্য ফন্ট সাইজ\nContent Owned by us\n()\n(https://x.y/z)\n*\n- item\n  spaced   out  ",
    "", "one line", "a\r\nb\rc\n\n\n\nd \t e\n", "Hosted by NIC\nlogo bar1.gif back2top\n|\n| **x** |\n", "é combining \x07 control\x7f \n x", "## Home\n## Search\n# Notice\nbody",
]
FLAGS = {"i": re.IGNORECASE, "m": re.MULTILINE}


def flags(names):
    out = 0
    for n in names:
        out |= FLAGS[n]
    return out


def strip_all(text, noise):
    for source, names in noise:
        text = re.sub(source, "", text, flags=flags(names))
    return text


def page(text):
    lines, kept = strip_all(text, rules.PAGE_NOISE).splitlines(), []
    for line in map(str.strip, lines):
        if not line:
            if kept and kept[-1]:
                kept.append("")
        elif line not in rules.BARE_LINES and not (line.startswith("|") and line.endswith("|") and all(c.strip() in ("", "-") for c in line[1:-1].split("|"))):
            kept.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def document(text):
    text = re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", strip_all(text, rules.DOCUMENT_NOISE)))
    kept = []
    for line in map(str.strip, text.splitlines()):
        if line or (kept and kept[-1]):
            kept.append(line)
    return "\n".join(kept).strip()


def for_chunks(text):
    text = unicodedata.normalize("NFC", text)
    parts = text.split("---", 2)
    text = parts[2].strip() if text.startswith("---") and len(parts) == 3 else text.strip()
    lines = strip_all(text, rules.CHUNK_NOISE).splitlines()
    start = next((i for i, x in enumerate(lines) if re.match(rules.CONTENT_START, x.strip(), re.I)), 0)
    kept = [x.strip() for x in lines[start:]]
    kept = [x for x in kept if x and x not in ("*", "-", "**", "***", "|", "||") and not re.fullmatch(r"\(https?://[^)]*\)", x)]
    return re.sub(r"[ \t]{2,}", " ", "\n".join(kept)).strip()


def column(spark, fn, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fn(F.col("t")).alias("v")).collect()
    return [r["v"] for r in sorted(rows)]


@pytest.mark.parametrize("native,walk", [(T.clean_page, page), (T.clean_document, document), (T.clean_for_chunks, for_chunks)])
def test_cleaning_equals_a_walk(spark, native, walk):
    got = column(spark, native, PAGES)
    for text, g in zip(PAGES, got, strict=True):
        assert g == walk(text), repr(text)


def test_clean_text(spark):
    def walk(t):
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", unicodedata.normalize("NFC", t))
        t = "\n".join(re.sub(r"[ \t]{2,}", " ", x.rstrip()) for x in t.splitlines())
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    assert column(spark, T.clean_text, PAGES) == [walk(t) for t in PAGES]


def test_words_terms_tokens_languages(spark):
    texts = ["", None, "one  two\n", "জেলা শাসক office", "দপ্তর", "a b c_d-e1", "ki kora", "x" * 41]
    assert column(spark, T.word_count, texts) == [len((t or "").split()) for t in texts]
    assert column(spark, T.terms, texts) == [re.findall(r"\w+", (t or "").lower()) for t in texts]
    bengali = [sum("ঀ" <= c <= "৿" for c in t or "") for t in texts]
    assert column(spark, T.tokens_by_chars, texts) == [max(1, len(t or "") // (3 if b > len(t or "") * 0.1 else 4)) for t, b in zip(texts, bengali, strict=True)]
    assert column(spark, T.tokens_by_words, texts) == [int(len((t or "").split()) * 1.3) for t in texts]
    assert column(spark, T.detect_language, texts) == ["unknown", "unknown", "en", "mixed", "bn", "en", "en", "en"]
    assert column(spark, T.query_language, texts) == ["en", "en", "en", "bn", "bn", "en", "bn_en", "en"]


def test_ids(spark):
    row = spark.createDataFrame([("https://A.b/c d?x=1", "my file-name.v2", "")], "u string, s string, e string").select(
        T.document_id(F.col("u"), F.col("s")).alias("a"), T.document_id(F.col("e"), F.col("s")).alias("b"), T.chunk_id(F.lit("d"), F.lit(12345)).alias("c"), T.chunk_id(F.lit("d"), F.lit(7)).alias("d"),
        T.cache_key(F.lit("  Hello   World ")).alias("k"), T.page_file_name(F.lit("https://a.b/x/y/?q=1&r=2")).alias("f"), T.asset_file_name(F.lit("A form.pdf"), F.lit("u"), F.lit(".pdf")).alias("n"), T.tree_id(F.lit("example.page")).alias("t"), T.preprocessed_id(F.lit("u"), F.lit("p q"), F.lit("h")).alias("p"),
    ).first()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()[:8]
    assert row["a"] == f"https___a_b_c_d_x_1__{md5('https://A.b/c d?x=1')}" and row["b"] == f"my_file_name_v2__{md5('my file-name.v2')}"
    assert row["c"] == "d__chunk_12345" and row["d"] == "d__chunk_0007"
    assert row["k"] == "rag:answer:" + hashlib.sha256(b"hello world").hexdigest()
    assert row["f"] == f"x__y__q_1_r_2__{md5('https://a.b/x/y/?q=1&r=2')}.md"
    assert row["n"] == f"A_form_{hashlib.sha256(b'u').hexdigest()[:12]}.pdf" and row["t"] == "example_page_md"
    assert row["p"] == f"p_q__{hashlib.sha256(b'u:h').hexdigest()[:12]}"


def test_embedding_text(spark):
    long = "word " * 600
    rows = [(["A", "B"], "T", f"![i](x) see [l](u) <img src=x>\x01{long}"), (None, "", " * [ ](u)\n"), (["T"], "T", ""), ([], " x ", "y" * 3000)]
    got = [r[0] for r in spark.createDataFrame(rows, "c array<string>, t string, x string").select(T.embedding_text(F.col("c"), F.col("t"), F.col("x"))).collect()]
    assert got[0].startswith("A > B\n\nT\n\nsee l word word") and len(got[0]) <= len("A > B\n\nT\n\n") + 2048 and not got[0].endswith(" ")
    assert got[2] == "T" and got[3] == "x\n\n" + "y" * 2048


def test_urls(spark):
    urls = ["https://www.A.gov.in/x.PDF", "//a.b/c", "https://d.g/l/?uddg=https%3A%2F%2Fz.y%2F&r=1", "https://a.b/c d/é?q=1%20"]
    assert column(spark, T.url_domain, urls)[0] == "a.gov.in"
    assert column(spark, T.redirect_target, urls)[1:3] == ["https://a.b/c", "https://z.y/"]
    assert column(spark, T.safe_url, urls)[3] == "https://a.b/c%20d/%C3%A9?q=1%20"
    site = [f"https://{rules.SITE}/form", f"https://{rules.SITE}/gallery/a", f"https://{rules.SITE}/a.css", "https://else.org/form"]
    assert column(spark, T.crawlable, site) == [True, False, False, False]


def test_tables_and_lines(spark):
    assert column(spark, T.table_rows, ["| a | b |\n|---|:-:|\n| 1 | |"]) == [[["a", "b"], ["1", ""]]]
    assert column(spark, T.heading_level, ["## x", "#x", " ### y"]) == [2, None, 3]
    assert column(spark, T.is_list_line, ["- a", "1) b", "iv. c", "x y", "-a"]) == [True, True, True, False, False]
    row = spark.range(1).select(T.markdown_table(F.array(F.lit("a"), F.lit("b|c")), F.array(F.array(F.lit("1")), F.array(F.lit("2"), F.lit("3"))))).first()[0]
    assert row == "| a | b\\|c |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"
    assert column(spark, T.sentences, ["One. Two!  Three\n\nFour। পাঁচ?"]) == [["One.", "Two!", "Three", "Four।", "পাঁচ?"]]
    assert column(spark, T.html_text, ["<p>a<script>x</script><b>b &amp; c</b><!-- z --></p>"]) == ["a\nb & c"]


def test_noise_is_replaced_as_by_each_pattern_in_turn(spark):
    """Texts are searched for any noise first; what is found then is what the patterns find one after the other."""
    assert [T.needed(s) for s in (r"^\s*!\[.*\]\(.*\)\s*$", r"\[?x", r"a|\[", r"(\[)x", r"^\|[\[]+$", r"\(https?://[^)]*\)")] == ["[", "", "", "", "|", "("]
    assert T.pattern(r"\blogo") == "(?dU)(?=l)" + T.EDGE + "logo" and T.pattern(r"(?:Ab|C)d", "i").startswith("(?dUi)(?=[AC])")
    texts = ["plain prose", "", " | \nHome\nx", "a logo, alogo", "x\n* Search  Search\n[Site Map] Sitemap ]", "Privacy  Policy y\nz", "![a](b) [c](d)", "diſclaimer x", "## 404 - y\nz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for noise in (rules.PAGE_NOISE, rules.DOCUMENT_NOISE, rules.CHUNK_NOISE):
        each = F.col("t")
        for p in noise:
            each = F.regexp_replace(each, F.lit(T.pattern(*p)), F.lit(""))
        assert df.where(T.replace_all(F.col("t"), noise) != each).count() == 0


def test_texts_are_cleaned_once(spark):
    """However often an embedding text looks at its content, and however many letters a language is told by."""
    df = spark.createDataFrame([("a [b](c) ",)], "t string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan(T.embedding_text(F.array(), F.lit(""), F.col("t"))).count("regexp_replace(") <= 5
    assert "regexp_count" not in plan(T.detect_language(F.col("t")))
    assert "regexp" not in plan(T.trim(F.col("t")))
