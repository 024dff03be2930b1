"""Text functions as Column builders. All are JVM expressions but `nfc`, which sends only texts that may need it to Python."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import rules

WORD = r"[\p{L}\p{N}_]+"
BENGALI = r"[ঀ-৿]"
SPACE = r"[\s\x1c-\x1f]"
#: the characters of (?U)[\s\x1c-\x1f]
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
RUN = r"(?U)[\s\x1c-\x1f]+"
#: a boundary between word and other characters, marks being no word characters
EDGE = r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"


def pattern(source: str, flags: str = "") -> str:
    """A pattern of the rule lists for the JVM: Unicode classes, line ends at \\n alone, word edges that don't see marks.

    flags: i ignores case, m lets ^ and $ meet at lines.
    """
    out, inside, i = [], False, 0
    while i < len(source):
        c = source[i]
        if c == "\\" and i + 1 < len(source):
            two = source[i : i + 2]
            if two == r"\b" and not inside:
                word = source[i + 2 : i + 3]  # a letter that has to follow is looked for first, as the edge costs more
                two = f"(?={word}){EDGE}" if word.isalnum() and source[i + 3 : i + 4] not in ("?", "*", "{") else EDGE
            elif two == r"\w":
                two = r"\p{L}\p{N}_" if inside else r"[\p{L}\p{N}_]"
            elif two == r"\Z":
                two = r"\z"
            out.append(two)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "[":
            c = r"\["
        elif c == "]" and inside:
            inside = False
        elif c == "&" and inside:
            c = r"\&"
        out.append(c)
        i += 1
    return f"(?dU{flags})" + _firsts(source) + "".join(out)


def _firsts(source: str) -> str:
    """A look ahead for the first letters of the alternatives that a pattern begins with, which fails sooner than each of them."""
    if not source.startswith("(?:"):
        return ""
    depth, parts, i = 1, [""], 3
    while i < len(source) and depth:
        step = 2 if source[i] == "\\" else 1
        depth += {"(": 1, ")": -1}.get(source[i], 0)
        if source[i] == "|" and depth == 1:
            parts.append("")
        elif depth:
            parts[-1] += source[i : i + step]
        i += step
    plain = all((p[:1].isalnum() or p[:1] == "©") and p[1:2] not in ("?", "*", "{") for p in parts)
    bare = not any(c in "[]" for p in parts for c in p)  # classes may hold what counts above
    return f"(?=[{''.join(dict.fromkeys(p[0] for p in parts))}])" if plain and bare and source[i : i + 1] not in ("?", "*", "{", "|") else ""


def needed(source: str) -> str:
    """A mark among [ | ( that every match of a pattern has to hold, or empty."""
    depth, inside, i, found = 0, False, 0, ""
    while i < len(source):
        c, step = source[i], 2 if source[i] == "\\" else 1
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return ""
        elif step == 2 and depth == 0 and not found and source[i + 1] in "[|(" and source[i + 2 : i + 3] not in ("?", "*", "{"):
            found = source[i + 1]
        i += step
    return found


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once, however often use names it."""
    return F.element_at(F.transform(F.array(c), lambda x: use(x)), 1)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_filled(*columns: Column, default: str | None = None) -> Column:
    """The first value that is neither null nor empty."""
    rest = [F.lit(default)] if default is not None else []
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], *rest)


def trim(c: Column) -> Column:
    """Without white space of any kind at the ends. Only the ends are looked at, not each blank between."""
    return F.btrim(c, F.lit(BLANKS))


def holding(c: Column, marks: tuple[str, ...], use: Callable[[Column], Column]) -> Column:
    """use(c) where c holds one of the marks, and c elsewhere: for patterns that meet nothing without them, as a search for marks costs far less."""
    return once(c, lambda x: F.when(reduce(Column.__or__, [x.contains(m) for m in marks]), use(x)).otherwise(x))


def replace_all(c: Column, noise: list[tuple[str, str]], by: str = "") -> Column:
    """Each pattern's matches replaced, one pattern after the other. Texts in which none of them can match stay as they
    are: they lack the marks that some patterns need, and of the others none is found in one search for lines and one
    for the rest."""
    bare = [n for n in noise if not needed(n[0])]
    lines = [n for n in bare if n[0].startswith("^") and "m" in n[1] and _single(n[0])]
    scoped = lambda source, flags: f"(?dU{flags}:{pattern(source, flags).partition(')')[2]})"
    searches = ["(?dm)^(?:" + "|".join(scoped(s[1:], f) for s, f in lines) + ")"] if lines else []
    searches += ["|".join(scoped(*n) for n in bare if n not in lines)] if len(bare) > len(lines) else []

    def use(x: Column) -> Column:
        for mark, group in groupby(noise, lambda n: needed(n[0])):
            sources = [pattern(*n) for n in group]
            each = lambda y, own=sources: reduce(lambda z, p: F.regexp_replace(z, F.lit(p), F.lit(by)), own, y)
            x = holding(x, (mark,), each) if mark else each(x)
        return x

    marks = dict.fromkeys(m for n in noise if (m := needed(n[0])))
    return once(c, lambda x: F.when(reduce(Column.__or__, [*(x.contains(m) for m in marks), *(x.rlike(p) for p in searches)]), use(x)).otherwise(x))


def _single(source: str) -> bool:
    """Whether a pattern has no alternatives outside groups and classes."""
    depth, inside, i = 0, False, 0
    while i < len(source):
        c = source[i]
        if c == "[" or inside:
            inside = c != "]"
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return False
        i += 2 if c == "\\" else 1
    return True


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """Unicode normal form C. Below U+0300 every text is in that form already, and stays in the JVM."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[\x{0300}-\x{10FFFF}]"), c)), c)


# ---- words, tokens, languages


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text_or_empty(c), RUN), lambda w: w != "")


def word_count(c: Column) -> Column:
    own = trim(text_or_empty(c))
    return F.when(own == "", 0).otherwise(F.size(F.split(own, RUN)))


def terms(c: Column) -> Column:
    """Lower-case runs of word characters, with repeats."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(WORD), 0)


def tokens_by_chars(c: Column) -> Column:
    """Characters / 4, or / 3 where over a tenth is Bengali; at least 1."""
    n, bengali = F.length(text_or_empty(c)), F.regexp_count(text_or_empty(c), F.lit(BENGALI))
    return F.greatest(F.lit(1), F.when(bengali > n * 0.1, F.floor(n / 3)).otherwise(F.floor(n / 4)).cast("int"))


def tokens_by_words(c: Column) -> Column:
    return F.floor(word_count(c) * rules.TOKENS_PER_WORD + 1e-9).cast("int")


def contains_bengali(c: Column) -> Column:
    return text_or_empty(c).rlike(BENGALI)


def detect_language(c: Column) -> Column:
    """unknown, bn, en or mixed, by the share of Bengali among Bengali and ASCII letters of the first 2,000 characters."""

    def share(head: Column) -> Column:  # counts by what is left, without a string for each letter
        bengali = F.length(F.regexp_replace(head, "[^ঀ-৿]+", ""))
        english = F.length(head) - F.length(F.translate(head, string.ascii_letters, ""))
        return bengali / F.greatest(bengali + english, F.lit(1))

    named = once(once(F.substring(c, 1, 2000), share), lambda s: F.when(s > 0.6, "bn").when(s < 0.2, "en").otherwise("mixed"))
    return F.when(text_or_empty(c) == "", "unknown").otherwise(named)


def query_language(c: Column) -> Column:
    """bn with any Bengali character, bn_en with a romanised word, en otherwise."""
    latin = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z]+"), 0)
    return F.when(contains_bengali(c), "bn").when(F.arrays_overlap(latin, F.array(*map(F.lit, rules.ROMANISED))), "bn_en").otherwise("en")


def script_language(c: Column) -> Column:
    return F.when(contains_bengali(c), "bn").otherwise("en")


# ---- hashes and ids


def content_hash(c: Column) -> Column:
    return F.sha2(text_or_empty(c), 256)


def _slug(c: Column, each: str = "[^a-zA-Z0-9]") -> Column:
    return F.regexp_replace(F.regexp_replace(c, each, "_"), "^_+|_+$", "")


def document_id(url: Column, stem: Column) -> Column:
    """Slug of the url, or of the stem where that is empty, and eight digits of its MD5."""
    raw = first_filled(url, stem, default="")
    return F.concat(F.substring(F.lower(_slug(raw)), 1, 100), F.lit("__"), F.substring(F.md5(raw), 1, 8))


def url_slug(url: Column) -> Column:
    slug, digest = F.substring(F.lower(_slug(url)), 1, 160), F.substring(F.md5(url), 1, 8)
    return F.when(slug == "", digest).otherwise(F.concat(slug, F.lit("__"), digest))


def preprocessed_id(url: Column, stem: Column, digest: Column) -> Column:
    name = first_filled(_slug(stem, "[^a-zA-Z0-9]+"), default="document")
    return F.concat(name, F.lit("__"), F.substring(F.sha2(F.concat(text_or_empty(url), F.lit(":"), digest), 256), 1, 12))


def tree_id(stem: Column) -> Column:
    return F.concat(_slug(stem, "[^a-zA-Z0-9]+"), F.lit("_md"))


def chunk_id(document: Column, index: Column) -> Column:
    """Index padded to four digits, longer ones whole."""
    digits = index.cast("string")
    return F.concat(document, F.lit("__chunk_"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def url_chunk_id(url: Column, index: Column) -> Column:
    return F.md5(F.concat(url, F.lit("::"), index.cast("string")))


def vector_id(chunk: Column) -> Column:
    return F.sha2(chunk, 256)


def cache_key(query: Column) -> Column:
    return F.concat(F.lit(rules.CACHE_PREFIX), F.sha2(F.array_join(words(F.lower(query)), " "), 256))


def page_file_name(url: Column) -> Column:
    """Path and query of a url as a file name, cut to 200 characters, and eight digits of its MD5."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    path = first_filled(F.replace(path, F.lit("/"), F.lit("__")), default="index")
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    slug = F.when(query == "", path).otherwise(F.concat(path, F.lit("__"), F.regexp_replace(query, r"[^\p{L}\p{N}_-]", "_")))
    return F.concat(F.substring(F.regexp_replace(slug, r"[^\p{L}\p{N}_\-.]", "_"), 1, 200), F.lit("__"), F.substring(F.md5(url), 1, 8), F.lit(".md"))


def asset_file_name(title: Column, url: Column, extension: Column) -> Column:
    stem = F.substring(F.regexp_replace(F.regexp_replace(title, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", ""), 1, 120)
    stem = first_filled(stem, default="document")
    bare = F.when(F.lower(stem).endswith(extension) & stem.endswith(extension), F.substring(stem, F.lit(1), F.length(stem) - F.length(extension))).otherwise(stem)
    return F.concat(bare, F.lit("_"), F.substring(F.sha2(url, 256), 1, 12), extension)


def extract_base_name(url: Column) -> Column:
    """ASCII stem of a url's last path part, cut to 120 characters, and eight digits of the url's MD5."""
    path = F.try_url_decode(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, r"[^\x00-\x7f]", ""), r"[^A-Za-z0-9_\-]", "_"), "_+", "_")
    plain = F.substring(F.regexp_replace(plain, "^_+|_+$", ""), 1, 120)
    return F.concat(first_filled(plain, default="document"), F.lit("_"), F.substring(F.md5(url), 1, 8))


# ---- frontmatter and titles


def _front_parts(c: Column) -> Column:
    return F.when(c.startswith("---"), F.split(c, "---", 3))


def frontmatter(c: Column, quotes: bool = True) -> Column:
    """map of `key: value` lines between the first two `---`; of a repeated key the last line holds. quotes: strip them."""
    lines = F.filter(F.split(F.element_at(_front_parts(c), 2), "\n"), lambda x: x.contains(":"))
    value = lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))
    bare = lambda v: F.regexp_replace(F.regexp_replace(v, '^"+|"+$', ""), "^'+|'+$", "") if quotes else v
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), bare(value(x)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.when(F.size(_front_parts(c)) >= 3, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


def body(c: Column) -> Column:
    """The text after the frontmatter."""
    return F.when(F.size(_front_parts(c)) >= 3, trim(F.element_at(_front_parts(c), 3))).otherwise(c)


def write_frontmatter(pairs: list[tuple[str, Column]]) -> Column:
    """`---` lines around `key: value` of the filled values."""
    lines = [F.when(text_or_empty(v) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in pairs]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""))


def heading_title(c: Column, fallback: Column) -> Column:
    """Text of the first line that begins with #, or the fallback with _ and - as spaces."""
    line = F.regexp_extract(c, r"(?dm)^#[^\n]*$", 0)
    return F.when(line != "", F.trim(F.regexp_replace(line, "^#+", ""))).otherwise(F.trim(F.translate(fallback, "_-", "  ")))


def first_h1_title(c: Column, fallback: Column) -> Column:
    """Text of the first line that begins with `# `, or the fallback's words, capitalised."""
    line = F.regexp_extract(c, r"(?dm)^# ([^\n]*)$", 1)
    return F.when(F.trim(line) != "", F.trim(line)).otherwise(F.initcap(F.translate(fallback, "_-", "  ")))


# ---- cleaning


def _less_blank(c: Column) -> Column:
    """A run of blanks as one."""
    return holding(c, ("  ", "\t"), lambda x: F.regexp_replace(x, r"[ \t]{2,}", " "))


def _less_empty(c: Column) -> Column:
    """A run of empty lines as one."""
    return holding(c, ("\n\n\n",), lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n"))


def clean_text(c: Column) -> Column:
    """NFC, no control characters, line ends trimmed, runs of blanks and blank lines collapsed."""
    c = F.regexp_replace(nfc(text_or_empty(c)), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = holding(c, ("\r", "\x85", "\u2028", "\u2029"), lambda x: F.regexp_replace(x, r"\r\n|[\r\x{85}\x{2028}\x{2029}]", "\n"))
    return trim(_less_empty(_less_blank(F.regexp_replace(c, r"(?Ud)[^\S\n]++(?=\n|$)", ""))))


def normalize_text(c: Column) -> Column:
    c = _less_empty(holding(text_or_empty(c), ("\r",), lambda x: F.regexp_replace(x, r"\r\n?", "\n")))
    return trim(F.regexp_replace(c, r"[ \t]+", " "))


def _lines(c: Column) -> Column:
    return F.split(holding(c, ("\r",), lambda x: F.regexp_replace(x, r"\r\n|\r", "\n")), "\n")


def _collapse(lines: Column) -> Column:
    """Trimmed lines joined, a run of blank ones kept as one."""
    return trim(_less_empty(F.array_join(lines, "\n")))


def is_error_page(c: Column) -> Column:
    found = [text_or_empty(c).rlike(pattern(*p)) for p in rules.ERROR_PAGE]
    return found[0] | found[1]


def clean_page(c: Column) -> Column:
    """A crawled page without navigation, media and footer noise."""
    lines = F.transform(_lines(replace_all(text_or_empty(c), rules.PAGE_NOISE)), trim)
    bare = F.array(*[F.lit(x) for x in rules.BARE_LINES if x])
    empty_row = lambda x: x.startswith("|") & x.rlike(r"^\|[\s|-]*\|$") & ~x.rlike(r"-\s*-")  # noqa: E731  each cell blank or one dash
    return _collapse(F.filter(lines, lambda x: ~F.array_contains(bare, x) & ~empty_row(x)))


def clean_document(c: Column) -> Column:
    """A document's body without noise, its white space normal."""
    c = replace_all(text_or_empty(c), rules.DOCUMENT_NOISE)
    c = F.regexp_replace(holding(c, ("\r",), lambda x: F.regexp_replace(x, r"\r\n?", "\n")), r"[ \t]+", " ")
    return _collapse(F.transform(F.split(c, "\n"), trim))


def clean_for_chunks(c: Column) -> Column:
    """A document without frontmatter and navigation, from its first real heading, blank lines dropped."""
    c = once(nfc(text_or_empty(c)), body)
    lines = F.transform(_lines(trim(replace_all(trim(c), rules.CHUNK_NOISE))), trim)

    def from_content(own: Column) -> Column:
        starts = F.transform(own, lambda x: x.startswith("#") & x.rlike(pattern(rules.CONTENT_START, "i")))
        at = F.greatest(F.array_position(starts, True), F.lit(1)).cast("int")
        return F.filter(F.slice(own, at, F.size(own)), lambda x: ~x.isin("", "*", "-", "**", "***", "|", "||") & ~(x.startswith("(") & x.rlike(r"^\(https?://[^)]*\)$")))

    return trim(_less_blank(F.array_join(once(lines, from_content), "\n")))


def drop_short_lines(c: Column) -> Column:
    """Without lines of one or two characters."""
    kept = F.filter(_lines(text_or_empty(c)), lambda x: (F.length(trim(x)) >= 3) | (trim(x) == ""))
    return _collapse(kept)


def embedding_text(chain: Column, title: Column, content: Column) -> Column:
    """Heading chain, title and content of a chunk, links and images taken out, content cut at EMBED_CHARS."""
    c = holding(trim(text_or_empty(content)), ("![",), lambda x: F.regexp_replace(x, r"(?d)!\[.*?\]\(.*?\)", ""))
    c = holding(c, ("<",), lambda x: F.regexp_replace(x, r"(?i)<img[^>]*>", ""))
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = trim(holding(c, ("](",), lambda x: F.regexp_replace(x, r"\[([^\]]*)\]\([^)]*\)", "$1")))
    filled = F.coalesce(chain, F.array().cast("array<string>"))
    own = trim(text_or_empty(title))

    def joined(c: Column) -> Column:
        head = F.substring(c, 1, rules.EMBED_CHARS)
        space = F.length(head) - F.locate(" ", F.reverse(head))  # place of the last blank, from 0
        shorter = F.when((F.locate(" ", head) > 0) & (space > rules.EMBED_CHARS * rules.EMBED_SPACE_SHARE), F.substring(head, F.lit(1), space)).otherwise(head)
        cut = F.when(F.length(c) > rules.EMBED_CHARS, shorter).otherwise(c)
        parts = F.array(F.array_join(filled, " > "), F.when(F.array_contains(filled, own), "").otherwise(own), cut)
        told = F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")
        return F.when(c.startswith("*") & c.rlike(r"^(\s*\*\s*\[\s*\]\(\S+\)\s*\n?)+$"), "").otherwise(told)

    return once(c, joined)  # cleaned once, however often its ends are looked at


def html_text(c: Column) -> Column:
    """Text of an HTML page: scripts, styles, comments and tags out, entities read, a line for each run of text."""
    c = F.regexp_replace(text_or_empty(c), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<![^>]*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[/!a-zA-Z][^>]*>", "\n")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(value))
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), trim), lambda x: x != ""), "\n")


# ---- urls


def url_part(url: Column, part: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit(""))


def url_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(url_part(url, "HOST")), r"^www\.", "")


def url_extension(url: Column, extensions: list[str]) -> Column:
    """The first listed extension that the path ends with, or empty."""
    path = F.lower(url_part(url, "PATH"))
    return F.coalesce(*[F.when(path.endswith(e), e) for e in extensions], F.lit(""))


def asset_extension(url: Column, content_type: Column | None = None) -> Column:
    found = url_extension(url, rules.ASSET_EXTENSIONS)
    if content_type is None:
        return found
    kind = F.lower(text_or_empty(content_type))
    told = F.when(kind.contains("pdf"), ".pdf").when(kind.contains("word"), ".docx").when(kind.contains("spreadsheet") | kind.contains("excel"), ".xlsx").when(kind.contains("csv"), ".csv").otherwise("")
    return first_filled(found, told, default="")


def document_kind(url: Column) -> Column:
    """pdf, docx, xlsx, or null."""
    path = F.lower(url_part(url, "PATH"))
    return F.when(path.endswith(".pdf"), "pdf").when(path.rlike(r"\.docx?$"), "docx").when(path.rlike(r"\.xlsx?$"), "xlsx")


def trusted_host(url: Column) -> Column:
    host = F.lower(url_part(url, "HOST"))
    return host.isin(rules.TRUSTED_HOSTS) | host.endswith(rules.TRUSTED_SUFFIX)


def drive_download(url: Column) -> Column:
    own = F.regexp_extract(url_part(url, "PATH"), r"/file/d/([^/]+)", 1)
    found = first_filled(own, F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("id")), F.lit("")))
    return F.when((url_part(url, "HOST") == rules.DRIVE_HOST) & found.isNotNull(), F.format_string(rules.DRIVE_DOWNLOAD, found)).otherwise(url)


def safe_url(url: Column) -> Column:
    """Blanks and other unsafe characters percent-encoded, what is encoded already kept."""
    bad = F.array_distinct(F.regexp_extract_all(url, F.lit(r"[^A-Za-z0-9%/:?#\[\]@!$&'()*+,;=._~-]"), 0))
    return F.aggregate(bad, url, lambda u, c: F.replace(u, c, F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))))


def redirect_target(url: Column) -> Column:
    """The target of a search engine's redirect link, or the url with a scheme."""
    target = F.try_url_decode(F.regexp_extract(url, r"[?&]uddg=([^&]*)", 1))
    return F.when(text_or_empty(target) != "", target).when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def glob_pattern(glob: str) -> str:
    return "^" + "".join(".*" if c == "*" else re.escape(c) for c in glob) + "$"


def crawlable(url: Column, content_type: Column | None = None, site: str = rules.SITE) -> Column:
    """On the site, no low-value pattern, HTML."""
    host = F.lower(url_part(url, "HOST"))
    low = F.lit(False)
    for glob in rules.LOW_VALUE_URLS:
        low = low | url.rlike(glob_pattern(glob))
    ok = ((host == site) | host.endswith(f".{site}")) & ~low
    return ok if content_type is None else ok & F.lower(text_or_empty(content_type)).contains("text/html")


def crawl_priority(url: Column) -> Column:
    """Weighted share of priority words in the url."""
    hits = [F.lower(url).contains(w).cast("int") for w in rules.PRIORITY_WORDS]
    return F.aggregate(F.array(*hits), F.lit(0), lambda a, b: a + b) / len(hits) * rules.PRIORITY_WEIGHT


# ---- tables, lists and headings in lines


def is_table_line(c: Column) -> Column:
    return trim(c).startswith("|") & trim(c).endswith("|")


def is_list_line(c: Column) -> Column:
    return trim(c).rlike(r"^[-*+]\s") | trim(c).rlike(r"^\d+[.)]\s") | F.lower(trim(c)).rlike(r"^[ivxlcdm]+[.)]\s")


def heading_level(c: Column) -> Column:
    """Number of leading #, or null."""
    marks = F.regexp_extract(trim(c), r"^(#+)\s", 1)
    return F.when(marks != "", F.length(marks))


def table_rows(c: Column) -> Column:
    """Cells of a markdown table's lines, separator lines left out."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"^\s*\|[\s|:\-]+\|\s*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)))


def markdown_table_count(c: Column) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(r"\n\|"))


def markdown_table(headers: Column, rows: Column) -> Column:
    """A markdown table of header and row arrays: pipes escaped, short rows padded."""
    cell = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))
    width = F.size(headers)
    padded = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.concat_ws("\n", line(headers), rule, F.array_join(F.transform(rows, lambda r: line(padded(r))), "\n"))


def sentences(c: Column) -> Column:
    """Sentences: parted after . ! ? or danda and at blank lines."""
    return F.filter(F.transform(F.split(text_or_empty(c), "(?U)" + rules.SENTENCE_END), trim), lambda s: s != "")
