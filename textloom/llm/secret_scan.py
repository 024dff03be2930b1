"""Secret scans: stated patterns, and tokens that a battery of randomness tests tells from written words.

Candidate tokens are runs of 20 or more letters, digits, `+`, `/`, `_` and `-`. The smallest alphabet that holds all
its characters is taken as a token's encoding (digits alone are numbers and not candidates). Over that alphabet the
battery computes p-values of randomness:
  uniformity   chi-squared of the symbol counts, upper tail,
  runs         Wald-Wolfowitz runs of character classes (of the alphabet's halves, where it has one class), lower tail,
  correlation  lag-one serial correlation of the symbols' places, both tails.
Fisher's rule joins the three to one number between 0 and 1, a token's randomness: even for random tokens, near 0 for
written ones.

A discovery is a token whose randomness no written token of its encoding and length would show. How random written
tokens look is fitted from the corpus itself: every text gives one token of its own words, glued as programs glue them,
for each NULL_EVERY characters, its encoding and length in turn. A candidate's p-value is the share of these (of its
stratum, one more counted) that look at least as random. Discoveries are chosen by Benjamini and Hochberg's procedure
in each stratum of encoding and length over every candidate: nothing is vetoed before or after. Pass one writes spans
and randomness and counts the glued tokens, histograms of bounded size give each stratum's cut, pass two applies the
cuts to the written spans. A small corpus has few glued tokens, hence no small p-values, and reports little.

Defined cases: a null or empty text has no spans, counts zero and the digest of the empty string; overlapping method
spans give way to those of the stated patterns; repeated rows and null doc_ids each keep their row; ties of start are
ordered by kind; texts and tokens of any length are tested whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, batch, cut_map, only

MIN_TOKEN = 20
FALSE_DISCOVERIES = 0.01
BINS = 200  # of randomness, even ones
NULL_EVERY = 250  # characters of text for each glued token
LENGTHS = (20, 32, 48, 80)  # where length classes begin
LONGEST_GLUED = 160
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_TOKEN)
_WORD = re.compile(r"[A-Za-z]{2,15}")
_WORDS = ("password", "passwd", "secret", "token", "api")

_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
#: name and symbols in order, narrower alphabets first
ENCODINGS = [
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("lower", _LOWER),
    ("upper", _UPPER),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/-_"),
]
_SETS = [frozenset(s) for _, s in ENCODINGS]


def _table(symbols: str, value) -> np.ndarray:
    out = np.zeros(128, np.int64)
    for i, c in enumerate(symbols):
        out[ord(c)] = value(i, c)
    return out


_PLACES = [_table(s, lambda i, c: i) for _, s in ENCODINGS]
_CLASSES = [_table(s, lambda i, c: 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3) for _, s in ENCODINGS]
_CLASSES = [_table(s, lambda i, c, half=len(s) / 2: int(i >= half)) if len({int(k[ord(c)]) for c in s}) == 1 else k for (_, s), k in zip(ENCODINGS, _CLASSES, strict=True)]
#: chance that two random neighbours are of one class, and of three in a row
_SAME = [sum((np.bincount(k[[ord(c) for c in s]]) / len(s)) ** 2) for (_, s), k in zip(ENCODINGS, _CLASSES, strict=True)]
_SAME3 = [sum((np.bincount(k[[ord(c) for c in s]]) / len(s)) ** 3) for (_, s), k in zip(ENCODINGS, _CLASSES, strict=True)]


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding_of(token: str) -> int | None:
    """Index of the first encoding that holds every character; None for plain numbers."""
    own = set(token)
    if own <= set(_DIGITS):
        return None
    return next(i for i, s in enumerate(_SETS) if own <= s)


def battery(token: str, encoding: int) -> tuple[float, float, float]:
    """p-values of randomness: chi-squared uniformity (upper tail), class runs (lower tail), serial correlation (both tails)."""
    size, n = len(ENCODINGS[encoding][1]), len(token)
    raw = np.frombuffer(token.encode(), np.uint8)
    x = _PLACES[encoding][raw]
    counts = np.bincount(x)
    chi = float((counts * counts).sum()) * size / n - n
    k = size - 1
    cube = (max(chi, 0) / k) ** (1 / 3)  # Wilson and Hilferty's normal form
    uniform = _upper_tail((cube - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))
    classes = _CLASSES[encoding][raw]
    changes = int(np.count_nonzero(classes[1:] != classes[:-1]))
    same, same3 = _SAME[encoding], _SAME3[encoding]
    change = 1 - same
    spread = math.sqrt((n - 1) * change * same + 2 * max(n - 2, 0) * (1 - 2 * same + same3 - change * change))
    runs = 1 - _upper_tail((changes + 0.5 - (n - 1) * change) / spread)
    away = x - x.mean()
    power = float(away @ away)
    serial = float(away[1:] @ away[:-1]) / power if power else 1.0
    return uniform, runs, 2 * _upper_tail(abs(serial + 1 / n) * math.sqrt(n))


def randomness(token: str, encoding: int) -> float:
    """The battery joined by Fisher's rule: even between 0 and 1 for random tokens."""
    half = -sum(math.log(max(p, 1e-300)) for p in battery(token, encoding))
    return math.exp(-half) * (1 + half + half * half / 2)  # upper tail of chi-squared with six degrees


def length_class(n: int) -> int:
    return bisect_right(LENGTHS, n) - 1


def stratum(encoding: int, n: int) -> int:
    return encoding * len(LENGTHS) + length_class(n)


def cell(token: str, encoding: int) -> int:
    """Stratum and bin in one number."""
    return stratum(encoding, len(token)) * BINS + min(BINS - 1, int(randomness(token, encoding) * BINS))


def _glue(words: list[str], encoding: str, size: int) -> str:
    """A token of about `size` characters as a program would write it from words, in an encoding's alphabet."""
    low = [w.lower() for w in words]
    if encoding == "lower":
        out = "".join(low)
    elif encoding == "base62":
        out = "".join(w.capitalize() + (str(len(w)) if i % 3 == 2 else "") for i, w in enumerate(low))
    elif encoding == "base64":
        out = "_".join(w.capitalize() if i % 2 else w for i, w in enumerate(low))
    else:
        out = "".join(w + (str(2 + len(w) % 6) if i % 2 else "") for i, w in enumerate(low))
        if encoding in ("hex", "HEX"):
            out = "".join(c for c in out if c in "0123456789abcdef")
        elif encoding == "upper":
            out = "".join(low)
        if encoding in ("HEX", "upper", "base32"):
            out = out.upper()
            if encoding == "base32":
                out = "".join(c for c in out if c in ENCODINGS[4][1])
    return out[:size]


def glued(text: str) -> Iterator[str]:
    """Tokens of a text's own words: one for each NULL_EVERY characters, over the whole text."""
    words = _WORD.findall(text)
    n = len(text) // NULL_EVERY
    if len(words) < 4 or not n:
        return
    turn = zlib.crc32(text[:200].encode("utf-8", "surrogatepass"))
    for i in range(n):
        k = (turn + i) % (len(ENCODINGS) * len(LENGTHS))
        low = LENGTHS[k % len(LENGTHS)]
        high = (*LENGTHS, LONGEST_GLUED)[k % len(LENGTHS) + 1]
        size = low + (turn // 7 + i * 5) % (high - low)
        name = ENCODINGS[k // len(LENGTHS)][0]
        at = i * len(words) // n
        yield _glue(words[at : at + size // (1 if name in ("hex", "HEX") else 3)], name, size)


def stated(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the stated patterns: leftmost, non-overlapping in each kind, failing matches dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, cell) of each candidate token outside the base spans, which come sorted."""
    out, starts, reach = [], [s for s, _, _ in base], []
    for _, _, e in base:
        reach.append(max(e, reach[-1]) if reach else e)
    for m in _TOKEN.finditer(text):
        start, end, token = m.start(), m.end(), m[0]
        before = bisect_right(starts, end - 1)  # base spans that begin before the token ends
        if (before and reach[before - 1] > start) or (encoding := encoding_of(token)) is None:
            continue
        out.append((start, end, cell(token, encoding)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base array<struct<start:int,kind:int,end:int>>, tokens array<struct<start:int,end:int,cell:int>>, written array<struct<cell:int,n:long>>"
_BASE_T = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_TOKEN_T = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cell", pa.int32())]))
_WRITTEN_T = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", _BASE_T), ("tokens", _TOKEN_T), ("written", _WRITTEN_T)])
    for b in batches:
        counts: list[list[int]] = [[], [], []]
        bases, tokens = [], []
        written: Counter[int] = Counter()
        for text in b.column("text").to_pylist():
            base = stated(text or "")
            for kind in range(3):
                counts[kind].append(sum(k == kind for _, k, _ in base))
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            tokens.append([{"start": s, "end": e, "cell": c} for s, e, c in candidates(text or "", base)])
            written.update(cell(t, kind) for t in glued(text or "") if len(t) >= MIN_TOKEN and (kind := encoding_of(t)) is not None)
        first = [{"cell": c, "n": n} for c, n in sorted(written.items())]  # of the whole batch, with its first row
        yield batch(schema, b.column("doc_id"), *counts, bases, tokens, ([first] + [None] * (len(bases) - 1))[: len(bases)])


def thresholds(found: dict[int, int], written: dict[int, int], rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """stratum -> the least bin that is a discovery: Benjamini-Hochberg over binned p-values, each bin at its largest p.

    found, written: how many candidates and how many glued tokens each cell has.
    """
    out = {}
    for s in {c // BINS for c in found}:
        mine = [found.get(s * BINS + k, 0) for k in range(BINS)]
        null = [written.get(s * BINS + k, 0) for k in range(BINS)]
        total, glued_, above, beyond = sum(mine), sum(null), 0, 0
        for k in reversed(range(BINS)):
            above += mine[k]
            beyond += null[k]
            if mine[k] and (1 + beyond) / (1 + glued_) <= rate * above / total:
                out[s] = k
    return out


def _counts(rows: DataFrame) -> dict[int, int]:
    """n of each cell; at most 32 strata of 200 bins."""
    return {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every document."""
    found = cut_map(only(docs, "doc_id", "text"), _find, _FOUND, "secrets")
    mine = _counts(found.select(F.explode("tokens").alias("t")).select("t.cell", F.lit(1).alias("n")))
    cuts = thresholds(mine, _counts(found.select(F.explode("written").alias("w")).select("w.*")), rate)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, spans, ns = [], [], []
            for base, tokens in zip(b.column("base").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                own = [(x["start"], x["kind"], x["end"]) for x in base]
                more = [(t["start"], 3, t["end"]) for t in tokens if t["cell"] % BINS >= cuts.get(t["cell"] // BINS, BINS)]
                digests.append(hashlib.sha256(joined(own).encode()).hexdigest())
                spans.append(joined(sorted(own + more)))
                ns.append(len(more))
            yield batch(schema, b.column("doc_id"), b.column("n_assign"), b.column("n_access"), b.column("n_hex"), digests, spans, ns)

    return arrow_map(found.select("doc_id", "n_assign", "n_access", "n_hex", "base", "tokens"), choose, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
