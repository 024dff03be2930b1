"""Text of PDF files by the standard library alone: page tree, Flate streams, object streams, ToUnicode maps.

It reads what digital documents hold: text operators of page contents, in their order. Encrypted files, other filters
and scanned pages give no text; `textloom.sources.readers` then asks an OCR function, where one is given.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_REF = rb"(\d+)\s+\d+\s+R"
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
GAP = -200  # a shift in a text array, in thousandths of the font's size, that stands for a blank


class Pdf:
    def __init__(self, data: bytes):
        if not data.lstrip().startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        if b"/Encrypt" in data[-4096:]:
            raise ValueError("the PDF file is encrypted")
        self.objects = {int(n): body for n, body in _OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        data, n, first = self.stream(body), int(re.search(rb"/N\s+(\d+)", body)[1]), int(re.search(rb"/First\s+(\d+)", body)[1])
        head = list(map(int, data[:first].split()))[: 2 * n]
        edges = [first + at for at in head[1::2]] + [len(data)]
        for k, number in enumerate(head[::2]):
            self.objects.setdefault(number, data[edges[k] : edges[k + 1]])

    def stream(self, body: bytes) -> bytes:
        """The decoded stream of an object; empty for filters that are not known here."""
        begin = re.search(rb"stream\r?\n", body)
        if not begin:
            return b""
        raw, head = body[begin.end() : body.rindex(b"endstream")], body[: begin.start()]
        if b"FlateDecode" in head:
            return zlib.decompressobj().decompress(raw)
        return b"" if b"/Filter" in head else raw

    def _refs(self, body: bytes, name: bytes) -> list[int]:
        found = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|" + _REF + rb")", body)
        return [int(n) for n in re.findall(_REF, found[1])] if found else []

    def _dict(self, body: bytes, name: bytes) -> bytes:
        """A dictionary under a name, given there or by reference."""
        if refs := self._refs(body, name):
            return self.objects.get(refs[0], b"")
        at = re.search(rb"/" + name + rb"\s*<<", body)
        if not at:
            return b""
        depth, i = 1, at.end()
        while depth and i < len(body):
            step = body[i : i + 2]
            depth += (step == b"<<") - (step == b">>")
            i += 2 if step in (b"<<", b">>") else 1
        return body[at.end() : i - 2]

    def page_objects(self) -> list[tuple[bytes, bytes]]:
        """(page, resources) in reading order; resources come from the nearest node that has them."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out: list[tuple[bytes, bytes]] = []
        seen: set[int] = set()

        def visit(number: int, resources: bytes) -> None:
            body = self.objects.get(number, b"")
            if number in seen:
                return
            seen.add(number)
            own = self._dict(body, b"Resources") or resources
            if re.search(rb"/Type\s*/Page\b", body):
                out.append((body, own))
            for kid in self._refs(body, b"Kids"):
                visit(kid, own)

        for number in self._refs(root, b"Pages"):
            visit(number, b"")
        return out or [(b, self._dict(b, b"Resources")) for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]

    def maps(self, resources: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """Of each font with a ToUnicode map: bytes of a code, and texts of codes."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+" + _REF, self._dict(resources, b"Font")):
            for ref in self._refs(self.objects.get(int(number), b""), b"ToUnicode"):
                out[name] = _character_map(self.stream(self.objects.get(ref, b"")))
        return out

    def pages(self) -> list[str]:
        out = []
        for body, resources in self.page_objects():
            contents = b"\n".join(self.stream(self.objects.get(n, b"")) for n in self._refs(body, b"Contents"))
            out.append(_text(contents, self.maps(resources)))
        return out


def _character_map(data: bytes) -> tuple[int, dict[int, str]]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    found: dict[int, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.DOTALL):
        found |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.DOTALL):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            found |= {code: chr(ord(text(c)[-1]) + code - int(a, 16)) for code in range(int(a, 16), int(b, 16) + 1)}
    width = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", data)
    return (len(width[1]) // 2 if width else 1), found


def _bytes_of(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain = lambda m: _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.DOTALL)


def _text(contents: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    out: list[str] = []
    held: list[bytes] = []
    font: tuple[int, dict[int, str]] | None = None

    def say(token: bytes) -> str:
        raw = _bytes_of(token)
        if font is None:
            return raw.decode("cp1252", "replace")
        width, known = font
        return "".join(known.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))

    def number(k: int) -> float:
        return float(held[k]) if len(held) >= -k and re.fullmatch(rb"[-+]?\d*\.?\d+", held[k]) else 0.0

    for token in _TOKEN.findall(contents):
        if token[:1] in b"(<[]/" or token[:1] in b"0123456789+-.":
            held.append(token)
            continue
        if token == b"Tf" and len(held) > 1:
            font = fonts.get(held[-2][1:])
        elif token in (b"T*", b"Tm", b"ET", b"'", b'"') or (token in (b"Td", b"TD") and number(-1)):
            out.append("\n")
        elif token in (b"Td", b"TD"):
            out.append(" ")
        if token in (b"Tj", b"'", b'"') and held:
            out.append(say(held[-1]))
        elif token == b"TJ":
            for part in held:
                out.append(say(part) if part[:1] in b"(<" else " " if part[:1] in b"-0123456789." and float(part) < GAP else "")
        held.clear()
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def pages(data: bytes) -> list[str]:
    """The text of each page."""
    return Pdf(data).pages()
