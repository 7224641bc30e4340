"""A parser of PDF text in plain Python: objects, object streams, the page tree, and the text operators of content streams.

It reads what common producers write: literal and hexadecimal strings, Flate streams, fonts with a ToUnicode map or a single-byte encoding. It has no OCR, no
decryption and no layout beyond lines: a move to another line is a line feed, a large step a space. What it cannot read is an error.
"""

from __future__ import annotations

import re
import zlib

# The bytes of a single-byte font that are not Latin-1, as cp1252 has them, and the escapes of a literal string.
ENCODING = "cp1252"
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

_TOKEN = re.compile(
    rb"\s+|%[^\r\n]*|(?P<dict><<|>>)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<open>\()|/(?P<name>[^\s()<>\[\]{}/%]*)|(?P<bracket>[\[\]{}])"
    rb"|(?P<ref>\d+\s+\d+\s+R(?![A-Za-z]))|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<word>[^\s()<>\[\]{}/%]+)"
)


class Unreadable(ValueError):
    """What the file is, this parser cannot read."""


class Name(str):
    pass


class Ref(int):
    pass


class Word(str):
    pass


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string that begins after its parenthesis, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            after = data[at + 1 : at + 2]
            if octal := re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4]):
                out.append(int(octal[0], 8) & 255)
                at += 1 + len(octal[0])
                continue
            if after not in (b"\n", b"\r"):
                out += ESCAPES.get(after, after)
            at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at + 1
        out += c
        at += 1
    raise Unreadable("a string does not end")


def values(data: bytes, at: int = 0, one: bool = False) -> tuple[list, int]:
    """The values of a piece of PDF from a place on, or one of them: numbers, names, strings as bytes, lists, dicts, references and words."""
    stack: list[list] = [[]]
    kinds: list[bytes] = []
    while at < len(data):
        m = _TOKEN.match(data, at)
        if not m:
            at += 1
            continue
        at = m.end()
        kind, value = m.lastgroup, None
        if kind is None:
            continue
        if kind == "open":
            value, at = _literal(data, at)
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", m["hex"])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "name":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), m["name"]).decode("latin-1"))
        elif kind == "ref":
            value = Ref(m["ref"].split()[0])
        elif kind == "number":
            value = float(m["number"]) if b"." in m["number"] else int(m["number"])
        elif kind == "word":
            value = Word(m["word"].decode("latin-1"))
        elif m[0] in (b"[", b"<<", b"{"):
            stack.append([])
            kinds.append(m[0])
            continue
        else:
            if not kinds:
                continue
            inner, begun = stack.pop(), kinds.pop()
            value = dict(zip(inner[::2], inner[1::2], strict=False)) if begun == b"<<" else inner
        stack[-1].append(value)
        if one and len(stack) == 1:
            break
    return stack[0], at


class Document:
    """The objects of a file, found by their headers, so that a damaged cross-reference table is no matter. Of an object's versions the last counts."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise Unreadable("no PDF header")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        self.encrypted = False
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            found, end = values(data, m.end(), one=True)
            number, own = int(m[1]), found[0] if found else None
            self.objects[number] = own
            if isinstance(own, dict) and (begin := re.compile(rb"\s*stream(\r\n|\n|\r)").match(data, end)):
                length = own.get("Length")
                stop = begin.end() + length if type(length) is int else -1
                if stop < 0 or not re.match(rb"\s*endstream", data[stop : stop + 20]):
                    stop = data.find(b"endstream", begin.end())
                self.streams[number] = data[begin.end() : stop]
        for m in re.finditer(rb"trailer\s*<<", data):
            self.encrypted |= any("Encrypt" in x for x in values(data, m.start() + 7, one=True)[0] if isinstance(x, dict))
        for number in [k for k, x in self.objects.items() if isinstance(x, dict) and x.get("Type") == "ObjStm"]:
            own, inner = self.objects[number], self.content(number)
            heads = values(inner[: int(self.of(own["First"]))])[0]
            for k, place in zip(heads[::2], heads[1::2], strict=False):
                if found := values(inner, int(self.of(own["First"])) + place, one=True)[0]:
                    self.objects.setdefault(k, found[0])
        self.encrypted |= any(isinstance(x, dict) and x.get("Type") == "XRef" and "Encrypt" in x for x in self.objects.values())
        if self.encrypted:
            raise Unreadable("the file is encrypted")

    def of(self, value):
        """What a reference names."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value))
        return None

    def content(self, number: int) -> bytes:
        filters = self.of(self.objects[number].get("Filter", []))
        data = self.streams.get(number, b"")
        for name in [self.of(x) for x in (filters if isinstance(filters, list) else [filters])]:
            if name not in ("FlateDecode", "Fl"):
                raise Unreadable(f"streams with the filter {name} are not read")
            data = zlib.decompressobj().decompress(data)
        return data

    def pages(self) -> list[dict]:
        """Pages in order, with what they inherit; in the order of the file where there is no tree."""
        roots = [x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"]
        found: list[dict] = []

        def walk(node, inherited: dict, seen: frozenset) -> None:
            own = self.of(node)
            if not isinstance(own, dict) or id(own) in seen:
                return
            own = {**inherited, **own}
            if "Kids" in own:
                for kid in self.of(own["Kids"]) or []:
                    walk(kid, {k: own[k] for k in ("Resources",) if k in own}, seen | {id(self.of(node))})
            else:
                found.append(own)

        for root in roots[-1:]:
            walk(root.get("Pages"), {}, frozenset())
        return found or [x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Page"]

    def font(self, font) -> Font:
        own = self.of(font) or {}
        to = own.get("ToUnicode")
        return Font(self.content(int(to)) if isinstance(to, Ref) and int(to) in self.streams else None, own.get("Subtype") == "Type0")

    def page_text(self, page: dict) -> str:
        contents = page.get("Contents")
        listed = self.of(contents) if not isinstance(contents, Ref) or int(contents) not in self.streams else [contents]
        data = b"\n".join(self.content(int(x)) for x in listed or [] if isinstance(x, Ref) and int(x) in self.streams)
        fonts = self.of((self.of(page.get("Resources")) or {}).get("Font")) or {}
        return shown(data, {name: self.font(x) for name, x in fonts.items()})


class Font:
    """How a font's codes are characters."""

    def __init__(self, to_unicode: bytes | None, wide: bool):
        self.codes: dict[bytes, str] = {}
        text = lambda x: x.decode("utf-16-be", errors="replace")
        if to_unicode:
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", to_unicode, re.S):
                pairs = [x for x in values(block)[0] if isinstance(x, bytes)]
                self.codes |= {a: text(b) for a, b in zip(pairs[::2], pairs[1::2], strict=False)}
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", to_unicode, re.S):
                rows = values(block)[0]
                for low, high, first in zip(rows[::3], rows[1::3], rows[2::3], strict=False):
                    for k in range(min(int.from_bytes(high) - int.from_bytes(low), 65535) + 1):
                        code = (int.from_bytes(low) + k).to_bytes(len(low))
                        if isinstance(first, list):
                            if k < len(first):
                                self.codes[code] = text(first[k])
                        else:
                            self.codes[code] = text(first[:-2] + ((int.from_bytes(first[-2:]) + k) & 0xFFFF).to_bytes(2))
        self.width = max(map(len, self.codes), default=2 if wide else 1)

    def text(self, data: bytes) -> str:
        if not self.codes:
            return data.decode("utf-16-be" if self.width == 2 else ENCODING, errors="replace")
        parts = [data[k : k + self.width] for k in range(0, len(data), self.width)]
        return "".join(self.codes.get(x, x.decode(ENCODING, errors="replace") if self.width == 1 else "�") for x in parts)


def shown(content: bytes, fonts: dict[str, Font]) -> str:
    """The text that a content stream shows."""
    out: list[str] = []
    font, stack, line = Font(None, False), [], 0.0
    content = re.sub(rb"\bBI\b.*?\bID\b.*?\bEI\b", b" ", content, flags=re.S)  # images that stand in the stream

    def feed() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for value in values(content)[0]:
        if not isinstance(value, Word):
            stack.append(value)
            continue
        if value == "Tf" and len(stack) >= 2:
            font = fonts.get(stack[-2], Font(None, False))
        elif value == "Tj" and stack and isinstance(stack[-1], bytes):
            out.append(font.text(stack[-1]))
        elif value in ("'", '"') and stack and isinstance(stack[-1], bytes):
            feed()
            out.append(font.text(stack[-1]))
        elif value == "TJ" and stack and isinstance(stack[-1], list):
            for x in stack[-1]:
                if isinstance(x, bytes):
                    out.append(font.text(x))
                elif isinstance(x, (int, float)) and x < -180:
                    out.append(" ")
        elif value in ("Td", "TD") and len(stack) >= 2:
            if stack[-1]:
                feed()
                if abs(stack[-1]) > 20 and out:  # further than a line: a paragraph
                    out.append("\n")
            elif stack[-2]:
                out.append(" ")
        elif value == "Tm" and len(stack) >= 6:
            if stack[-1] != line:
                feed()
            line = stack[-1]
        elif value in ("T*", "ET"):
            feed()
        stack = []
    return "".join(out)


class PdfText:
    """The parser as a provider: bytes to text, a form feed between pages."""

    def parse(self, content: bytes) -> str:
        document = Document(content)
        pages = document.pages()
        if not pages:
            raise Unreadable("no pages")
        return "\f".join(document.page_text(x).strip("\n") for x in pages)
