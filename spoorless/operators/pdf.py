"""PDF files: reading their objects, counting and dropping metadata, writing them anew.

A small reader for ordinary files: it takes objects where they stand, the last one of a number
counting, opens object streams, and follows the newest trailer. Encrypted files are refused.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from ..schemas import Refused
from .containers import findings

# Keys of document information, dropped wherever they stand.
KEYS = ("Author", "Creator", "Producer", "Title", "Subject", "Keywords", "CreationDate", "ModDate", "PieceInfo", "LastModified")

_SPACE, _ENDS = b" \t\r\n\f\0", b" \t\r\n\f\0()<>[]{}/%"
_OBJECT = re.compile(rb"(?<![0-9])(\d+)[ \t\r\n\f\0]+(\d+)[ \t\r\n\f\0]+obj\b")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REFERENCE = re.compile(rb"(\d+)[ \t\r\n\f\0]+(\d+)[ \t\r\n\f\0]+R(?![A-Za-z0-9])")


class Name(str):
    """A name, without its slash; escapes stay as written."""


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Raw:
    """A number, string or keyword as it was written."""

    text: bytes


@dataclass
class Stream:
    dictionary: dict
    data: bytes


@dataclass
class Document:
    objects: dict[int, object] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)


def _fail(what: str) -> Refused:
    return Refused("Pdf", what)


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        while self.at < len(self.data):
            if self.data[self.at] in _SPACE:
                self.at += 1
            elif self.data[self.at] == 0x25:
                while self.at < len(self.data) and self.data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self, depth: int = 0) -> object:
        self.skip()
        data, at = self.data, self.at
        if depth > 200 or at >= len(data):
            raise _fail("object cut off or nested too deep")
        if data.startswith(b"<<", at):
            self.at, out = at + 2, {}
            while True:
                self.skip()
                if data.startswith(b">>", self.at):
                    self.at += 2
                    return out
                key = self.value(depth + 1)
                if not isinstance(key, Name):
                    raise _fail("dictionary key is no name")
                out[key] = self.value(depth + 1)
        c = data[at : at + 1]
        if c == b"[":
            self.at, items = at + 1, []
            while True:
                self.skip()
                if data.startswith(b"]", self.at):
                    self.at += 1
                    return items
                items.append(self.value(depth + 1))
        if c == b"/":
            self.at = at + 1
            while self.at < len(data) and data[self.at] not in _ENDS:
                self.at += 1
            return Name(data[at + 1 : self.at].decode("latin-1"))
        if c == b"(":
            level = 0
            while self.at < len(data):
                b = data[self.at]
                self.at += 2 if b == 0x5C else 1
                level += (b == 0x28) - (b == 0x29)
                if not level:
                    return Raw(data[at : self.at])
            raise _fail("string without an end")
        if c == b"<":
            if (stop := data.find(b">", at)) < 0:
                raise _fail("string without an end")
            self.at = stop + 1
            return Raw(data[at : self.at])
        if m := _REFERENCE.match(data, at):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        if m := _NUMBER.match(data, at):
            self.at = m.end()
            return Raw(m[0])
        while self.at < len(data) and data[self.at] not in _ENDS:
            self.at += 1
        if self.at == at:
            raise _fail("object of no kind")
        return Raw(data[at : self.at])


def _number(value: object, document: Document) -> int | None:
    value = document.objects.get(value.number) if isinstance(value, Ref) else value
    return int(value.text) if isinstance(value, Raw) and value.text.isdigit() else None


def _inflate(stream: Stream, document: Document) -> bytes:
    """The bytes of a plain or deflated stream, with the predictors that tables of objects use."""
    kind = stream.dictionary.get("Filter")
    kind = kind[0] if isinstance(kind, list) and len(kind) == 1 else kind
    if kind is None:
        return stream.data
    if kind != "FlateDecode":
        raise _fail("object stream of another filter")
    try:
        data = zlib.decompressobj().decompress(stream.data)
    except zlib.error as error:
        raise _fail(str(error)) from None
    settings = stream.dictionary.get("DecodeParms")
    settings = settings[0] if isinstance(settings, list) and settings else settings
    if isinstance(settings, dict) and (_number(settings.get("Predictor"), document) or 1) >= 10:
        width = _number(settings.get("Columns"), document) or 1
        rows, before = [], bytes(width)
        for i in range(0, len(data) - width, width + 1):
            row = bytearray(data[i + 1 : i + 1 + width])
            if data[i] == 2:
                row = bytearray((a + b) & 255 for a, b in zip(row, before, strict=True))
            elif data[i] == 1:
                for k in range(1, width):
                    row[k] = (row[k] + row[k - 1]) & 255
            elif data[i]:
                raise _fail("predictor of another kind")
            rows.append(bytes(row))
            before = bytes(row)
        data = b"".join(rows)
    return data


def load(data: bytes) -> Document:
    document, places = Document(), {}
    at, tables = 0, []
    while m := _OBJECT.search(data, at):
        reader = Reader(data, m.end())
        try:
            value = reader.value()
        except Refused:
            at = m.end()
            continue
        at = reader.at
        reader.skip()
        if isinstance(value, dict) and data.startswith(b"stream", reader.at):
            begin = reader.at + 6
            begin += 2 if data[begin : begin + 2] == b"\r\n" else 1
            size = _number(value.get("Length"), document)
            if size is None or not re.match(rb"\s*endstream", data[begin + size : begin + size + 20]):
                stop = data.find(b"endstream", begin)
                if stop < 0:
                    raise _fail("stream without an end")
                size = len(data[begin:stop].removesuffix(b"\n").removesuffix(b"\r"))
            value, at = Stream(value, data[begin : begin + size]), begin + size
            if value.dictionary.get("Type") == "XRef":
                tables.append((m.start(), value.dictionary))
        document.objects[int(m[1])], places[int(m[1])] = value, m.start()
    if not document.objects:
        raise _fail("no objects")
    for number, holder in list(document.objects.items()):
        if isinstance(holder, Stream) and holder.dictionary.get("Type") == "ObjStm":
            body, first, n = _inflate(holder, document), _number(holder.dictionary.get("First"), document) or 0, _number(holder.dictionary.get("N"), document) or 0
            head = [int(x) for x in body[:first].split()[: 2 * n]]
            for k in range(0, len(head) - 1, 2):
                if places.get(head[k], -1) < places[number]:  # a later plain object replaces a packed one
                    document.objects[head[k]] = Reader(body, first + head[k + 1]).value()
                    places[head[k]] = places[number]
    newest = [int(x) for x in re.findall(rb"startxref\s+(\d+)", data)[-1:]]
    plain = [(m.start(), m.end()) for m in re.finditer(rb"\btrailer\b", data)]
    after = [end for begin, end in plain if newest and begin >= newest[0] and data[newest[0] : newest[0] + 4] == b"xref"]
    direct = [d for begin, d in tables if newest and abs(begin - newest[0]) < 2]
    if after:
        document.trailer = Reader(data, after[0]).value()
    elif direct:
        document.trailer = direct[0]
    elif plain:
        document.trailer = Reader(data, plain[-1][1]).value()
    elif tables:
        document.trailer = tables[-1][1]
    if not isinstance(document.trailer, dict) or "Root" not in document.trailer:
        raise _fail("no trailer with a root")
    if "Encrypt" in document.trailer:
        raise _fail("encrypted")
    return document


def _is_metadata(value: object) -> bool:
    return isinstance(value, Stream) and value.dictionary.get("Type") == "Metadata"


def inspect(data: bytes) -> list[dict]:
    document = load(data)
    info = document.trailer.get("Info")
    count = (info is not None) + (len(info) if isinstance(info, dict) else 0)
    count += sum(_is_metadata(v) or (isinstance(v, dict) and "Metadata" in v) for v in document.objects.values())
    return findings({"pdf": count})


def _write(value: object, numbers: dict[int, int]) -> bytes:
    if isinstance(value, dict):
        return b"<<" + b"".join(b"/" + k.encode("latin-1") + b" " + _write(v, numbers) for k, v in value.items()) + b">>"
    if isinstance(value, list):
        return b"[" + b" ".join(_write(v, numbers) for v in value) + b"]"
    if isinstance(value, Name):
        return b"/" + value.encode("latin-1")
    if isinstance(value, Ref):
        return f"{numbers[value.number]} 0 R".encode() if value.number in numbers else b"null"
    return value.text


def _references(value: object) -> list[int]:
    if isinstance(value, Ref):
        return [value.number]
    inner = value.dictionary if isinstance(value, Stream) else value
    parts = inner.values() if isinstance(inner, dict) else inner if isinstance(inner, list) else ()
    return [n for part in parts for n in _references(part)]


def clean(data: bytes) -> tuple[bytes, list[dict]]:
    """What the root reaches, without metadata, numbered anew, in one part: earlier versions are gone."""
    removed, document = inspect(data), load(data)
    for number, value in list(document.objects.items()):
        dictionary = value.dictionary if isinstance(value, Stream) else value
        if _is_metadata(value) or (isinstance(value, Stream) and dictionary.get("Type") in ("XRef", "ObjStm")):
            del document.objects[number]
        elif isinstance(dictionary, dict):
            for key in ("Metadata", *KEYS):
                dictionary.pop(key, None)
    trailer = {k: v for k, v in document.trailer.items() if k in ("Root", "ID")}
    numbers: dict[int, int] = {}
    todo = _references(trailer)
    while todo:
        number = todo.pop()
        if number in document.objects and number not in numbers:
            numbers[number] = len(numbers) + 1
            todo += _references(document.objects[number])
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for number, new in numbers.items():
        places.append(len(out))
        value, tail = document.objects[number], b""
        if isinstance(value, Stream):
            body, dictionary = value.data, dict(value.dictionary)
            if "Filter" not in dictionary and len(packed := zlib.compress(body, 9)) + 19 < len(body):
                body, dictionary[Name("Filter")] = packed, Name("FlateDecode")
            dictionary[Name("Length")] = Raw(str(len(body)).encode())
            value, tail = dictionary, b"\nstream\n" + body + b"\nendstream"
        out += f"{new} 0 obj\n".encode() + _write(value, numbers) + tail + b"\nendobj\n"
    table = len(out)
    out += f"xref\n0 {len(places) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    trailer[Name("Size")] = Raw(str(len(places) + 1).encode())
    out += b"trailer\n" + _write(trailer, numbers) + f"\nstartxref\n{table}\n%%EOF\n".encode()
    return bytes(out), removed
