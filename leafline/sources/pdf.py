"""Embedded text of PDF files by the standard library: objects, deflated streams and object streams, page order, and text operators with ToUnicode maps.

A file that is encrypted or has no text on any page gives pages without lines; its scanned pages are the recogniser's work.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?s)(\d+)\s+\d+\s+obj\b(.*?)\bendobj")
_STREAM = re.compile(rb"(?s)stream\r?\n(.*?)\r?\n?endstream")
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"(?s)\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.\d]+|[A-Za-z'\"*]+")
_ESCAPE = re.compile(rb"(?s)\\([0-7]{1,3}|\r\n|.)")
_SIGNS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def _objects(raw: bytes) -> dict[int, bytes]:
    found = {int(n): body for n, body in _OBJECT.findall(raw)}
    for body in list(found.values()):
        if b"/ObjStm" in body and (data := _data(body)) is not None and (first := re.search(rb"/First\s+(\d+)", body)):
            start = int(first[1])
            head = [int(x) for x in data[:start].split()]
            places = list(zip(head[::2], head[1::2]))
            for k, (n, at) in enumerate(places):
                found[n] = data[start + at : start + places[k + 1][1] if k + 1 < len(places) else None]
    return found


def _data(body: bytes) -> bytes | None:
    m = _STREAM.search(body)
    if m is None:
        return None
    if b"/FlateDecode" not in body[: m.start()]:
        return m[1]
    try:
        return zlib.decompressobj().decompress(m[1])
    except zlib.error:
        return None


def _referred(body: bytes, key: bytes) -> list[int]:
    """Numbers of the objects under a key: one reference or an array of them."""
    m = re.search(rb"(?s)" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(n) for n in _REFERENCE.findall(m[1])] if m else []


def _ordered(objects: dict[int, bytes]) -> list[int]:
    """Pages in the order of the tree, else in the file's."""
    out: list[int] = []
    seen: set[int] = set()
    stack = [k for n, b in objects.items() if b"/Catalog" in b for k in _referred(b, rb"/Pages")]
    while stack:
        n = stack.pop()
        body = objects.get(n, b"")
        if n in seen:
            continue
        seen.add(n)
        if re.search(rb"/Type\s*/Pages\b", body):
            stack += reversed(_referred(body, rb"/Kids"))
        elif re.search(rb"/Type\s*/Page\b", body):
            out.append(n)
    return out or [n for n, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]


def _unicode_map(data: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and the text of each code."""

    def sign(h: bytes) -> str:
        return bytes.fromhex(h.decode()).decode("utf-16-be", "replace")

    out: dict[int, str] = {}
    wide = re.search(rb"beginbf(?:char|range)\s*<([0-9A-Fa-f]+)>", data)
    for part in re.findall(rb"(?s)beginbfchar(.*?)endbfchar", data):
        out |= {int(a, 16): sign(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"(?s)beginbfrange(.*?)endbfrange", data):
        for a, b, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", part):
            if one:
                first = sign(one)
                out |= {c: first[:-1] + chr(ord(first[-1]) + c - int(a, 16)) for c in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1)}
            else:
                out |= {int(a, 16) + k: sign(h) for k, h in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", many))}
    return (len(wide[1]) + 1) // 2 if wide else 1, out


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return _ESCAPE.sub(lambda m: _SIGNS.get(m[1], bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][0] < 56 else m[1]), token[1:-1])


Font = tuple[int, dict[int, str]]


def _shown(raw: bytes, font: Font) -> str:
    wide, signs = font
    if not signs:
        return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    return "".join(signs.get(int.from_bytes(raw[i : i + wide], "big"), chr(raw[i]) if wide == 1 else "") for i in range(0, len(raw), wide))


def _page_text(data: bytes, fonts: dict[bytes, Font]) -> str:
    """What the text operators of a page show, a line break where the position moves to another line."""
    out: list[str] = []
    held: list[bytes] = []
    font: Font = (1, {})
    level = None
    for token in _TOKEN.findall(data):
        if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+.\d]+", token):
            held.append(token)
            continue
        if token == b"Tf" and len(held) > 1:
            font = fonts.get(held[-2], (1, {}))
        elif token in (b"Td", b"TD") and len(held) > 1:
            out.append("\n" if float(held[-1] or 0) else " ")
        elif token == b"Tm" and len(held) > 5:
            out.append(" " if held[-1] == level else "\n")
            level = held[-1]
        elif token in (b"T*", b"'", b'"', b"ET"):
            out.append("\n")
        if token in (b"Tj", b"TJ", b"'", b'"'):
            for part in held[held.index(b"[") :] if token == b"TJ" and b"[" in held else held[-1:]:
                if part[:1] in b"(<":
                    out.append(_shown(_string(part), font))
                elif token == b"TJ" and part[:1] == b"-" and float(part) < -200:
                    out.append(" ")  # a wide gap is a space
        held.clear()
    return "".join(out)


def pdf_pages(raw: bytes) -> list[str]:
    """The text of each page."""
    if not raw.lstrip()[:5] == b"%PDF-":
        raise ValueError("no PDF file")
    objects = _objects(raw)
    maps: dict[int, Font] = {}

    def fonts_of(body: bytes) -> dict[bytes, Font]:
        resources = b" ".join([body, *(objects.get(n, b"") for n in _referred(body, rb"/Resources"))])
        m = re.search(rb"(?s)/Font\s*(?:<<(.*?)>>|(\d+)\s+\d+\s+R)", resources)
        named = (m[1] if m[1] is not None else objects.get(int(m[2]), b"")) if m else b""
        out = {}
        for name, n in re.findall(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", named):
            for to in _referred(objects.get(int(n), b""), rb"/ToUnicode"):
                if to not in maps:
                    maps[to] = _unicode_map(_data(objects.get(to, b"")) or b"")
                out[name] = maps[to]
        return out

    pages = []
    for n in _ordered(objects):
        body, above = objects[n], objects[n]
        while b"/Resources" not in body and (up := _referred(above, rb"/Parent")) and up[0] in objects and objects[up[0]] is not above:
            above = objects[up[0]]
            body += above if b"/Resources" in above else b""
        data = b"\n".join(d for c in _referred(objects[n], rb"/Contents") if (d := _data(objects.get(c, b""))) is not None)
        pages.append(_page_text(data, fonts_of(body)))
    return pages
