"""Text layers of PDF files: a small reader of objects, streams and text operators, without any rendering.

Pages without a text layer give an empty text; what to do with them is the choice of operators.quality.
"""

from __future__ import annotations

import re
import zlib

STREAM_BYTES, MOST_PAGES = 64 << 20, 5000


class Locked(ValueError):
    """The file needs a password."""


_OBJ = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)(?:endobj|(?=\s\d+\s+\d+\s+obj\b)|\Z)", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?[\d.]+|[A-Za-z'\"*]+")
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")


def _stream(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    data = m[1]
    if b"FlateDecode" in body[: m.start()] or b"/Fl " in body[: m.start()]:
        d = zlib.decompressobj()
        try:
            data = d.decompress(data, STREAM_BYTES)
        except zlib.error:
            return b""
    return data


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(n): body for n, body in _OBJ.findall(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            first, raw = re.search(rb"/First\s+(\d+)", body), _stream(body)
            if first:
                at = int(first[1])
                head = [int(x) for x in raw[:at].split() if x.isdigit()]
                starts = list(zip(head[::2], head[1::2]))
                for (n, a), b in zip(starts, [s for _, s in starts[1:]] + [len(raw) - at]):
                    found.setdefault(n, raw[at + a : at + b])
    return found


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _unicode_map(cmap: bytes) -> dict[int, str]:
    """Code -> text of a font's map: single characters and ranges."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for i in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                out[int(a, 16) + i] = text(c)[:-1] + chr(ord(text(c)[-1]) + i)
    return out


def _shown(token: bytes, font: dict[int, str] | None) -> str:
    if token.startswith(b"<"):
        h = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    else:
        names = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        raw = _ESCAPE.sub(lambda m: names.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else m[1]), token[1:-1])
    if font:
        wide = max(font) > 255
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)] if wide else list(raw)
        return "".join(font.get(c, "") for c in codes)
    return raw.decode("utf-16", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def _page_text(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    lines, line, font, stack = [], [], None, []
    last_y = None
    for m in _TOKEN.finditer(content):
        t = m.group()
        if t[:1] in b"(<[]/" or t[:1] in b"+-.0123456789":
            stack.append(t)
            continue
        if t == b"Tf" and len(stack) > 1:
            font = fonts.get(stack[-2][1:])
        elif t in (b"Tj", b"'", b'"', b"TJ"):
            if t in (b"'", b'"') and line:
                lines.append("".join(line))
                line = []
            for x in stack:
                if x[:1] in b"(<":
                    line.append(_shown(x, font))
                elif t == b"TJ" and x[:1] == b"-" and x[1:].replace(b".", b"").isdigit() and float(x) < -180:
                    line.append(" ")
        elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            numbers = [float(x) for x in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", x)]
            y = numbers[-1] if t == b"Tm" and numbers else None
            moved = t in (b"T*", b"ET") or (t in (b"Td", b"TD") and bool(numbers) and numbers[-1] != 0) or (t == b"Tm" and y != last_y)
            last_y = y if t == b"Tm" else last_y
            if line and moved:
                lines.append("".join(line))
                line = []
            elif line and not line[-1].endswith(" "):
                line.append(" ")
        stack = []
    if line:
        lines.append("".join(line))
    return "\n".join(x.rstrip() for x in lines if x.strip())


def pdf_pages(data: bytes) -> list[str]:
    """The text layer of each page; Locked for a file with a password, ValueError for what is no readable PDF."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("no PDF")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise Locked("password needed")
    objects = _objects(data)
    found = {n: body for n, body in objects.items() if re.search(rb"/Type\s*/Page(?![a-zA-Z])", body)}
    kids = [k for body in objects.values() if re.search(rb"/Type\s*/Pages", body) for k in _refs(body, b"Kids")]
    order = [n for n in kids if n in found] or sorted(found)
    if not order:
        raise ValueError("no pages")
    pages = []
    for n in order[:MOST_PAGES]:
        body = found[n]
        resources = body + b"".join(objects.get(r, b"") for r in _refs(body, b"Resources"))
        fonts = {}
        for name, ref in re.findall(rb"/([A-Za-z0-9_+.-]+)\s+(\d+)\s+\d+\s+R", resources):
            font = objects.get(int(ref), b"")
            for cmap in _refs(font, b"ToUnicode"):
                fonts[name] = _unicode_map(_stream(objects.get(cmap, b"")))
        pages.append(_page_text(b"\n".join(_stream(objects.get(r, b"")) for r in _refs(body, b"Contents")), fonts))
    return pages
