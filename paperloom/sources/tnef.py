"""Containers that mail programs of one family attach: attribute streams with properties, and their compressed rich text.

Damaged streams never raise: what could be read is returned, with notes of what could not.
"""

from __future__ import annotations

import struct
import zlib

SIGNATURE = 0x223E9F78
# Fixed values of the format: attributes, properties, sizes of property types.
SUBJECT, BODY, PROPS, TITLE, DATA, RENDERING, ATTACHMENT, CODEPAGE = 0x8004, 0x800C, 0x9003, 0x8010, 0x800F, 0x9002, 0x9005, 0x9007
P_SUBJECT, P_BODY, P_HTML, P_RTF, P_DATA, P_NAME, P_LONG_NAME, P_MIME, P_METHOD, P_CONTENT_ID = 0x0037, 0x1000, 0x1013, 0x1009, 0x3701, 0x3704, 0x3707, 0x370E, 0x3705, 0x3712
SIZES = {0x02: 4, 0x03: 4, 0x04: 4, 0x05: 8, 0x06: 8, 0x07: 8, 0x0A: 4, 0x0B: 4, 0x14: 8, 0x40: 8, 0x48: 16}
VARIABLE = (0x0D, 0x1E, 0x1F, 0x102)
# Fixed value of the format: what the dictionary of compressed rich text holds at first.
DICTIONARY = b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArialTimes New RomanCourier{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"
RTF_BYTES, MOST_ATTACHMENTS, MOST_PROPS = 4 << 20, 200, 10_000


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int = 4) -> int:
        return int.from_bytes(self.take(n), "little")

    def padded(self, n: int) -> bytes:
        got = self.take(n)
        self.at = min(len(self.data), self.at + -n % 4)
        return got


def properties(data: bytes) -> tuple[dict[int, bytes], bool]:
    """First value of each property by its number, raw, and whether all could be read; text is UTF-16 as in type 0x1F."""
    r, out = _Reader(data), {}
    try:
        for _ in range(min(r.number(), MOST_PROPS)):
            kind, number = r.number(2), r.number(2)
            if number >= 0x8000:
                r.take(16)
                if r.number():
                    r.padded(r.number())
                else:
                    r.take(4)
            several, kind = kind & 0x1000, kind & 0xFFF
            if kind in SIZES:
                values = [r.take(SIZES[kind]) for _ in range(r.number() if several else 1)]
            elif kind in VARIABLE:
                values = [r.padded(r.number()) for _ in range(r.number())]
            else:
                return out, False
            if values:
                value = values[0]
                if kind == 0x1E:
                    value = value.rstrip(b"\0").decode("cp1252", "replace").encode("utf-16-le")
                out.setdefault(number, value)
    except EOFError:
        return out, False
    return out, True


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-16-le", "replace").rstrip("\0")


def parse(data: bytes) -> dict:
    """subject, body, html, rtf, attachments (name, mime, content_id, data, embedded) and notes of a container."""
    out: dict = {"subject": None, "body": None, "html": None, "rtf": None, "attachments": [], "notes": []}
    r, codepage = _Reader(data), "cp1252"
    try:
        if r.number() != SIGNATURE:
            out["notes"].append("no container")
            return out
        r.take(2)
        while r.at < len(data):
            level, number = r.take(1)[0], r.number() & 0xFFFF
            value = r.take(r.number())
            if sum(value) & 0xFFFF != r.number(2):
                out["notes"].append(f"checksum of attribute {number:#x}")
            if level == 1:
                if number == CODEPAGE and len(value) >= 4:
                    codepage = f"cp{struct.unpack('<I', value[:4])[0]}"
                elif number in (SUBJECT, BODY):
                    out["subject" if number == SUBJECT else "body"] = _plain(value, codepage)
                elif number == PROPS:
                    props, whole = properties(value)
                    if not whole:
                        out["notes"].append("properties cut short")
                    _take_message(out, props)
            elif number == RENDERING:
                if len(out["attachments"]) == MOST_ATTACHMENTS:
                    out["notes"].append("attachments beyond the budget")
                    break
                out["attachments"].append({"name": None, "mime": None, "content_id": None, "data": b"", "embedded": False})
            elif out["attachments"]:
                _take_attachment(out["attachments"][-1], number, value, codepage)
    except EOFError:
        out["notes"].append("cut short")
    return out


def _plain(value: bytes, codepage: str) -> str:
    try:
        return value.rstrip(b"\0").decode(codepage)
    except (LookupError, UnicodeDecodeError):
        return value.rstrip(b"\0").decode("cp1252", "replace")


def _take_message(out: dict, props: dict[int, bytes]) -> None:
    out["subject"] = _text(props.get(P_SUBJECT)) or out["subject"]
    out["body"] = _text(props.get(P_BODY)) or out["body"]
    if P_HTML in props:
        out["html"] = props[P_HTML].decode("utf-8", "replace")
    if P_RTF in props:
        rtf, note = decompress_rtf(props[P_RTF])
        out["rtf"] = rtf.decode("cp1252", "replace")
        if note:
            out["notes"].append(note)


def _take_attachment(row: dict, number: int, value: bytes, codepage: str) -> None:
    if number == TITLE and row["name"] is None:
        row["name"] = _plain(value, codepage)
    elif number == DATA:
        row["data"] = value
    elif number == ATTACHMENT:
        props, _ = properties(value)
        row["name"] = _text(props.get(P_LONG_NAME)) or _text(props.get(P_NAME)) or row["name"]
        row["mime"], row["content_id"] = _text(props.get(P_MIME)), _text(props.get(P_CONTENT_ID))
        row["embedded"] = props.get(P_METHOD, b"\0")[0] == 5
        if P_DATA in props:
            # An object begins with the number of its interface.
            row["data"] = props[P_DATA][16:] if row["embedded"] else props[P_DATA]


def decompress_rtf(data: bytes) -> tuple[bytes, str | None]:
    """Rich text from its compressed or its wrapped form, RTF_BYTES at most, and a note if it is damaged."""
    if len(data) < 16:
        return b"", "rich text cut short"
    size, raw, magic, crc = struct.unpack("<IIII", data[:16])
    body = data[16 : size + 4]
    if magic == 0x414C454D:
        return body[:raw], None
    if magic != 0x75465A4C:
        return b"", "rich text of unknown form"
    note = None if zlib.crc32(body, 0xFFFFFFFF) ^ 0xFFFFFFFF == crc else "checksum of rich text"
    ring, write = bytearray(4096), len(DICTIONARY)
    ring[:write] = DICTIONARY
    out, at = bytearray(), 0
    while at < len(body) and len(out) < min(raw, RTF_BYTES):
        flags = body[at]
        at += 1
        for bit in range(8):
            if flags >> bit & 1:
                if at + 2 > len(body):
                    return bytes(out), note or "rich text cut short"
                token = body[at] << 8 | body[at + 1]
                at += 2
                read = token >> 4
                if read == write:
                    return bytes(out[:raw]), note
                found = 0
                while found < (token & 15) + 2:
                    c = ring[(read + found) % 4096]
                    out.append(c)
                    ring[write] = c
                    write = (write + 1) % 4096
                    found += 1
            elif at < len(body):
                out.append(body[at])
                ring[write] = body[at]
                write = (write + 1) % 4096
                at += 1
    return bytes(out[: min(raw, RTF_BYTES)]), note if len(out) >= raw else note or "rich text cut short"
