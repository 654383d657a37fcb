"""The text parts of an archived mail, with transfer encodings undone."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re
from collections.abc import Iterator

EMPTY_LINE = re.compile(r"\n\r?\n")
CONTENT_TYPE = re.compile(r"^content-type[ \t]*:[ \t]*(.*(?:\n[ \t].*)*)", re.I | re.M)
ENCODING = re.compile(r"^content-transfer-encoding[ \t]*:[ \t]*([^\s;]+)", re.I | re.M)
BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]*)"|([^;\s]+))', re.I)
CHARSET = re.compile(r'charset\s*=\s*"?([^";\s]+)', re.I)
TAG = re.compile(r"<!--.*?-->|<[a-zA-Z/!?][^>]*>", re.S)
NOT_BASE64 = re.compile(rb"[^A-Za-z0-9+/]+")


def header_end(text: str) -> int:
    """Where the header lines end: at the first empty line, or at the text's end if it has none."""
    if text.startswith(("\n", "\r\n")):
        return 0
    m = EMPTY_LINE.search(text)
    return m.start() + 1 if m else len(text)


def _split(entity: str) -> tuple[str, str]:
    if entity.startswith(("\n", "\r\n")):
        return "", entity[entity.index("\n") + 1 :]
    m = EMPTY_LINE.search(entity)
    return (entity[: m.start() + 1], entity[m.end() :]) if m else (entity, "")


def _between(body: str, boundary: str) -> list[str] | None:
    """The parts between delimiter lines, None if there is no such line. A part without an end goes on to the text's end."""
    pieces = ("\n" + body).split("\n--" + boundary)
    if len(pieces) == 1:
        return None
    parts: list[str] = []
    for piece in pieces[1:]:
        first, _, rest = piece.partition("\n")
        mark = first.strip()
        if not mark:
            parts.append(rest)
        elif mark == "--":
            break
        elif parts:  # a longer boundary that begins alike belongs to a part inside
            parts[-1] += "\n--" + boundary + piece
    return parts


def _decoded(raw: bytes, charset: str | None) -> str:
    for name in (charset or "utf-8", "utf-8"):
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("latin-1")


def _content(body: str, encoding: str, charset: str | None) -> str:
    if encoding == "base64":
        raw = NOT_BASE64.sub(b"", body.encode("ascii", "ignore"))
        raw = raw[: len(raw) - (len(raw) % 4 == 1)]
        try:
            return _decoded(base64.b64decode(raw + b"=" * (-len(raw) % 4)), charset)
        except binascii.Error:
            return ""
    if encoding == "quoted-printable":
        return _decoded(quopri.decodestring(body.encode("utf-8", "surrogatepass")), charset)
    return body


def text_parts(text: str) -> Iterator[str]:
    """The content of each text part, html as the text it shows: tags dropped, entities resolved.

    A mail without a content type is plain text. A multipart without delimiter lines counts as plain text as a whole;
    what stands before the first or after the last delimiter is no part. Broken base64 is decoded as far as it goes.
    """
    todo = [text]
    while todo:
        header, body = _split(todo.pop())
        found = CONTENT_TYPE.search(header)
        declared = found[1] if found else "text/plain"
        kind = declared.split(";", 1)[0].strip().lower()
        if kind.startswith("multipart/"):
            b = BOUNDARY.search(declared)
            parts = _between(body, (b[1] if b[1] is not None else b[2])) if b else None
            if parts is not None:
                todo += reversed(parts)
                continue
            kind = "text/plain"
        if kind == "message/rfc822":
            todo.append(body)
        elif kind.startswith("text/") or "/" not in kind:
            encoding = ENCODING.search(header)
            charset = CHARSET.search(declared)
            content = _content(body, encoding[1].lower() if encoding else "", charset[1] if charset else None)
            yield html.unescape(TAG.sub("", content)) if kind == "text/html" else content
