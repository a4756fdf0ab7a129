"""Decoding of response bodies: byte order mark, header, meta element, UTF-8."""

from __future__ import annotations

import codecs
import re

_META = re.compile(rb"""<meta[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", re.I)
_HEADER = re.compile(r"""charset\s*=\s*["']?([^\s;"']+)""", re.I)
# Labels whose meaning on the web differs from Python's.
_LABELS = {
    "latin1": "cp1252", "iso-8859-1": "cp1252", "l1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "gb2312": "gb18030", "gbk": "gb18030", "gb_2312-80": "gb18030",
    "x-gbk": "gb18030", "shift_jis": "cp932", "sjis": "cp932", "windows-31j": "cp932", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "big5": "big5hkscs", "iso-8859-9": "cp1254",
    "tis-620": "cp874", "x-user-defined": "cp1252", "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "utf-16": "utf-16-le", "x-sjis": "cp932",
}


def _codec(label: str) -> str | None:
    label = label.strip().lower()
    name = _LABELS.get(label, label)
    try:
        return codecs.lookup(name).name
    except LookupError:
        return None


def decode(body: bytes | None, content_type: str | None = None) -> str | None:
    """Text of a body; malformed bytes become U+FFFD."""
    if body is None:
        return None
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    kind = (content_type or "").split(";")[0].strip().lower()
    m = _HEADER.search(content_type or "")
    name = _codec(m[1]) if m else None
    if name is None and kind in ("", "text/html", "application/xhtml+xml") and (m := _META.search(body[:1024])):
        name = _codec(m[1].decode("ascii"))
        if name and name.startswith("utf-16"):
            name = "utf-8"
    return body.decode(name or "utf-8", "replace")
