"""Media values: whatever a field extracted, as a list of media objects."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from . import dom, urls

# Attributes by priority and file extensions by kind.
_ATTRIBUTES = {
    "image": ("src", "url", "href", "data-src", "data-original", "data-lazy-src", "srcset", "poster"),
    "video": ("src", "url", "href", "data-src", "data-original"),
    "audio": ("src", "url", "href", "data-src", "data-original"),
}
_EXTENSIONS = {
    "image": ("jpg", "jpeg", "png", "webp", "gif", "bmp", "svg", "avif"),
    "video": ("mp4", "webm", "mov", "m4v", "m3u8", "avi", "mkv"),
    "audio": ("mp3", "wav", "aac", "m4a", "ogg", "flac"),
}
_CSS = re.compile(r"""url\(\s*['"]?([^'")]+)['"]?\s*\)""")
_TEXT = {k: re.compile(rf"""https?://[^\s"'<>\\)]+?\.(?:{"|".join(e)})(?:\?[^\s"'<>\\)]*)?""", re.I) for k, e in _EXTENSIONS.items()}
FIELDS = ("name", "url", "src", "width", "height", "size", "ext", "alt")


@dataclass(frozen=True)
class Mention:
    """One extracted value: its attributes, its texts (markup first) and the object's plain facts."""

    attributes: dict[str, Any]
    texts: tuple[str, ...]
    facts: dict[str, Any]

    @classmethod
    def of(cls, value: str | dict) -> Mention:
        if isinstance(value, str):
            return cls({}, (value,), {})
        nested = value.get("attrs")
        own = nested if isinstance(nested, dict) else value
        known = {**value, **own}
        facts = {"name": _string(value.get("name")), **{k: _count(known.get(k)) for k in ("width", "height", "size")}}
        facts["alt"] = _string(next((d[k] for d, k in ((own, "alt"), (own, "title"), (value, "alt")) if k in d), None))
        return cls(own, tuple(value[k] for k in ("html", "text") if isinstance(value.get(k), str)), facts)

    def offers(self, kind: str) -> Iterator[list[str]]:
        """Lists of addresses, the most telling first; a list that follows matters only if all before it gave no object."""
        given = ((k, self.attributes[k]) for k in _ATTRIBUTES[kind] if isinstance(self.attributes.get(k), str))
        chosen = next((a for a in ([x.split()[0] for x in v.split(",") if x.strip()] if k == "srcset" else [v] for k, v in given if k == "srcset" or v.strip())), None)
        if chosen:
            yield chosen
            return
        if kind != "image" and "<" in "".join(self.texts[:1]):
            yield [e.attrs["src"] for e in dom.select(dom.parse(self.texts[0]), "source[src]")]
        yield [u for t in self.texts for u in (_CSS.findall(t) or [m.group() for m in _TEXT[kind].finditer(t)] or [t])]


def _string(v: Any) -> str:
    return v if isinstance(v, str) else ""


def _count(v: Any) -> int:
    if isinstance(v, str) and re.fullmatch(r"\+?\d+", v):
        return int(v)
    return v if type(v) is int and v > 0 else 0


def _mentions(value: Any) -> Iterator[Mention]:
    """All strings and objects of a value, lists opened, in order."""
    open_ = [value]
    while open_:
        v = open_.pop()
        if isinstance(v, list):
            open_.extend(reversed(v))
        elif isinstance(v, (str, dict)):
            yield Mention.of(v)


def _resolved(address: str, kind: str, base: urls.Url) -> tuple[str, str] | None:
    """Absolute URL without fragment, and extension; none where it is no web address or of another kind."""
    try:
        url = replace(urls.parse(address, base), fragment=None)
    except urls.UrlError:
        return None
    extension = m.group(1).lower() if (m := re.search(r"\.([^./]*)$", url.path)) else ""
    fits = url.host and url.scheme in ("http", "https") and (not extension or extension in _EXTENSIONS[kind])
    return (str(url), extension) if fits else None


def normalize(value: Any, kind: str, base: str) -> Any:
    """The media objects of a value, the first of each URL; text fields stay as they are.

    An object's addresses come from the first of its attributes that has any; without
    one from ``source`` elements (not for images), else from its texts: CSS ``url()``,
    web addresses with a fitting extension, or the text itself.
    """
    if kind == "text":
        return value
    out: dict[str, dict] = {}
    for mention in _mentions(value):
        for offer in mention.offers(kind):
            found = [(a.strip(), r) for a in offer if a.strip() and (r := _resolved(a.strip(), kind, urls.parse(base)))]
            for source, (url, extension) in found:
                blank = {"name": "", "width": 0, "height": 0, "size": 0, "alt": ""}
                out.setdefault(url, {k: {**blank, **mention.facts, "url": url, "src": source, "ext": extension}[k] for k in FIELDS})
            if found:
                break
    return list(out.values())
