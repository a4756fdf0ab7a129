"""Personal data by boosted candidates.

Base spans follow fixed formats and always stay.  Beyond them high-recall
generators propose overlapping spans (written-out addresses, numbers without a
prefix, IPv6), boosted trees judge each by its format and its context, and a
calibrated threshold per kind selects what is redacted as well.

The trees are trained here, on ``EXAMPLES`` made-up sentences of a seeded
generator and on a quarter as many lists of numbers; half of them calibrate the
scores and set the thresholds.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Calibration

KINDS = ("email", "ip", "card", "phone")
#: Training sentences, their seed, and the precision that a threshold must show on the calibration half.
EXAMPLES, SEED, PRECISION = 6000, 7, 0.99
#: Code points of context on either side.
CONTEXT = 24

Span = tuple[int, int, int]  # start, end, kind

# ----------------------------------------------------------------------- base spans

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# matches any number, so that a long one without a dot is passed over at once
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the e-mail pattern finds, looked for from each @ (the local part reaches back to the last @ or match at most)."""
    done, at, before = 0, text.find("@"), 0
    while at >= 0:
        low = max(done, before)
        start = low + len(text[low:at].rstrip(_LOCAL))
        before = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of each kind, by start, then kind."""
    out = [(s, e, 0) for s, e in _emails(text)]
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        groups = [g.span() for g in _DIGIT.finditer(text, m.start(), m.end())]
        for k in range(0, len(groups) - 3, 4):
            if all(_octet(text[s:e]) for s, e in groups[k : k + 4]):
                out.append((groups[k][0], groups[k + 3][1], 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


# ----------------------------------------------------------------------- candidates

_SPELT = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?(?:@|\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z]{2,24})+", re.I)
_NUMBERS = re.compile(r"\(?[0-9][0-9().\x20/-]{6,}[0-9]")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])")
# without one of these the pattern of written-out addresses finds nothing
_AT = re.compile(r"@|\(at\)|\[at\]|\sat\s", re.I)


def _numbers(text: str, start: int, end: int) -> Iterator[Span]:
    """The spans from one digit group to another of a run that can be numbers; no more than 19 a group."""
    groups = [g.span() for g in _DIGIT.finditer(text, start, end)]
    for k, (s, _) in enumerate(groups):
        low, n = s - (s > start and text[s - 1] == "("), 0
        for a, e in groups[k:]:
            n += e - a
            if n > 19:
                break
            if e - low >= 8:
                if n >= 12:
                    yield low, e, 2
                if 7 <= n <= 15:
                    yield low, e, 3


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data; runs of numbers and their parts are proposed as card and as phone."""
    out: list[Span] = []
    if _AT.search(text):
        out += [(m.start(), m.end(), 0) for m in _SPELT.finditer(text)]
    if text.count(":") >= 3:
        out += [(m.start(), m.end(), 1) for m in _COLONS.finditer(text)]
    for m in _NUMBERS.finditer(text):
        out += _numbers(text, m.start(), m.end())
    return out


_CUES = (
    re.compile(r"(e-?mail|contact|write|reach|address|mailto|kontakt|correo|courriel|schreib)", re.I),
    re.compile(r"(\bip\b|ipv6|server|host|login from|addr)", re.I),
    re.compile(r"(card|visa|master|credit|debit|karte|tarjeta|carte|payment|paid)", re.I),
    re.compile(r"(phone|tel\b|tel\.|call|mobile|fax|whatsapp|sms|anruf|telefon|téléphone|teléfono|llam)", re.I),
)
_OTHER_CUE = re.compile(r"(version|order|invoice|isbn|part|serial|build|\bid\b|no\.|ref|total|date|sku|article|rechnung|bestell)", re.I)


# the digit groups that go on before and after a span
_LEFT, _RIGHT = re.compile(r"([0-9]+)[().\x20/-]*$"), re.compile(r"[().\x20/-]*([0-9]+)")


def features(text: str, span: Span) -> list[float]:
    s, e, kind = span
    body = text[s:e]
    before, after = text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
    digits = "".join(c for c in body if c.isdigit())
    groups = [len(g) for g in re.findall(r"[0-9]+", body)] or [0]
    prev, following = before[-1:], after[:1]
    left, right = _LEFT.search(before), _RIGHT.match(after)
    return [
        *(float(kind == k) for k in range(4)), float(len(body)), float(len(digits)), float(len(groups)), float(max(groups)), float(min(groups)),
        float(bool(digits) and luhn(digits)), float(body.count(" ")), float(body.count("-")), float(body.count(".")), float(body.count("/")),
        float(body.count("(")), float(body.count(":")), float("@" in body), float(bool(re.search(r"\bat\b|\[at\]|\(at\)", body, re.I)) and bool(re.search(r"\bdot\b|\[dot\]|\(dot\)", body, re.I))),
        float(bool(_CUES[kind].search(before))), float(bool(_CUES[kind].search(after))), float(bool(_OTHER_CUE.search(before))),
        float(prev.isdigit() or prev in (".", "-", "/", "#", "$", "€")), float(prev.isalpha()), float(following.isdigit() or following in ("%", "/")), float(following.isalpha()),
        float(groups[0] == 4 and digits[:2] in ("19", "20")), float(sum(c in "abcdefABCDEF" for c in body)), float(len(set(digits))),
        float(groups[0]), float(groups[-1]), float(len(left[1]) if left else 0), float(len(right[1]) if right else 0),
    ]


# ------------------------------------------------------------------------- training


def _sentence(r: random.Random) -> tuple[str, Span, int]:
    """A made-up text, a candidate in it and whether it is personal data."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("aeiourstlnmdkp") for _ in range(r.randint(2, 8)))
    sep = r.choice([" ", "-", "."])
    kind, good = r.randrange(4), r.random() < 0.5
    if kind == 0:
        body = f"{w()}{r.choice(['.', '', '_'])}{w()}" + r.choice([" at ", " [at] ", "(at)", " (at) "]) + w() + r.choice([" dot ", "[dot]", " (dot) "]) + r.choice(["com", "org", "net", "de"])
        if not good:
            body = f"{w()} at {w()}.{r.choice(['The', 'in', 'we', w()])}"
        cues = ["email me: ", "contact ", "write to ", "reach us via ", ""]
    elif kind == 1:
        body = ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(8))
        if not good:
            body = ":".join(d(2) for _ in range(r.randint(4, 6)))
        cues = ["from IP ", "server ", "login from ", "host ", ""]
    elif kind == 2:
        digits = r.choice("3456") + d(14)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        body = "/".join(digits[i : i + 4] for i in range(0, 16, 4)) if r.random() < 0.3 else ".".join(digits[i : i + 4] for i in range(0, 16, 4))
        if not good:
            body = r.choice([d(16), d(13), f"{d(4)}.{d(4)}.{d(5)}", f"{d(6)} {d(6)} {d(3)}", f"{d(4)}-{d(4)}-{d(4)}"])
        cues = ["card number ", "paid by visa ", "credit card ", "Karte "] + [""] * (not good)
    else:
        body = r.choice([f"({d(3)}) {d(3)}{sep}{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"0{d(2)} {d(4)} {d(4)}"])
        if not good:
            body = r.choice([f"{d(2)}.{d(2)}.20{d(2)} {d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", d(10), d(8), f"{d(3)}.{d(3)}.{d(3)}", f"{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{d(4)} {d(4)}"])
        cues = ["phone: ", "call ", "tel. ", "mobile ", "Telefon "] + [""] * (not good)
    others = ["order ", "invoice no. ", "version ", "serial ", "ISBN ", "build ", "ref ", "on ", "at "]
    head = " ".join(w() for _ in range(r.randint(0, 4))) + " "
    head += r.choice(cues) if good or r.random() < 0.15 else r.choice([*others, ""])
    text = head + body + r.choice([" ", ". ", ", ", ""]) + " ".join(w() for _ in range(r.randint(0, 4)))
    return text, (len(head), len(head) + len(body), kind), int(good)


def _listed(r: random.Random) -> list[tuple[str, Span, int]]:
    """A made-up text with numbers in a row, or an address with one part spelt out: its candidates and whether each is one whole personal datum."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("aeiourstlnmdkp") for _ in range(r.randint(2, 8)))
    kind, good = r.choice([0, 2, 2, 3, 3]), r.random() < 0.6
    head = " ".join(w() for _ in range(r.randint(0, 4))) + " "
    if kind == 0:
        head += r.choice(["email me: ", "contact ", "write to ", "reach us via ", ""])
        at, dot = r.choice([("(at)", "."), ("[at]", "."), (" (at) ", "."), (" [at] ", "."), ("@", " dot "), ("@", "[dot]")])
        items, joint = [f"{w()}{at}{w()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"], ""
    elif kind == 2:
        sep, joint = r.choice([("", " "), ("", "  "), ("", " / "), ("", "/"), (" ", " "), ("-", " "), (" ", " / ")])
        head += r.choice(["card number ", "paid by visa ", "credit cards ", "Karte ", "", ""])
        items = []
        for _ in range(r.randint(2, 4)):
            digits = r.choice("3456") + d(14)
            last = next(c for c in "0123456789" if luhn(digits + c))
            digits += last if good else r.choice([c for c in "0123456789" if c != last])
            items.append(sep.join(digits[i : i + 4] for i in range(0, 16, 4)))
    else:
        sep, joint, shape = r.choice([" ", "-", "."]), r.choice([" ", "  ", " / ", " / "]), r.randrange(4)
        head += r.choice(["phone: ", "call ", "tel. ", "mobile ", "Telefon "]) if good else r.choice(["order ", "invoice no. ", "serial ", "ref ", ""])
        number = lambda: [f"({d(3)}) {d(3)}{sep}{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"0{d(2)} {d(7)}", f"0{d(2)} {d(4)} {d(4)}"][shape]
        items = [number() if good else r.choice([d(8), d(10), f"{d(4)} {d(4)}"]) for _ in range(r.randint(2, 4))]
    text, true = head, set()
    for k, item in enumerate(items):
        text += joint if k else ""
        true.add((len(text), len(text) + len(item), kind))
        text += item
    text += r.choice([" ", ". ", ", ", ""]) + " ".join(w() for _ in range(r.randint(0, 4)))
    return [(text, c, int(c in true and (good or kind == 0))) for c in candidates(text)]


class Judge:
    """Trees, calibration and a threshold per kind."""

    def __init__(self, examples: int = EXAMPLES, seed: int = SEED) -> None:
        r = random.Random(seed)
        made, half = [_sentence(r) for _ in range(examples)], examples // 2
        listed = [_listed(r) for _ in range(examples // 4)]
        taught = made[:half] + [e for own in listed[::2] for e in own]
        made, half = taught + made[half:] + [e for own in listed[1::2] for e in own], len(taught)
        x, y = np.array([features(t, s) for t, s, _ in made]), np.array([g for _, _, g in made], dtype=np.float64)
        self.trees = BoostedTrees().fit(x[:half], y[:half])
        z = self.trees.logits(x[half:])
        self.scale = Calibration().fit(z, y[half:])
        p, kind, truth = self.scale(z), np.array([s[2] for _, s, _ in made[half:]]), y[half:]
        self.limits = []
        for k in range(len(KINDS)):
            order = np.argsort(-p[kind == k])
            score, hit = p[kind == k][order], truth[kind == k][order]
            exact = np.cumsum(hit) / np.arange(1, len(hit) + 1)
            last = np.flatnonzero(exact >= PRECISION)
            self.limits.append(max(0.9, float(score[last[-1]])) if len(last) else 1.1)

    def select(self, texts: list[str], spans: list[list[Span]]) -> list[list[Span]]:
        """Of each text's candidates those at or over their threshold, the best where they overlap, in order."""
        flat = [(k, s) for k, own in enumerate(spans) for s in own]
        out: list[list[Span]] = [[] for _ in texts]
        if not flat:
            return out
        p = self.scale(self.trees.logits(np.array([features(texts[k], s) for k, s in flat])))
        for i in sorted(range(len(flat)), key=lambda i: (-p[i], flat[i])):
            k, s = flat[i]
            if p[i] >= self.limits[s[2]]:
                # what is chosen does not overlap, so only the neighbours in order of start matter
                at = bisect_left(out[k], s)
                if (at == 0 or out[k][at - 1][1] <= s[0]) and (at == len(out[k]) or s[1] <= out[k][at][0]):
                    out[k].insert(at, s)
        return out


@lru_cache(maxsize=1)
def judge() -> Judge:
    return Judge()


def _clear_of(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of ``taken``."""
    order = sorted(taken)
    starts, reach = [x[0] for x in order], list(accumulate((x[1] for x in order), max))

    def clear(s: Span) -> bool:
        before = bisect_left(starts, s[1])
        return before == 0 or reach[before - 1] <= s[0]

    return [s for s in spans if clear(s)]


def find(texts: list[str], by: Judge) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text; what overlaps a base span is not added."""
    base = [base_spans(t) for t in texts]
    free = []
    for t, own in zip(texts, base, strict=True):
        free.append(_clear_of(candidates(t), own))
    return list(zip(base, by.select(texts, free), strict=True))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


FIELDS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: counts and digest of the base spans, and all spans.

    Null texts are empty; repeated rows get a row each; other columns are not read.
    Texts are read whole, however long, and one text by one task; its spans are found
    in time that grows with their number times its logarithm.
    """
    held = docs.sparkSession.sparkContext.broadcast(judge())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                rows = []
                for base, added in find([t or "" for t in b.column(1).to_pylist()], held.value):
                    n = [sum(s[2] == k for s in base) for k in range(4)]
                    rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
                types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
                names = [f.split()[0] for f in FIELDS.split(", ")]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FIELDS)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span (overlaps united) replaced by its kind in brackets."""
    out, at = [], 0
    for s, e, k in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
