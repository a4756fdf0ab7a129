"""Quality rules: line sequence labelling with a linear-chain conditional random field.

Every line of a document is *content* or *boilerplate*.  A linear-chain CRF over
line features, trained here on labelled documents, is decoded by Viterbi; the
share of a document's words that stand in content lines decides whether it stays,
after the fixed base rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import bytes_of, glued, mix, word_bounds

CONTENT, BOILERPLATE = 0, 1
#: Bound of the training sample: documents per quality label, in order of a hash of the id; each is used whole.
TRAIN_PER_LABEL = 1500
#: Share of words in content lines from which a document is kept.
KEEP_SHARE = 0.5
#: Base rules (fixed by the contract).
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

# Words that mark notices and page furniture.
_NOTICE = re.compile(
    r"\b(licen[cs]ed?|copyright|all rights reserved|cookies?|privacy policy|terms of (use|service)|subscribe|sign (in|up)|log ?in|click here|read more|share (this|on)|"
    r"follow us|newsletter|advertisement|powered by|javascript|home \||menu|next page|previous|back to top|impressum|datenschutz|mentions légales|aviso legal)\b",
    re.I,
)
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")

FEATURES = (
    "bias", "empty", "short", "long", "symbols", "bars", "bangs", "digits", "capitals", "few_letters", "no_stop", "duplicate",
    "repeats_words", "notice", "few_kinds", "many_pieces", "no_sentence", "edge",
)


def line_features(lines: list[str]) -> np.ndarray:
    """A row of 0..1 features per line."""
    out, seen = np.zeros((len(lines), len(FEATURES))), set()
    for k, line in enumerate(lines):
        words = _SPLIT.findall(line)
        n = len(words)
        if not n:
            out[k, :2] = 1
            continue
        chars = len(line)
        letters = sum(map(str.isalpha, line))
        kinds = len(set(words))
        out[k] = (
            1, 0, n < 4, n > 40, min(1.0, 10 * len(_SYMBOL.findall(line)) / n), min(1.0, 5 * line.count("|") / n), min(1.0, 3 * line.count("!") / n),
            min(1.0, 4 * sum(map(str.isdigit, line)) / chars), letters > 0 and sum(map(str.isupper, line)) > 0.6 * letters, letters < 0.5 * chars,
            line.rstrip()[-1:] not in ".!?:;\"'»”)", line in seen, min(1.0, 2 * max(0.0, 1 - kinds / n - 0.3)), _NOTICE.search(line) is not None,
            kinds < 0.5 * n, n > 5 and chars / n > 12, n > 8 and not re.search(r"[.!?]", line), k in (0, len(lines) - 1),
        )
        seen.add(line)
    return out


class LineCRF:
    """Two labels; emission weights per feature and a transition table."""

    def __init__(self) -> None:
        self.emit = np.zeros((len(FEATURES), 2))
        self.move = np.array([[0.5, -0.5], [-0.5, 0.5]])
        prior = dict(short=0.3, symbols=1.5, bars=2.0, bangs=2.0, capitals=1.5, few_letters=1.0, duplicate=1.0, repeats_words=2.5, notice=2.5, few_kinds=1.5, bias=-1.0)
        for k, name in enumerate(FEATURES):
            self.emit[k, BOILERPLATE] = prior.get(name, 0.0)

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels of a document's lines; ties go to content."""
        score = x @ self.emit
        n = len(score)
        back = np.zeros((n, 2), dtype=np.int8)
        a, b = score[0] if n else (0.0, 0.0)
        m = self.move.tolist()
        for k in range(1, n):
            aa, ba, ab, bb = a + m[0][0], b + m[1][0], a + m[0][1], b + m[1][1]
            back[k, 0], back[k, 1] = ba > aa, bb > ab
            a, b = max(aa, ba) + score[k, 0], max(ab, bb) + score[k, 1]
        out = np.zeros(n, dtype=np.int8)
        if n:
            out[-1] = b > a
            for k in range(n - 1, 0, -1):
                out[k - 1] = back[k, out[k]]
        return out

    def _expected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels and summed marginals of transitions (forward-backward in logs)."""
        score, n = x @ self.emit, len(x)
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        fwd[0] = score[0]
        for k in range(1, n):
            fwd[k] = score[k] + np.logaddexp.reduce(fwd[k - 1][:, None] + self.move, axis=0)
        for k in range(n - 2, -1, -1):
            bwd[k] = np.logaddexp.reduce(self.move + score[k + 1] + bwd[k + 1], axis=1)
        z = np.logaddexp.reduce(fwd[-1])
        pair = np.exp(fwd[:-1, :, None] + self.move + (score + bwd)[1:, None, :] - z).sum(axis=0) if n > 1 else np.zeros((2, 2))
        return np.exp(fwd + bwd - z), pair

    def fit(self, documents: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.5, pull: float = 0.02) -> LineCRF:
        """Stochastic gradient ascent on the likelihood, pulled towards the prior weights; order is fixed."""
        emit0, move0 = self.emit.copy(), self.move.copy()
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for x, y in documents:
                p, pair = self._expected(x)
                gold = np.eye(2)[y]
                moves = np.zeros((2, 2))
                np.add.at(moves, (y[:-1], y[1:]), 1)
                scale = step / max(1, len(x))
                self.emit += scale * (x.T @ (gold - p)) - step * pull * (self.emit - emit0)
                self.move += scale * (moves - pair) - step * pull * (self.move - move0)
        return self


def _teach(text: str, quality: int, seed_crf: LineCRF) -> tuple[np.ndarray, np.ndarray] | None:
    """Line labels of a training document: what the prior model says, held against the document's label.

    Lines of a good document are content but for plain notices; of a bad one, boilerplate
    where the prior leans that way at all.
    """
    x = line_features(text.split("\n"))
    if not len(x):
        return None
    lean = (x @ seed_crf.emit)[:, BOILERPLATE]
    notice = x[:, FEATURES.index("notice")] > 0
    y = np.where(notice | (lean > 1.5), 1, 0) if quality else np.where(lean > -0.5, 1, 0)
    return x, y.astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> LineCRF:
    """Trains on at most ``per_label`` labelled documents of either quality (a bounded, broadcast list of ids).

    Of several documents with one id the least text is learned from.
    """
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    clean = clean.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    pick = None
    for q in (0, 1):
        part = clean.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        pick = part if pick is None else pick.unionByName(part)
    crf = LineCRF()
    seed = LineCRF()

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *t) for d, text, q in zip(*(c.to_pylist() for c in b.columns), strict=True) if (t := _teach(text, q, seed))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].astype(np.float32).tobytes() for r in rows], pa.binary()), pa.array([r[2].astype(np.int8).tobytes() for r in rows], pa.binary())],
                names=["doc_id", "x", "y"],
            )

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(pick), "doc_id")
    text = text.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = text.select("doc_id", "text", "quality").mapInArrow(teach, "doc_id long, x binary, y binary").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    made = [(np.frombuffer(r["x"], dtype=np.float32).astype(np.float64).reshape(-1, len(FEATURES)), np.frombuffer(r["y"], dtype=np.int8).astype(np.int64)) for r in rows]
    return crf.fit(made) if made else crf


# ----------------------------------------------------------------------- base counts


def base_counts(texts: list[bytes]) -> np.ndarray:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` per text, exactly as the contract has them."""
    out = np.zeros((len(texts), 5), dtype=np.int64)
    for first, last, buf, begin in glued(texts):
        starts, ends = word_bounds(buf)
        cut = np.searchsorted(starts, begin)
        n = np.diff(cut)
        rows = slice(first, last)
        out[rows, 0] = n
        heads = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
        chars = heads[ends] - heads[starts]
        total = np.concatenate(([0], np.cumsum(chars)))
        out[rows, 1] = total[cut[1:]] - total[cut[:-1]]
        symbol = np.concatenate(([0], np.cumsum(np.isin(buf, np.frombuffer(b"#*$%&|<>", dtype=np.uint8)))))
        out[rows, 2] = symbol[begin[1:]] - symbol[begin[:-1]]
    for k, t in enumerate(texts):
        lines = t.split(b"\n")
        if len(lines) > 1:
            with_word = [x for x in lines if x and x.strip(b" \t\n\v\f\r")]
            out[k, 3] = len(with_word) - len(set(with_word))
    for first, last, buf, begin in glued(texts):
        starts, h = _white_hashes(buf)
        cut = np.searchsorted(starts, begin)
        out[first:last, 4] = repeat_words(h, cut)
    return out


def _white_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of white-space words. NUL is a letter here, so bytes are hashed shifted by one."""
    from .textvec import _POWERS

    starts, ends = word_bounds(buf)
    up, down = _POWERS.upto(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.multiply(buf.astype(np.uint64) + np.uint64(1), up[: len(buf)], out=sums[1:])
        np.add.accumulate(sums, out=sums)
        return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def repeat_words(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a 3-word window found at least twice in the text."""
    n_docs, total = len(cut) - 1, len(h)
    if total < 3:
        return np.zeros(n_docs, dtype=np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(cut))
    with np.errstate(over="ignore"):
        window = mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9))
        window = mix(window + doc[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    inside = doc[:-2] == doc[2:]
    at = np.flatnonzero(inside)
    order = at[np.argsort(window[at], kind="stable")]
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(total + 3, dtype=np.int64)
    np.add.at(hit, order[twice], 1)
    np.add.at(hit, order[twice] + 3, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(hit[:total]) > 0)))
    return covered[cut[1:]] - covered[cut[:-1]]


# ------------------------------------------------------------------------ operator


def content_share(text: str, crf: LineCRF) -> float:
    """Share of the words that stand in content lines (1 for a text without words)."""
    lines = text.split("\n")
    counts = np.array([len(_SPLIT.findall(x)) for x in lines])
    if not counts.sum():
        return 1.0
    return float(counts[crf.viterbi(line_features(lines)) == CONTENT].sum() / counts.sum())


FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def quality(docs: DataFrame, crf: LineCRF) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)`` with the base counts, ``base_failed``, ``kept`` and ``content_share``.

    Null and empty texts have no words and fail the base rules; documents that
    fail them are not decoded (their share is null); repeated rows get a row
    each; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                texts = bytes_of(b.column(1))
                n = base_counts(texts)
                failed = (n[:, 0] < MIN_WORDS) | (100 * n[:, 4] > MAX_REPEAT_PERCENT * n[:, 0])
                share = [None if f else content_share(t.decode("utf-8", "replace"), held.value) for f, t in zip(failed.tolist(), texts, strict=True)]
                kept = [s is not None and s >= KEEP_SHARE for s in share]
                cols = [b.column(0), *(pa.array(n[:, k]) for k in range(5)), pa.array(failed), pa.array(kept), pa.array(share, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in FIELDS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FIELDS)
