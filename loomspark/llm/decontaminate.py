"""Benchmark decontamination with one FM-index per training shard.

Every task cuts its documents into shards, builds an FM-index over each (suffix
array, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions),
searches all benchmark windows backwards through it at once and merges the
located occurrences into removal spans.

Words are the 64-bit hashes of ``textvec.word_hashes``.  A word that occurs in
no benchmark window can be part of no occurrence, so the index holds only the
runs of benchmark words that are long enough for the shortest window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written
from .textvec import CHUNK, FOLDED, bytes_of, glued, word_hashes

#: Words in a window.
WINDOW = 10
#: Bytes of document text in a shard.
SHARD_BYTES = 8 * CHUNK
#: Every so many suffix positions one is kept.
SAMPLE = 8
#: Characters of benchmark text that are searched at once; more is searched block after block.
BLOCK_CHARS = 16_000_000

OUT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
    "contaminated boolean, removal_spans array<struct<start:long,stop:long>>"
)


# --------------------------------------------------------------------------- index


class WaveletMatrix:
    """Rank queries on a sequence over ``0 .. sigma-1``, a bit vector per level."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before position ``upto``."""
        at, base = upto.copy(), np.zeros_like(upto)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            at_1, base_1 = ones[at], ones[base]
            at = np.where(one, zeros + at_1, at - at_1)
            base = np.where(one, zeros + base_1, base - base_1)
        return at - base


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; ``seq`` must end in its unique smallest symbol."""
    _, rank = np.unique(seq, return_inverse=True)
    rank, n, step = rank.astype(np.int64), len(seq), 1
    while True:
        follow = np.zeros(n, dtype=np.int64)
        follow[: max(0, n - step)] = rank[step:] + 1
        order = np.argsort(rank * (n + 2) + follow, kind="stable")
        key = (rank * (n + 2) + follow)[order]
        fresh = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """FM-index of runs of symbols.

    ``seq`` holds 0 for the end of a run, else symbols from 1 on.  Ends of runs
    count as distinct, ordered by position, so no suffix reaches past its run.
    """

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE) -> None:
        ends = seq == 0
        n_ends = int(ends.sum())
        distinct = seq + n_ends
        # the last end is the smallest, as a suffix array by doubling wants
        distinct[ends] = np.arange(n_ends)[::-1]
        self.sa = suffix_array(distinct)
        self.sigma = int(seq.max(initial=0)) + 1
        before = seq[self.sa - 1]
        self.bwt = before
        self.tree = WaveletMatrix(before, self.sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=self.sigma))))
        # a suffix position is kept at every sample-th place and where a run begins
        self.kept = (self.sa % sample == 0) | (before == 0)
        self.positions = np.where(self.kept, self.sa, -1)
        del self.sa

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[low, high)`` of each window; windows are right-aligned in their matrix."""
        low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), len(self.bwt), dtype=np.int64)
        width = windows.shape[1]
        for back in range(1, width + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                continue
            symbol = windows[live, width - back]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows, walking back to the nearest kept position."""
        found, steps = np.full(len(rows), -1, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        rows, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            done = self.kept[rows[open_]]
            ready = open_[done]
            found[ready] = self.positions[rows[ready]] + steps[ready]
            open_ = open_[~done]
            symbol = self.bwt[rows[open_]]
            rows[open_] = self.first[symbol] + self.tree.rank(symbol, rows[open_])
            steps[open_] += 1
        return found


# ------------------------------------------------------------------------- phrases


@dataclass
class Phrases:
    """The windows of one block of benchmark items, without repetition."""

    vocabulary: np.ndarray  # sorted word hashes
    windows: np.ndarray  # symbols from 1 on, right-aligned, 0 before
    lengths: np.ndarray
    items: list[str]
    item_at: np.ndarray  # item_of[item_at[w]:item_at[w+1]] are the items that have window w
    item_of: np.ndarray

    @property
    def shortest(self) -> int:
        return int(self.lengths.min())


def phrases(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases | None:
    """Windows of ``(item_id, text)`` rows; None if no text has a word."""
    texts = [(t or "").encode() for _, t in items]
    owner: dict[tuple[int, ...], set[int]] = {}
    for first, _, buf, begin in glued(texts):
        starts, _, h = word_hashes(buf, FOLDED)
        cut = np.searchsorted(starts, begin)
        for k in range(len(begin) - 1):
            words = h[cut[k] : cut[k + 1]].tolist()
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owner.setdefault(tuple(words[i : i + window]), set()).add(first + k)
    if not owner:
        return None
    vocabulary = np.unique(np.fromiter((w for key in owner for w in key), dtype=np.uint64))
    lengths = np.fromiter((len(k) for k in owner), dtype=np.int64)
    matrix = np.zeros((len(owner), window), dtype=np.int64)
    for row, key in enumerate(owner):
        matrix[row, window - len(key) :] = np.searchsorted(vocabulary, np.array(key, dtype=np.uint64)) + 1
    sets = [sorted(s) for s in owner.values()]
    at = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    ids = ["" if i is None else str(i) for i, _ in items]
    return Phrases(vocabulary, matrix, lengths, ids, at, np.array([i for s in sets for i in s], dtype=np.int64))


# -------------------------------------------------------------------------- search


def _runs(h: np.ndarray, doc: np.ndarray, known: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and word numbers of the runs of benchmark words; 0 and -1 close each run."""
    at = np.minimum(np.searchsorted(known.vocabulary, h), len(known.vocabulary) - 1)
    is_in = known.vocabulary[at] == h
    where = np.flatnonzero(is_in)
    if not len(where):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    new = np.concatenate(([True], (np.diff(where) != 1) | (np.diff(doc[where]) != 0)))
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    long = size[run] >= known.shortest
    where, run = where[long], run[long]
    if not len(where):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    last = np.flatnonzero(np.concatenate((np.diff(run) != 0, [True]))) + 1
    return np.insert(at[where] + 1, last, 0), np.insert(where, last, -1)


def occurrences(seq: np.ndarray, known: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Window number and position in ``seq`` of every occurrence of a window."""
    alphabet, local = np.unique(seq, return_inverse=True)  # holds 0 in first place
    place = np.minimum(np.searchsorted(alphabet, known.windows), len(alphabet) - 1)
    here = (alphabet[place] == known.windows).all(axis=1) if 0 in alphabet else None
    chosen = np.flatnonzero(here)
    if not len(chosen):
        return chosen, chosen
    index = FMIndex(local.astype(np.int64))
    low, high = index.search(place[chosen], known.lengths[chosen])
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(chosen)), count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[which]
    return chosen[which], index.locate(rows)


@dataclass
class Found:
    """What a shard's search says about each document of the shard."""

    words: np.ndarray
    spans: list[list[tuple[int, int]]]  # merged, in word numbers of the document, end exclusive
    items: list[set[str]]
    chars: list[list[tuple[int, int]]]  # the same spans in code points


def search_shard(texts: list[bytes], known: Phrases | None) -> Found:
    n = len(texts)
    words = np.zeros(n, dtype=np.int64)
    syms, nums, docs, bounds = [], [], [], []
    base = 0
    for first, _, buf, begin in glued(texts):
        starts, ends, h = word_hashes(buf, FOLDED)
        doc = np.searchsorted(begin, starts, side="right") - 1
        words[first : first + len(begin) - 1] = np.bincount(doc, minlength=len(begin) - 1)
        if known is not None and len(h):
            sym, where = _runs(h, doc, known)
            inner = where >= 0
            syms.append(sym)
            nums.append(np.where(inner, where + base, -1))
            keep = where[inner]
            docs.append(np.where(inner, first + doc[where], -1))
            bounds.append((keep + base, starts[keep] - begin[doc[keep]], ends[keep] - begin[doc[keep]]))
        base += len(h)
    out = Found(words, [[] for _ in range(n)], [set() for _ in range(n)], [[] for _ in range(n)])
    if known is None or not sum(map(len, syms)):
        return out
    seq, num, doc = np.concatenate(syms), np.concatenate(nums), np.concatenate(docs)
    window, at = occurrences(seq, known)
    if not len(window):
        return out
    length = known.lengths[window]
    cover = np.zeros(len(seq) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length, -1)
    hit = np.cumsum(cover[:-1]) > 0
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    at_word = np.concatenate([b[0] for b in bounds])
    w_start, w_end = np.concatenate([b[1] for b in bounds]), np.concatenate([b[2] for b in bounds])
    before = np.concatenate(([0], np.cumsum(words)))
    merged: dict[int, list[list[int]]] = {}
    for s, e in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        merged.setdefault(int(doc[s]), []).append([int(num[s]), int(num[e - 1]) + 1])
    for d, spans in merged.items():
        text = texts[d]
        for s, e in spans:
            b0 = int(w_start[np.searchsorted(at_word, s)])
            b1 = int(w_end[np.searchsorted(at_word, e - 1)])
            out.spans[d].append((s - int(before[d]), e - int(before[d])))
            c0 = len(text[:b0].decode("utf-8", "replace"))
            out.chars[d].append((c0, c0 + len(text[b0:b1].decode("utf-8", "replace"))))
    pair = np.unique(doc[at] * len(known.lengths) + window)
    for d, w in zip((pair // len(known.lengths)).tolist(), (pair % len(known.lengths)).tolist(), strict=True):
        out.items[d].update(known.items[i] for i in known.item_of[known.item_at[w] : known.item_at[w + 1]].tolist())
    return out


def _shards(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    first = size = 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > limit:
            yield first, k
            first, size = k, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)`` saying what of ``benchmark(item_id, text, ...)`` it holds.

    ``removal_spans`` are merged, in code points, end exclusive.  Null or empty
    texts have no words and no hits; a null ``item_id`` counts as the empty
    string; repeated rows and ids give a row each; other columns are not read.
    The benchmark is the stated query set: it is read in blocks of at most
    ``block_chars`` characters (one item at least), and every block is searched
    in all documents.
    """
    spark = docs.sparkSession
    items, n_blocks = _items(benchmark, block_chars)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if n_blocks > 1:
        # the blocks' results of a row meet by a key of its own; written, as it must be the same for every block
        keyed = written(source.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "rows")
        source = keyed.select("row", "text")

    def run(block: list[tuple[object, str | None]]) -> DataFrame:
        held = spark.sparkContext.broadcast(phrases(block, window))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in batches:
                texts, rows = bytes_of(batch.column(1)), []
                for a, b in _shards(texts, shard_bytes):
                    f = search_shard(texts[a:b], known)
                    for k in range(b - a):
                        ids = ",".join(sorted(f.items[k]))
                        hit = sum(e - s for s, e in f.spans[k])
                        spans = [{"start": s, "stop": e} for s, e in f.chars[k]]
                        rows.append((int(f.words[k]), hit, len(f.items[k]), hashlib.sha256(ids.encode()).hexdigest(), hit > 0, spans, sorted(f.items[k])))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string())]
                names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "removal_spans", "items"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

        return source.mapInArrow(search, OUT + ", items array<string>")

    if n_blocks == 1:
        block = [(r["item_id"], r["text"]) for r in items.collect()]
        return run(block).drop("items")
    return _merged(keyed, items, n_blocks, run)


def _items(benchmark: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("n")).first()["n"] or 0
    return items, max(1, -(-int(total) // block_chars))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, all columns as they are, without a shuffle."""
    spark, text = docs.sparkSession, docs.columns.index("text")
    items, n_blocks = _items(benchmark, block_chars)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    for k in range(n_blocks):
        held = spark.sparkContext.broadcast(phrases([(r["item_id"], r["text"]) for r in items.filter(part == k).collect()], window))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, keep = bytes_of(b.column(text)), []
                for lo, hi in _shards(texts, shard_bytes):
                    keep += [not s for s in search_shard(texts[lo:hi], held.value).spans]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _merged(keyed: DataFrame, items: DataFrame, n_blocks: int, run) -> DataFrame:
    """The blocks' results joined by row key, which ``run`` gives as ``doc_id``: spans united, items united."""
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    found = None
    for k in range(n_blocks):
        block = [(r["item_id"], r["text"]) for r in items.filter(part == k).collect()]
        one = run(block)
        found = one if found is None else found.unionByName(one)
    out = found.groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("removal_spans"))).alias("spans"),
    )
    # Spans of different blocks may overlap: merge them, then count the words again.
    merge = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:long,stop:long>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    out = out.withColumn("removal_spans", merge).join(keyed, "row")
    words = F.aggregate(
        "removal_spans",
        F.lit(0).cast("long"),
        lambda n, s: n + F.regexp_count(F.substring("text", (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")),
    )
    return out.select(
        "doc_id", "n_words", words.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("removal_spans") > 0).alias("contaminated"), "removal_spans",
    )


def without_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the removal spans of ``found`` cut out of their texts (one row per ``doc_id`` on both sides)."""
    spans = found.filter("contaminated").select(F.col("doc_id").alias("_id"), "removal_spans")
    kept = F.aggregate(
        "removal_spans",
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["text"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("text"),
            s["stop"].alias("at"),
        ),
        lambda acc: F.concat(acc["text"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))),
    )
    return docs.join(spans, docs["doc_id"] == spans["_id"], "left").withColumn("text", F.coalesce(kept, F.col("text"))).select(*docs.columns)
