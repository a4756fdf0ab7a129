"""N-gram Jaccard self-join by chosen paths.

A document is the set of its five-word shingles.  Equal sets form one class and
are joined once.  Each class carries a min-wise sketch; a sketch coordinate is a
sampled token that two sets share with probability equal to their similarity.

1. *Recursive splitting.*  In every run a node splits its sets on one sampled
   coordinate, with probability 1/4 on a second one (1/0.8 on average).  Nodes
   of at most ``SMALL`` sets are leaves, as are dense ones and those at ``DEPTH``.
2. *Leaves.*  Small leaves compare all sketches; larger ones compare with
   leaders.  What may be similar is connected, so groups of candidates come out.
3. *Verification.*  Inside a group exact intersections are counted, in pairs of
   bounded blocks, and only counts and spanning links leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import Scratch, discard, written
from .textvec import FOLDED, bytes_of, glued, mix, word_hashes

#: Words in a shingle; shorter texts are one shingle of all their words.
SHINGLE = 5
#: Similarity of a link.
THRESHOLD = Fraction(4, 5)
#: Coordinates of a sketch.
SKETCH = 64
#: Independent runs of the recursion. A pair at the threshold misses one run with probability of at most 0.36.
RUNS = 12
#: Deepest level of the recursion.
DEPTH = 3
#: Sets in a leaf that needs no further split.
SMALL = 64
#: Sets that a task compares with leaders at once; larger leaves are salted into groups of about this size.
GROUP = 2048
#: Sets, and shingles, in a block of the verification.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 400_000

_rng = np.random.default_rng(20240117)
_A = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_ROOT = [(run, int(c)) for run in range(RUNS) for c in _rng.permutation(SKETCH)[: 1 + (run % 4 == 0)]]
_MULT = [np.uint64(m | 1) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


# -------------------------------------------------------------------- shingle sets


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per buffer: first text, index after the last, 48-bit shingles sorted by text and value, offset per text."""
    for first, last, buf, begin in glued(texts):
        starts, _, h = word_hashes(buf, FOLDED)
        cut = np.searchsorted(starts, begin)
        n_words = np.diff(cut)
        with np.errstate(over="ignore"):
            long = max(0, len(h) - size + 1)
            value = np.zeros(len(h), dtype=np.uint64)
            for k in range(size):
                value[:long] += h[k : k + long] * _MULT[k % len(_MULT)]
            value = mix(value)
            place = np.arange(len(h)) - np.repeat(cut[:-1], n_words)
            whole = place + size <= np.repeat(n_words, n_words)
            for d in np.flatnonzero((n_words > 0) & (n_words < size)).tolist():
                total = np.uint64(int(n_words[d]))
                for k, w in enumerate(h[cut[d] : cut[d + 1]]):
                    total = total + w * _MULT[k % len(_MULT)]
                value[cut[d]], whole[cut[d]] = mix(np.array([total]))[0], True
        doc = np.repeat(np.arange(last - first, dtype=np.uint64), n_words)[whole]
        value = value[whole] >> np.uint64(16)
        if last - first <= 1 << 16:
            key = np.unique(doc << np.uint64(48) | value)
            value = key & np.uint64((1 << 48) - 1)
            at = np.searchsorted(key, np.arange(last - first + 1, dtype=np.uint64) << np.uint64(48)) if last - first < 1 << 16 else None
            if at is None:
                at = np.searchsorted(key >> np.uint64(48), np.arange(last - first + 1))
        else:  # more texts than the key has room for: mostly empty ones
            order = np.lexsort((value, doc))
            doc, value = doc[order], value[order]
            fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))) if len(doc) else np.empty(0, dtype=bool)
            doc, value = doc[fresh], value[fresh]
            at = np.searchsorted(doc, np.arange(last - first + 1, dtype=np.uint64))
        yield first, last, value, at.astype(np.int64)


def set_ids(value: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each set, from order-free sums of its mixed shingles."""
    out = []
    with np.errstate(over="ignore"):
        halves = []
        for salt in (0x51ED270B9A3C5F11, 0xA0761D6478BD642F):
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.add.accumulate(mix(value ^ np.uint64(salt)))))
            halves.append(mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)))
    out = np.stack(halves, axis=1).astype(">u8").tobytes()
    return [out[16 * k : 16 * k + 16] for k in range(len(at) - 1)]


def sketches(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Min-wise sketches (int32, one row per set); empty sets get zeros."""
    n = np.diff(at)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), SKETCH), dtype=np.uint32)
    if len(full):
        heads = at[full]
        with np.errstate(over="ignore"):
            for j in range(SKETCH):
                out[full, j] = np.minimum.reduceat(((value * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), heads)
    return out.view(np.int32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, rows = [], [], []
        for _, _, value, at in shingle_sets(bytes_of(batch.column(1))):
            ids += set_ids(value, at)
            sizes.append(np.diff(at))
            rows.append(sketches(value, at))
        flat = np.concatenate(rows).ravel() if rows else np.empty(0, dtype=np.int32)
        n = len(ids)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SKETCH), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.binary()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), lists],
            names=["doc_id", "set_id", "n_set", "sketch"],
        )


# ------------------------------------------------------------------------ splitting


#: Coordinates whose lowest bits tell how alike the sets of a node are.
_BITS = tuple(range(16))
#: Mean agreement of those bits from which a node is dense: similarity s shows as (1 + s) / 2.
DENSE = 0.86


def _children(depth: int) -> F.Column:
    """Paths of the next level: the sampled coordinates of a node and the set's tokens there."""
    if depth == 0:
        return F.array(*[F.xxhash64(F.lit(run), F.lit(c), F.col("sketch")[c]) for run, c in _ROOT])
    one = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(SKETCH)).cast("int")
    two = F.pmod(F.xxhash64("path", F.lit(2)), F.lit(SKETCH)).cast("int")
    child = lambda c: F.xxhash64("path", c, F.get(F.col("sketch"), c))
    return F.when(F.pmod(F.xxhash64("path", F.lit(3)), F.lit(4)) == 0, F.array(child(one), child(two))).otherwise(F.array(child(one)))


def leaves(classes: DataFrame, small: int = SMALL, depth: int = DEPTH, scratch: Scratch | None = None) -> DataFrame:
    """``(path, size, set_id, sketch)``: each set once per leaf that it shares with another set.

    A node is a leaf if it is small, as deep as allowed, or dense: its sets are so
    alike that splitting would only repeat them.  Only sizes and bit counts of
    nodes are aggregated (with map-side sums); sets are joined to the written
    sizes, which leaves a heavy node to Spark's splitting of skewed joins, and
    take up their sketches again only where another set shares the node.
    """
    scratch = scratch or Scratch()
    full = classes.filter("n_set > 0")
    sketch = full.select("set_id", "sketch")
    bits = F.shiftleft(F.lit(0), 0)
    for k in _BITS:
        bits = bits.bitwiseOR(F.shiftleft(F.get(F.col("sketch"), F.lit(k)).bitwiseAND(F.lit(1)), k))
    nodes = full.select("set_id", bits.alias("bits"), F.explode(_children(0)).alias("path"))
    out = None
    for level in range(depth):
        ones = [F.sum(F.shiftright("bits", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in _BITS]
        share = [(F.col(f"b{k}") * F.col(f"b{k}") + (F.col("size") - F.col(f"b{k}")) * (F.col("size") - F.col(f"b{k}"))) / (F.col("size") * F.col("size")) for k in _BITS]
        sizes = nodes.groupBy("path").agg(F.count("*").alias("size"), *ones).filter("size > 1")
        dense = sum(share[1:], share[0]) / F.lit(float(len(_BITS))) >= DENSE
        stop = (F.col("size") <= small) | dense if level < depth - 1 else F.lit(True)
        sizes = scratch.written(sizes.select("path", "size", stop.alias("stop")), "nodes")
        nodes = scratch.written(nodes.hint("merge").join(sizes, "path").select("path", "size", "stop", "set_id", "bits"), "split")
        done = nodes.filter("stop").select("path", "size", "set_id")
        out = done if out is None else out.unionByName(done)
        if level < depth - 1:
            nodes = nodes.filter("NOT stop").join(sketch, "set_id").select("set_id", "bits", F.explode(_children(level + 1)).alias("path"))
    return out.hint("merge").join(sketch, "set_id").select("path", "size", "set_id", "sketch")


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from a stream that is sorted by its first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in range(n_keys):
            col = np.array(batch.column(k).to_pylist(), dtype=object)
            change[1:] |= col[1:] != col[:-1]
            if held and held[-1].column(k)[-1].as_py() != col[0]:
                change[0] = True
        heads = np.flatnonzero(change)
        if not held and not len(heads):
            held = [batch]
            continue
        if len(heads):
            last = int(heads[-1])
            if last or held:
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, SKETCH)


class _Forest:
    """Union-find over the rows of a group; gives one spanning link per row that is not a root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> Iterator[tuple[int, int]]:
        for k in range(len(self.up)):
            if self.up[k] != k:
                yield k, self.root(k)


def _agree(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return (many == one).sum(axis=1)


#: Coordinates that must agree. Brute force: similarity 0.8 shows 38 of 64 or less once in 10,000 pairs.
_PAIR = 38
#: A set joins a leader at 0.8 or more as estimated; leaders of a linked pair then have 0.4 at least, 12 leaves room for error.
_LEADER, _LEADERS = 51, 12


def _near(sketch: np.ndarray) -> tuple[Iterator[tuple[int, int]], list[int]]:
    """Links between rows that may be similar, and the rows that lead."""
    n, forest, leaders = len(sketch), _Forest(len(sketch)), []
    if n <= 4 * SMALL:
        for k in range(1, n):
            for m in np.flatnonzero(_agree(sketch[k], sketch[:k]) >= _PAIR).tolist():
                forest.join(k, m)
        return forest.links(), [k for k in range(n) if forest.up[k] == k]
    lead = np.empty((0, SKETCH), dtype=sketch.dtype)
    for k in range(n):
        agree = _agree(sketch[k], lead)
        best = int(agree.argmax()) if len(agree) else -1
        if best >= 0 and agree[best] >= _LEADER:
            forest.join(k, leaders[best])
        else:
            for m in np.flatnonzero(agree >= _LEADERS).tolist():
                forest.join(k, leaders[m])
            leaders.append(k)
            lead = np.vstack((lead, sketch[k]))
    return forest.links(), leaders


_EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _leaf_links(emit_leaders: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 2):
            sets, sketch = table.column("set_id").to_pylist(), _matrix(table, "sketch")
            group = list(zip(table.column("path").to_pylist(), table.column("salt").to_pylist(), strict=True))
            a, b, kind, path = [], [], [], []
            start = 0
            for stop in range(1, len(group) + 1):
                if stop < len(group) and group[stop] == group[start]:
                    continue
                links, leaders = _near(sketch[start:stop]) if stop - start > 1 else ((), [0])
                for k, m in links:
                    a.append(sets[start + k]), b.append(sets[start + m]), kind.append(False), path.append(group[start][0])
                if emit_leaders:
                    for k in leaders:
                        a.append(sets[start + k]), b.append(sets[start + k]), kind.append(True), path.append(group[start][0])
                start = stop
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(kind, pa.bool_()), pa.array(path, pa.int64())], names=["a", "b", "leads", "path"])

    return run


_LINK = "a binary, b binary, leads boolean, path long"


def candidates(classes: DataFrame, leaf: DataFrame, group: int = GROUP, scratch: Scratch | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect all sets which may be similar; their number is linear in the leaves."""
    scratch = scratch or Scratch()
    salted = leaf.withColumn("salt", F.when(F.col("size") > group, F.pmod(F.xxhash64("set_id"), F.ceil(F.col("size") / group))).otherwise(F.lit(0)))
    columns = ["path", "salt", "set_id", "sketch"]
    narrow = salted.filter(F.col("size") <= group).select(columns)
    found = narrow.repartition("path", "salt").sortWithinPartitions("path", "salt", "set_id").mapInArrow(_leaf_links(False), _LINK)
    wide = salted.filter(F.col("size") > group).select(columns)
    first = scratch.written(wide.repartition("path", "salt").sortWithinPartitions("path", "salt", "set_id").mapInArrow(_leaf_links(True), _LINK), "leaders")
    leaders = first.filter("leads").select("path", F.lit(0).cast("long").alias("salt"), F.col("a").alias("set_id")).join(classes.select("set_id", "sketch"), "set_id")
    meet = leaders.select(columns).repartition("path", "salt").sortWithinPartitions("path", "salt", "set_id").mapInArrow(_meet, _LINK)
    every = found.unionByName(first.filter("NOT leads")).unionByName(meet)
    return every.select("a", "b").distinct()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaders of the salted groups of one leaf: all whose sets might be linked are connected."""
    for table in _grouped(batches, 1):
        sets, sketch, path = table.column("set_id").to_pylist(), _matrix(table, "sketch"), table.column("path").to_pylist()
        a, b, start = [], [], 0
        for stop in range(1, len(path) + 1):
            if stop < len(path) and path[stop] == path[start]:
                continue
            part, forest = sketch[start:stop], _Forest(stop - start)
            for k in range(1, stop - start):
                for m in np.flatnonzero(_agree(part[k], part[:k]) >= _LEADERS).tolist():
                    forest.join(k, m)
            for k, m in forest.links():
                a.append(sets[start + k]), b.append(sets[start + m])
            start = stop
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([False] * len(a), pa.bool_()), pa.array([0] * len(a), pa.int64())], names=["a", "b", "leads", "path"])


# --------------------------------------------------------------------- verification


def _overlaps(values: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sorted sets."""
    n = len(values)
    if n == 2:
        a, b = values
        at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
        both = int((b[at] == a).sum()) if len(b) else 0
        return np.array([[len(a), both], [both, len(b)]], dtype=np.int64)
    row = np.repeat(np.arange(n), [len(v) for v in values])
    _, col, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    _, col = np.unique(col[shared], return_inverse=True)
    row, width = row[shared], int(col.max(initial=-1)) + 1
    total = np.zeros((n, n), dtype=np.int64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, width, 4096):
        s, e = np.searchsorted(col, (lo, lo + 4096))
        m = np.zeros((n, min(4096, width - lo)), dtype=np.float32)
        m[row[s:e], col[s:e] - lo] = 1
        total += np.rint(m @ m.T).astype(np.int64)
    return total


def _verify(threshold: Fraction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    p, q = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 3):
            keys = list(zip(*(table.column(k).to_pylist() for k in ("grp", "bi", "bj")), strict=True))
            sets, block, copies = (table.column(k).to_pylist() for k in ("set_id", "block", "copies"))
            texts = bytes_of(table.column("text"))
            value, made = [], []
            for _, _, v, at in shingle_sets(texts):
                made += set_ids(v, at)
                value += [v[at[k] : at[k + 1]] for k in range(len(at) - 1)]
            out: dict[str, list] = {"set_id": [], "links": [], "other": []}
            start = 0
            for stop in range(1, len(keys) + 1):
                if stop < len(keys) and keys[stop] == keys[start]:
                    continue
                rows, seen = [], set()
                for k in range(start, stop):  # a repeated doc_id may bring other texts, or the same twice
                    if made[k] == sets[k] and sets[k] not in seen:
                        seen.add(sets[k])
                        rows.append(k)
                if len(rows) > 1:
                    size = np.array([len(value[k]) for k in rows])
                    both = _overlaps([value[k] for k in rows])
                    linked = (p + q) * both >= p * (size[:, None] + size[None, :])
                    np.fill_diagonal(linked, False)
                    side = np.array([block[k] for k in rows])
                    _, bi, bj = keys[start]
                    if bi != bj:
                        linked &= side[:, None] != side[None, :]
                    links = linked @ np.array([copies[k] for k in rows], dtype=np.int64)
                    forest = _Forest(len(rows))
                    for k in np.flatnonzero(links).tolist():
                        for m in np.flatnonzero(linked[k, :k]).tolist():
                            forest.join(k, m)
                    for k in np.flatnonzero(links).tolist():
                        out["set_id"].append(sets[rows[k]])
                        out["links"].append(int(links[k]))
                        out["other"].append(sets[rows[forest.root(k)]])
                start = stop
            yield pa.RecordBatch.from_arrays([pa.array(out["set_id"], pa.binary()), pa.array(out["links"], pa.int64()), pa.array(out["other"], pa.binary())], names=list(out))

    return run


def verified(docs: DataFrame, classes: DataFrame, groups: DataFrame, threshold: Fraction = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """``(set_id, links, other)``: exact links of each set inside its group, counted in copies.

    A group is dealt into blocks; every pair of blocks is one bounded unit of work.
    """
    scratch = scratch or Scratch()
    member = groups.join(classes.select("set_id", "rep", "n_set", "copies"), F.col("node") == F.col("set_id"))
    weight = member.groupBy("label").agg(F.count("*").alias("m"), F.sum("n_set").alias("w"))
    blocks = scratch.written(weight.select("label", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int").alias("nb")), "blocks")
    member = member.join(blocks, "label").select(
        "rep", "set_id", "copies", F.col("label").alias("grp"), "nb", F.pmod(F.xxhash64("set_id"), F.col("nb")).cast("int").alias("block")
    )
    member = scratch.written(member, "members")
    text = member.hint("merge").join(docs.select(F.col("doc_id").cast("long").alias("rep"), "text"), "rep")
    pairs = text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = pairs.select("grp", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "set_id", "block", "copies", "text")
    return pairs.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "set_id").mapInArrow(_verify(threshold), "set_id binary, links long, other binary")


def near_duplicates(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, class_id, n_links``.

    ``class_id`` is the least ``doc_id`` of the documents connected by links of
    at least ``threshold``; ``n_links`` counts the other documents linked to this
    one, exact copies included.  Texts without words and rows with a null
    ``doc_id`` link to nothing (their class is their own ``doc_id``).  Repeated
    rows give a row each and count as copies.  Other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = written(source.mapInArrow(_sketch, "doc_id long, set_id binary, n_set long, sketch array<int>"), "sketches")
    live = each.filter("n_set > 0 AND doc_id IS NOT NULL")
    counts = written(live.groupBy("set_id", "n_set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # the sketch is the same for all copies, so it comes with the first one
    sketched = written(counts.join(live.select(F.col("doc_id").alias("rep"), "set_id", "sketch"), ["rep", "set_id"]).dropDuplicates(["rep", "set_id"]), "classes")
    classes = sketched.select("set_id", "n_set", "rep", "copies", "sketch")
    scratch = Scratch()
    links = written(candidates(classes, leaves(classes, scratch=scratch), scratch=scratch), "links")
    scratch.discard()
    groups = components(links)
    sums = written(verified(source, classes, groups, threshold, scratch), "verified")
    scratch.discard()
    discard(links, groups)
    label = components(sums.select(F.col("set_id").alias("a"), F.col("other").alias("b")))
    linked = sums.groupBy("set_id").agg(F.sum("links").alias("links"))
    named = classes.join(label, F.col("set_id") == F.col("node")).select("set_id", "rep", "label")
    least = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    known = named.join(least, "label").join(linked, "set_id").select("set_id", "class_id", "links")
    table = written(counts.join(known, "set_id", "left").select("set_id", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    discard(counts, sketched, sums, label)
    joined = live.select("doc_id", "set_id").join(table, "set_id").select("doc_id", "class_id", "n_links")
    alone = each.filter("n_set = 0 OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return joined.unionByName(alone)
