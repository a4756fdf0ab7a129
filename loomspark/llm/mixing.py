"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its
documents should have.  The fraction of it is rounded pairwise: two documents
with fractional copies meet, and words move from one to the other, in a random
direction that keeps both expectations, until one of them is integral.  The sum
of words is kept exactly by every meeting, so a source misses its target by less
than one document.

A source's documents are dealt to leaves of about ``LEAF`` documents; in each a
stream keeps one pending document.  Documents meet in order of falling size, so that what stays
pending is short.  It climbs a reduction tree of fan-in ``FAN``; the root decides
its last document by chance alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the sources in code-point order, repeating (fixed by the contract).
WEIGHTS = (5, 2, 1)
#: No target and no document exceeds this many times its size.
MOST = 3
#: Documents of one source in a leaf of the reduction tree, about, and the fan-in above the leaves.
LEAF, FAN = 4096, 16
SEED = 20240229

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Pouring the total by weight and resharing what exceeds a limit settles at one
    level L with target = min(limit, weight * L).  With the sources in order of
    limit / weight, those before some point stand at their limit; the level of
    each point follows from two running sums.  A total of zero gives targets of 0.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("limit", MOST * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "source", "source_size", "w", "limit",
        (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("open"),
    )
    # the level rises from point to point as long as sources are over their limit, then falls
    level = F.max(F.col("left") / F.col("open")).over(everything)
    return s.select("source", "source_size", F.least(F.col("limit"), F.col("w") * F.coalesce(level, F.lit(0.0))).alias("target"))


def _chance(*parts: object) -> float:
    """A number in [0, 1) that depends on nothing but its arguments."""
    digest = hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2.0**64


def meet(size_a: int, p_a: float, size_b: int, p_b: float, u: float) -> tuple[float, float]:
    """One meeting of two fractional documents: at least one comes out as 0 or 1; words and expectations are kept."""
    w_a, w_b = size_a * p_a, size_b * p_b
    to_a, to_b = min(size_a - w_a, w_b), min(w_a, size_b - w_b)
    if u * (to_a + to_b) < to_b:  # words move to a, with the probability that keeps expectations
        full, w_a, w_b = size_a - w_a <= w_b, w_a + to_a, w_b - to_a
        return (1.0, max(0.0, w_b / size_b)) if full else (min(1.0, w_a / size_a), 0.0)
    full, w_a, w_b = size_b - w_b <= w_a, w_a - to_b, w_b + to_b
    return (max(0.0, w_a / size_a), 1.0) if full else (0.0, min(1.0, w_b / size_b))


_FIELDS = "doc_id long, source string, size long, source_size long, target double, whole long, p double, node int, pending boolean"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int32(), pa.bool_()]
_EDGE = 1e-12


def _round(level: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (source, node); one document per such group may stay pending."""
        held: list | None = None
        for batch in batches:
            out = []
            for row in map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if held is not None and (held[1], held[7]) != (row[1], row[7]):
                    held[8] = True
                    out.append(held)
                    held = None
                if row[2] == 0 or row[6] <= _EDGE or row[6] >= 1 - _EDGE:
                    row[6], row[8] = float(round(row[6])) if row[2] else 0.0, False
                    out.append(row)
                    continue
                if held is None:
                    held = row
                    continue
                held[6], row[6] = meet(held[2], held[6], row[2], row[6], _chance(seed, level, held[0], held[2], row[0], row[2]))
                for x in (held, row):
                    if x[6] <= _EDGE or x[6] >= 1 - _EDGE:
                        x[6], x[8] = float(round(x[6])), False
                        out.append(x)
                both = [x for x in (held, row) if _EDGE < x[6] < 1 - _EDGE]
                held = both[0] if both else None
            yield _batch(out)
        if held is not None:
            held[8] = True
            yield _batch([held])

    return run


def _batch(rows: list[list]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def mix(docs: DataFrame, seed: int = SEED, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, ...)``: ``doc_id, source, size, source_size, target, copies, taken``.

    Null texts have size 0 and are never taken; a null source is a source of its
    own, last in order; repeated rows are rounded one by one; other columns are
    not read.  The result depends on the rows, the seed and the shape of the
    tree alone, not on how the rows are partitioned.
    """
    from .session import written

    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")), "sizes")
    sums = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / leaf).alias("leaves")), "sources")
    of = sums.select(F.col("source").alias("_s"), "leaves")
    per = targets(sums.select("source", "source_size")).join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    per = written(per.withColumnRenamed("source", "_source"), "targets")
    each = rows.join(per, F.col("source").eqNullSafe(F.col("_source")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(share + _EDGE), F.lit(MOST))
    node = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("leaves")).cast("int")
    pending = each.select(
        "doc_id", "source", "size", "source_size", "target", whole.cast("long").alias("whole"),
        F.greatest(share - whole, F.lit(0.0)).alias("p"), node.alias("node"), F.lit(True).alias("pending"),
    )
    done, level, width = None, 0, sums.agg(F.max("leaves").alias("n")).first()["n"] or 1
    while True:
        dealt = pending.repartition("source", "node").sortWithinPartitions("source", "node", F.desc("size"), F.xxhash64("doc_id", F.lit(seed + level)), "doc_id")
        out = written(dealt.mapInArrow(_round(level, seed), _FIELDS), "rounded")
        settled = out.filter("NOT pending")
        done = settled if done is None else done.unionByName(settled)
        pending = out.filter("pending")
        if width == 1:
            break
        width = -(-width // fan)
        pending = pending.withColumn("node", F.floor(F.col("node") / fan).cast("int"))
        level += 1
    u = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed), F.lit("root")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    last = pending.withColumn("p", F.when(u < F.col("p"), F.lit(1.0)).otherwise(F.lit(0.0)))
    copies = F.col("whole") + F.col("p").cast("long")
    return done.unionByName(last).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
