"""Toxicity by a weighted finite-state pattern grammar.

Words are read into classes (slur, harm, intent, target, negation, report, other).
Five weighted transducers, for insults, threats, targets, negation and reported
speech, are composed into one machine that reads a clause.  Its arcs carry the
labels of the transducers that acted; an event's weight is the sum of its labels'
weights, as composition adds them, so what an insult or a threat counts depends on
the clause it stands in.  A document's score is the logistic of its weighted events.

The slurs (words, and beginnings that many of them share) and the weights of the
labels are learned from labelled documents; a few fixed words and weights stand in
where there are no labels.  Classes of words are found by hashes of whole words and
of their beginnings, which accepts what a letter tree of the lexicon accepts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import _POWERS, _table, bytes_of, glued, mix, word_bounds

#: Bound of the training sample: so many documents of either label, in order of a hash of the id.
TRAIN_PER_LABEL = 4000
#: Patterns in the lexicon, at most, and labelled documents that one must be seen in.
LEXICON, SUPPORT = 1000, 3
#: How often every toxic training document should be covered before further patterns stop paying.
COVER = 2
#: Score from which a document counts as toxic (fixed by the contract).
DECIDE = 0.7

# Words of the grammar in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown dumbass trottel abschaum dummkopf widerlich imbécile crétin ordure minable imbécil estúpido escoria basura"
INTENTS = "will ll gonna going shall must should want werde werden wird soll vais va allons doit voy vas vamos va debe"
THREATS = "kill hurt destroy beat murder töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir"
TARGETS = "you your yourself he she they him her them du dich dir euch ihr sie tu te toi vous il elle ils usted ustedes tú ti él ella ellos"
NEGATIONS = "not no never none nicht kein keine nie niemals pas jamais aucun nunca jamás ni"
REPORTS = "said says called calls wrote quoted quote claims alleged sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió"

_WORDS = ("other", "slur", "harm", "intent", "target", "negation", "report")
OTHER, SLUR, HARM, INTENT, TARGET, NEGATION, REPORT = range(len(_WORDS))
_LETTERS = _table((), True, [*range(65, 91), *range(97, 123), *range(128, 256)])
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[10, 13, 33, 46, 59, 63]] = True


# ---------------------------------------------------------------------- transducers


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: ``step[state][symbol] = (next state, output, labels)``; state 0 starts.

    The labels of an arc stand for their weights; weights add up along composed arcs.
    """

    step: tuple[dict[str, tuple[int, str, tuple[str, ...]]], ...]

    def read(self, symbols: Sequence[str]) -> list[tuple[str, tuple[str, ...]]]:
        """Output and labels of each symbol."""
        state, out = 0, []
        for s in symbols:
            state, *made = self.step[state][s]
            out.append(tuple(made))
        return out

    def then(self, other: Transducer) -> Transducer:
        """Composition: the outputs of this one are the inputs of ``other``."""
        number, queue, made = {(0, 0): 0}, [(0, 0)], []
        for a, b in queue:
            row = {}
            for symbol, (na, out, labels) in self.step[a].items():
                nb, out2, labels2 = other.step[b][out]
                if (na, nb) not in number:
                    number[na, nb] = len(queue)
                    queue.append((na, nb))
                row[symbol] = (number[na, nb], out2, labels + labels2)
            made.append(row)
        return Transducer(tuple(made))


def _outputs(t: Transducer) -> tuple[str, ...]:
    return tuple(sorted({out for row in t.step for _, out, _ in row.values()}))


def _is_event(symbol: str) -> bool:
    return symbol.split("+")[0] in ("insult", "threat", "harm")


def insults() -> Transducer:
    """A slur is an insult; one that follows another within three words repeats it."""
    step = []
    for state in range(4):
        row = {s: (max(0, state - 1), s, ()) for s in _WORDS}
        row["slur"] = (3, "insult", ("insult", "repeat") if state else ("insult",))
        step.append(row)
    return Transducer(tuple(step))


def threats(alphabet: tuple[str, ...]) -> Transducer:
    """A verb of harm is a threat within four words after an intent, else harm that is only spoken of."""
    step = []
    for state in range(5):
        row = {s: (max(0, state - 1), s, ()) for s in alphabet}
        row["intent"] = (4, "other", ())
        row["harm"] = (max(0, state - 1), "threat", ("threat",)) if state else (0, "harm", ("harm",))
        step.append(row)
    return Transducer(tuple(step))


def targets(alphabet: tuple[str, ...], before: int = 4, after: int = 3) -> Transducer:
    """Events are aimed by a target that stands before or after them; one after them gives an output of its own."""
    states = [(b, a) for b in range(before + 1) for a in range(after + 1)]
    number = {s: k for k, s in enumerate(states)}
    step = []
    for b, a in states:
        row = {}
        for s in alphabet:
            down = (max(0, b - 1), max(0, a - 1))
            if s == "target":
                row[s] = (number[before, 0], *(("aim", ("aimed",)) if a else ("other", ())))
            elif _is_event(s):
                row[s] = (number[down], s + "+aimed", ("aimed",)) if b else (number[0, after], s, ())
            else:
                row[s] = (number[down], s, ())
        step.append(row)
    order = [states.index((0, 0)), *(k for k, s in enumerate(states) if s != (0, 0))]
    place = {k: n for n, k in enumerate(order)}
    return Transducer(tuple({s: (place[n], out, labels) for s, (n, out, labels) in step[k].items()} for k in order))


def marked(trigger: str, label: str, width: int, alphabet: tuple[str, ...]) -> Transducer:
    """Labels the events that follow ``trigger`` within ``width`` words, or to the end of the clause for 0."""
    top = max(1, width)
    step = []
    for state in range(top + 1):
        left = state if not width else max(0, state - 1)
        row = {s: (left, f"{s}+{label}", (label,)) if state and _is_event(s) else (left, s, ()) for s in alphabet}
        row[trigger] = (top, "other", ())
        step.append(row)
    return Transducer(tuple(step))


def transducers() -> list[Transducer]:
    """The five transducers in the order of their composition."""
    out = [insults()]
    for make in (threats, targets, lambda x: marked("negation", "negated", 3, x), lambda x: marked("report", "reported", 0, x)):
        out.append(make(_outputs(out[-1])))
    return out


def grammar() -> Transducer:
    first, *rest = transducers()
    return reduce(Transducer.then, rest, first)


GRAMMAR = grammar()
#: What the transducers can say of an event, and what it weighs before anything is learned; the sign of a weight stays.
LABELS = {"insult": 2.5, "repeat": 0.5, "threat": 3.6, "harm": 0.3, "aimed": 1.2, "negated": -3.0, "reported": -2.0}
_PRIOR, _BIAS = np.array(list(LABELS.values())), -2.2
#: Events by their labels, in a fixed order, and how often each label stands in each.
EVENTS = sorted({labels for row in GRAMMAR.step for _, _, labels in row.values() if labels})
_EVENT = {e: k for k, e in enumerate(EVENTS)}
_IN_EVENT = np.array([[e.count(x) for x in LABELS] for e in EVENTS], dtype=np.float64)


def clause_events(symbols: list[int]) -> list[tuple[str, ...]]:
    """The labels of a clause's events."""
    return [labels for _, labels in GRAMMAR.read([_WORDS[s] for s in symbols]) if labels]


# -------------------------------------------------------------------------- scoring


def _word_hash(words: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    starts, ends = np.cumsum([0, *(len(w) + 1 for w in words[:-1])]), None
    ends = starts + np.array([len(w) for w in words])
    return _range_hash(buf, starts, ends)


def _sums(buf: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.upto(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.multiply(_LETTERS[buf], up[: len(buf)], out=sums[1:], dtype=np.uint64, casting="unsafe")
        np.add.accumulate(sums, out=sums)
    return sums


def _range_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    sums = _sums(buf) if sums is None else sums
    _, down = _POWERS.upto(len(buf) + 1)
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Lexicon:
    """Classes of words by hash: whole words, and slurs by their first bytes."""

    def __init__(self, insults: list[bytes], beginnings: list[bytes]) -> None:
        table: dict[bytes, int] = {}
        for words, symbol in ((INTENTS, INTENT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, HARM)):
            table |= {w.encode(): symbol for w in words.split()}
        table |= dict.fromkeys(insults, SLUR)
        words = list(table)
        h = _word_hash(words)
        order = np.argsort(h)
        self.hashes, self.symbols = h[order], np.array([table[w] for w in words], dtype=np.int8)[order]
        self.beginnings = {n: np.sort(_word_hash([b for b in beginnings if len(b) == n])) for n in sorted({len(b) for b in beginnings})}

    def read(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and symbol of every word of a buffer."""
        starts, ends = word_bounds(buf, _LETTERS)
        if not len(starts):
            return starts, np.empty(0, dtype=np.int8)
        sums = _sums(buf)
        h = _range_hash(buf, starts, ends, sums)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        symbols = np.where(self.hashes[at] == h, self.symbols[at], OTHER).astype(np.int8)
        for n, known in self.beginnings.items():
            long = np.flatnonzero((ends - starts >= n) & (symbols == OTHER))
            h = _range_hash(buf, starts[long], starts[long] + n, sums)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            symbols[long[known[at] == h]] = SLUR
        return starts, symbols


def events_of(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """Event counts, a row per text."""
    out = np.zeros((len(texts), len(EVENTS)), dtype=np.int64)
    for first, _, buf, begin in glued(texts):
        starts, symbols = lexicon.read(buf)
        hits = np.flatnonzero((symbols == SLUR) | (symbols == HARM))
        if not len(hits):
            continue
        ends = np.flatnonzero(_ENDS[buf])
        clause = np.searchsorted(ends, starts[hits])
        for c in np.unique(clause).tolist():
            lo = ends[c - 1] if c else 0
            hi = ends[c] if c < len(ends) else len(buf)
            a, b = np.searchsorted(starts, (lo, hi))
            doc = first + int(np.searchsorted(begin, starts[a], side="right")) - 1
            for e in clause_events(symbols[a:b].tolist()):
                out[doc, _EVENT[e]] += 1
    return out


@dataclass
class Model:
    """The words, a weight per label of the grammar, and the bias; an event weighs what its labels do together."""

    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, events: np.ndarray) -> np.ndarray:
        z = self.bias + np.log1p(events.astype(np.float64)) @ (_IN_EVENT @ self.weights)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


# ------------------------------------------------------------------------- learning


def _patterns() -> F.Column:
    """A document's distinct words (``w`` before them) and beginnings of four to seven letters (``b``)."""
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.regexp_extract_all(folded, F.lit(r"([a-z\x{80}-\x{10FFFF}]+)"), F.lit(1)))

    def begins(n: int) -> F.Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.lit("b"), F.substring(w, 1, n)))

    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("w"), w)), *(begins(n) for n in range(4, 8))))


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> tuple[list[bytes], list[bytes]]:
    """Insult words and beginnings from the training sample ``(doc_id, text, toxic)``.

    A pattern must occur in toxic documents (nearly) only; of those the ``size``
    most frequent come to the driver.  There, patterns are taken greedily while
    they still cover toxic documents that are covered less than ``COVER`` times,
    which passes over words that merely ride along in copies.
    """
    each = sample.select("doc_id", "toxic", F.explode(_patterns()).alias("p"))
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = total.get(0, 0) / max(1, total.get(1, 0))
    counts = each.groupBy("p").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    good = counts.filter((F.col("pos") >= SUPPORT) & (F.col("neg") <= 0.02 * rate * F.col("pos"))).orderBy(F.desc("pos"), F.desc("p")).limit(size)
    good = [r["p"] for r in good.collect()]
    if not good:
        return [], []
    held = F.broadcast(sample.sparkSession.createDataFrame([(k, p) for k, p in enumerate(good)], "k int, p string"))
    index = {r["k"]: r["docs"] for r in each.filter("toxic = 1").join(held, "p").groupBy("k").agg(F.collect_list("doc_id").alias("docs")).collect()}
    covered: Counter = Counter()
    taken: dict[str, str] = {}
    sizes: dict[str, int] = {}
    words, begins = [], []
    for k, p in enumerate(good):
        docs, text = index.get(k, []), p[1:]
        # a beginning of a taken word, or a word with a taken beginning, is no further evidence
        if any(text.startswith(q) for q in taken if taken[q] == "b") or p[0] == "b" and any(q.startswith(text) and sizes[q] == len(docs) for q in taken):
            continue
        if sum(covered[d] < COVER for d in docs) >= max(SUPPORT, len(docs) // 20):
            covered.update(docs)
            taken[text], sizes[text] = p[0], len(docs)
            (words if p[0] == "w" else begins).append(p[1:].encode("utf-8", "surrogatepass"))
    return words, begins


def fit(events: np.ndarray, toxic: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Weights of the labels and bias by Newton steps on the penalised likelihood; the penalty pulls towards the prior.

    A label whose weight would change its sign weighs nothing, and the others are fitted again.
    """
    x = np.hstack([np.log1p(events) @ _IN_EVENT, np.ones((len(events), 1))])
    prior, ridge = np.append(_PRIOR, _BIAS), 1.0
    sample = toxic.mean() if len(toxic) else 0.5
    weight = np.where(toxic == 1, share / max(sample, 1e-9), (1 - share) / max(1 - sample, 1e-9)) if 0 < sample < 1 else np.ones(len(toxic))
    free = np.ones(len(prior), dtype=bool)
    while True:
        beta = np.where(free, prior, 0.0)
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = (x.T @ (weight * (toxic - p)) - ridge * (beta - prior))[free]
            hess = (x[:, free] * (weight * p * (1 - p))[:, None]).T @ x[:, free] + ridge * np.eye(int(free.sum()))
            step = np.clip(np.linalg.solve(hess, grad), -2, 2)
            beta[free] += step
            if np.abs(step).max() < 1e-8:
                break
        wrong = free & (beta * prior < 0)
        wrong[-1] = False
        if not wrong.any():
            return beta[:-1], float(beta[-1])
        free &= ~wrong


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> Model:
    """Learns from at most ``per_label`` labelled documents of either kind, none of them held out.

    The sample of ids is bounded by that parameter and therefore broadcast.
    Labels other than 0 and 1 and ids with contradicting labels are left out; of
    several documents with one id the least text is learned from.
    """
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    clean = clean.filter(~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    share = clean.agg(F.avg("toxic").alias("s")).first()["s"]
    pick = None
    for t in (0, 1):
        part = clean.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        pick = part if pick is None else pick.unionByName(part)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(pick), "doc_id")
    text = text.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    insults, beginnings = learn_lexicon(text)
    lexicon = Lexicon([*(w.encode() for w in INSULTS.split()), *insults], beginnings)
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = events_of(bytes_of(b.column(1)), held.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(e), pa.list_(pa.int64()))], names=["toxic", "events"])

    seen = text.select("toxic", "text").mapInArrow(count, "toxic int, events array<long>").collect()
    if not seen:
        return Model(lexicon, _PRIOR, _BIAS)
    weights, bias = fit(np.array([r["events"] for r in seen], dtype=np.float64), np.array([r["toxic"] for r in seen]), share)
    return Model(lexicon, weights, bias)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, held_out, score, predicted, n_events``.

    Null and empty texts get the score of a text without events; a null id is
    not held out; repeated rows get a row each; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            events = events_of(bytes_of(b.column(2)), held.value.lexicon)
            score = held.value.score(events)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score), pa.array((score >= DECIDE).astype(np.int32)), pa.array(events.sum(axis=1))],
                names=["doc_id", "held_out", "score", "predicted", "n_events"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_events long")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` does not predict as toxic, all columns as they are, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = held.value.score(events_of(bytes_of(b.column(text)), held.value.lexicon))
            yield b.filter(pa.array(score < DECIDE))

    return docs.mapInArrow(run, docs.schema)
