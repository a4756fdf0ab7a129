"""Operators on documents, held against brute force on small tables with the awkward cases."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.llm import decontaminate as dc
from loomspark.llm import linecrf, linededup, mixing, pii, toxicity
from loomspark.llm.chosen_path import near_duplicates
from loomspark.llm.components import components
from loomspark.llm.session import bucketed, discard, written

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ decontamination


def brute_hits(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        own = words(body)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            piece = own[k : k + window]
            for i in range(len(w) - len(piece) + 1):
                if w[i : i + len(piece)] == piece:
                    hit.update(range(i, i + len(piece)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), sha(",".join(sorted(found)))


def test_decontamination(spark, make):
    r = random.Random(1)
    items = [(k, prose(r, 14, 30)) for k in range(12)] + [(100, "Tiny phrase"), (101, ""), (102, None), (9, prose(r, 12, 30)), (None, "lonely words here")]
    docs = [(k, prose(r, 80, 30)) for k in range(30)]
    docs += [(40 + k, prose(r, 5, 30) + "! " + items[k][1].upper() + " -- " + prose(r, 5, 30) + ". " + items[k][1]) for k in range(12)]
    docs += [(60, None), (61, ""), (62, "a tiny-phrase, é"), (62, "a tiny-phrase, é"), (None, "LONELY words\nhere"), (63, items[0][1] * 400)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'q' AS doc_id", "1 AS hash")
    want = sorted(repr((d, *brute_hits(t, items))) for d, t in docs)
    for block in (10**9, 300):
        if block == 300:
            docs = list(dict.fromkeys(docs))
            docs = [d for d in docs if d[0] is not None]
            want = sorted(repr((d, *brute_hits(t, items))) for d, t in docs)
        out = dc.decontaminate(make(docs), bench, block_chars=block).collect()
        assert sorted(repr((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256)) for x in out) == want
        assert all(x.contaminated == (x.n_hit > 0) for x in out)
    texts = {d: t for d, t in docs}
    one = next(x for x in out if x.doc_id == 40)
    assert [texts[40][s.start : s.stop].lower() for s in one.removal_spans] == [items[0][1]] * 2
    clean = dc.without_contaminated(make(docs), bench)
    assert sorted(clean.columns) == sorted(make(docs).columns)
    assert {x.doc_id for x in clean.collect()} == {d for d, t in docs if not brute_hits(t, items)[1]}
    cut = {x.doc_id: x.text for x in dc.without_spans(make(docs[:45]), dc.decontaminate(make(docs[:45]), bench)).collect()}
    assert all(not brute_hits(cut[d], items[:12])[1] for d, _ in docs[42:45])


def test_decontamination_by_blocks_keeps_rows(spark, make):
    r = random.Random(15)
    items = [(k, prose(r, 14, 30)) for k in range(20)]
    docs = [(1, prose(r, 20, 30)), (1, items[3][1] + " x"), (1, items[3][1] + " x"), (None, "a " + items[5][1]), (None, None), (2, prose(r, 9, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = [sorted(map(repr, dc.decontaminate(make(docs), bench, block_chars=n).collect())) for n in (10**9, 300)]
    assert out[0] == out[1] and len(out[0]) == len(docs)


def test_decontamination_of_nothing(spark, make):
    bench = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    assert dc.decontaminate(make([]), bench).collect() == []
    assert [x.n_hit for x in dc.decontaminate(make([(1, "x y")]), bench.limit(0)).collect()] == [0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=20), min_size=1, max_size=6), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index_counts_and_locates(runs, pattern):
    seq = np.array([x for run in runs for x in [*run, 0]], dtype=np.int64)
    index = dc.FMIndex(seq)
    if max(pattern) > seq.max():
        return
    low, high = index.search(np.array([pattern]), np.array([len(pattern)]))
    at = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert at == [i for i in range(len(seq)) if seq[i : i + len(pattern)].tolist() == pattern]


# -------------------------------------------------------------------- near duplicates


def brute_links(docs):
    sets = {}
    for k, (d, t) in enumerate(docs):
        w = words(t)
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up, links = list(range(len(docs))), Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            if docs[a][0] is None or docs[b][0] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                up[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(list)
    for k in sets:
        groups[root(k)].append(docs[k][0])
    return sorted(repr((docs[k][0], None if docs[k][0] is None else min(groups[root(k)]), links[k])) for k in sets)


def test_near_duplicates(spark, make):
    r = random.Random(2)
    docs = []
    for k in range(25):
        base = prose(r, 120).split()
        for c in range(r.randrange(1, 5)):
            edited = list(base)
            for _ in range(r.randrange(0, 5)):
                edited[r.randrange(len(edited))] = f"e{r.randrange(999)}"
            docs.append((len(docs) * 3 + 1, " ".join(edited)))
    passage = prose(r, 60)
    docs += [(1000 + k, prose(r, 30) + " " + passage + " " + prose(r, 30)) for k in range(90)]
    base = prose(r, 100).split()
    docs += [(2000 + k, " ".join([*base[:k % 90], f"v{k}", *base[k % 90 + 1 :]])) for k in range(300)]
    docs += [(5000, None), (5001, ""), (5002, "one two"), (5003, "One, two!"), (5004, "one two three"), (None, "one two"), (7, docs[2][1]), (1, docs[0][1]), (1, docs[0][1]), (6000, prose(r, 30000))]
    got = sorted(repr((x.doc_id, x.class_id, x.n_links)) for x in near_duplicates(make(docs)).collect())
    assert got == brute_links(docs)
    assert near_duplicates(make([])).collect() == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 7)]
    out = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(61)}, 200: 0, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# -------------------------------------------------------------------------- line dedup


def brute_lines(docs):
    seen = {}
    for d, t in sorted(docs):
        for p, line in enumerate(t.split("\n")):
            norm = " ".join(line.lower().split())
            if len(norm) >= linededup.MIN_CHARS:
                seen.setdefault(norm, []).append((d, p))
    return seen


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(spark, make):
    r = random.Random(3)
    shared = [prose(r, n, 5000) for n in (6, 40, 60, 60, 3)]
    docs = []
    for k in range(24):
        own = [prose(r, r.randrange(3, 30), 5000) for _ in range(4)]
        line = shared[k % 5].split()
        if k % 3 == 0 and len(line) > 20:
            line[7] = "changed"
        docs.append((k, "\n".join([own[0], " ".join(line).upper() + "!", "", own[1], "ok", own[2]])))
    docs += [(50, ""), (51, "Call 555 or 1 now\nCALL 777 OR 2, NOW\ncall 555  OR 1 now")]
    table = make([*docs, (60, None), (23, docs[23][1])])
    out = {x.doc_id: x for x in linededup.dedup_lines(table).collect()}
    assert out[60].text is None and out[60].n_lines == 0 and out[50].text == ""
    assert out[51].text == "Call 555 or 1 now\nCALL 777 OR 2, NOW" and out[51].n_removed == 1
    # brute force: equal keys, and keys whose edit distance is small, are one group
    seen = brute_lines(docs)
    keys, up = list(seen), {k: k for k in seen}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(set(a.split()) & set(b.split())) > 0.4 * len(a.split()) and lev(a, b) <= 0.2 * max(len(a), len(b)):
                up[root(a)] = root(b)
    first = {}
    for k, places in seen.items():
        first[root(k)] = min(min(places), first.get(root(k), (10**9, 0)))
    keep = set(first.values())
    drop = {p for k, places in seen.items() for p in places if p not in keep}
    for d, t in docs:
        assert out[d].text == "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in drop), d
    assert sum(out[d].n_removed for d, _ in docs) == len(drop) > 15
    assert [c for c in linededup.dedup_lines(table).columns][: len(table.columns)] == table.columns
    assert linededup.dedup_lines(make([])).collect() == []


def sims_of(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    lines = linededup.distinct_lines(rows)
    got = lines.join(linededup.simhashes(lines), linededup.ID).collect()
    return [x.sim & (1 << 64) - 1 for x in sorted(got, key=lambda x: x.first.doc.doc_id)]


def test_simhash_is_a_majority(spark, make):
    text = " ".join(f"t{k}" for k in range(9)) + " t1 t2"
    h = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(w,) for w in text.split()], "w string").select(F.xxhash64("w")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    assert sims_of(spark, [text]) == [want]
    long = make([(1, "same " * 40000), (2, "same " * 40000), (3, " ".join(f"x{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(20000)))])
    assert [x.n_removed for x in linededup.dedup_lines(long).orderBy("doc_id").collect()] == [0, 1, 0]


def test_no_step_by_length(spark):
    r = random.Random(13)
    line = lettered(r, 16_385)
    sims = sims_of(spark, [" ".join(line[:-1]), " ".join(line)])
    assert bin(sims[0] ^ sims[1]).count("1") <= 3


def test_lines_that_differ_in_numbers_stay(spark, make):
    r = random.Random(15)
    text = "\n".join(f"{r.randrange(10**6)} | {r.randrange(10**6)} | {r.randrange(10**6)}" for _ in range(60))
    assert [x.n_removed for x in linededup.dedup_lines(make([(1, text), (2, "other")])).collect()] == [0, 0]


def test_groups_of_many_near_copies_meet(spark, make):
    r = random.Random(16)
    line = lettered(r, 30)
    texts = [" ".join(lettered(r, 30)) for _ in range(40)]
    for _ in range(300):
        edited = list(line)
        for k in r.sample(range(30), 2):
            edited[k] = lettered(r, 1)[0]
        texts.append(" ".join(edited))
    out = linededup.dedup_lines(make(list(enumerate(texts)))).collect()
    assert {x.doc_id for x in out if not x.n_removed} == set(range(41))


def test_lines_of_few_words(spark, make):
    r = random.Random(14)
    chars = [chr(0x4E00 + r.randrange(5000)) for _ in range(60)]
    line, edited = "".join(chars), "".join(chars[:20] + ["\u9fa5"] + chars[21:])
    docs = [(1, line), (2, line), (3, edited), (4, "Copyright notice"), (5, "copyright  notice!"), (6, "of"), (7, "of")]
    out = linededup.dedup_lines(make(docs)).collect()
    assert {x.doc_id for x in out if x.n_removed} == {2, 3, 5}


def lettered(r, n):
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(n)]


def test_similar_lines_by_edit_distance_alone(spark, make):
    r = random.Random(12)
    texts = []
    for n in (10, 20, 30, 50) * 6:
        line = lettered(r, n)
        texts.append(" ".join(line))
        for changes in (1, n // 8):
            edited = list(line)
            for k in r.sample(range(n), changes):
                edited[k] = lettered(r, 1)[0]
            texts.append(" ".join(edited))
    up = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and i // 3 == j // 3 and lev(a, b) <= 0.2 * max(len(a), len(b)):
                up[i] = min(up[i], up[j])
    out = {x.doc_id: x.n_removed for x in linededup.dedup_lines(make(list(enumerate(texts)))).collect()}
    want = {k: int(up[k] != k) for k in out}
    assert out == want and sum(want.values()) > 40


def groups_of(texts, similar):
    """The first line of each line's group."""
    up = list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) - 1e-9 and similar(a, b):
                one, two = sorted((root(i), root(j)))
                up[two] = one
    return [root(k) for k in range(len(texts))]


def within(a, b):
    return lev(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)


def test_short_lines_meet_without_fail(spark, make):
    r = random.Random(21)
    texts = []
    for n in range(5, 33):
        for _ in range(3):
            line = "".join(r.choice("abcdefgh ") for _ in range(n)).strip().replace("  ", "xy").ljust(n, "q")
            texts.append(line)
            for _ in range(2):
                edited = list(line)
                for _ in range(r.randrange(1, n // 5 + 1)):
                    k = r.randrange(len(edited))
                    edited[k : k + r.randrange(2)] = r.choice(["z", "", "k"])
                texts.append("".join(edited).strip().replace("  ", " "))
    texts = [t for t in dict.fromkeys(texts) if 5 <= len(t) <= linededup.EXACT]
    want = groups_of(texts, within)
    out = {x.doc_id: x.n_removed for x in linededup.dedup_lines(make(list(enumerate(texts)))).collect()}
    assert out == {k: int(want[k] != k) for k in out} and sum(out.values()) > 80


def test_all_pairs_of_a_bucket(spark):
    """Lines that differ from their bucket's representative meet each other, whatever their SimHashes."""
    texts = ["".join(chr(97 + g) * 60 for g in (k, k + 1, k + 2)) + "x" * (j + 1) for k in range(0, 12, 3) for j in range(3)]
    lines = linededup.distinct_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    lines = linededup.written(lines, "lines")
    rows = lines.select(F.lit(1).cast("long").alias("key"), *linededup.ID, F.when(F.col("first.doc.doc_id") % 2 == 0, -1).otherwise(0).cast("long").alias("sim"), F.lit(20).alias("words"), "size")
    lead = rows.agg(F.min(F.struct(*linededup.ID, "sim", "words", "size")).alias("lead"))
    shared = linededup.written(rows.crossJoin(lead), "shared")
    likely = linededup.links(lines, linededup.met([shared]))
    label = linededup.components(likely)
    others = linededup.links(lines, linededup.rest(lines, [shared], label))
    name = {(x.h, x.g): x.first.doc.doc_id for x in lines.collect()}
    edges = [(name[tuple(x.a)], name[tuple(x.b)]) for x in likely.unionByName(others).collect()]
    up = list(range(len(texts)))
    for _ in texts:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert up == groups_of(texts, within)


def test_every_word_edited(spark):
    r = random.Random(22)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(8)) for _ in range(20)]
    edited = [w[:3] + "z" + w[4:] for w in words]
    other = ["".join(r.choice("abcdefghijklm") for _ in range(8)) for _ in range(20)]
    rows = spark.createDataFrame([(" ".join(words), " ".join(edited), " ".join(other))], "a string, b string, c string")
    assert tuple(rows.select(linededup.similar(F.col("a"), F.col("b")), linededup.similar(F.col("a"), F.col("c"))).first()) == (True, False)


# ------------------------------------------------------------------------------ mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, target, open_ = float(sum(sizes.values())), {}, set(order)
    while True:
        left = total - sum(target.values())
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 3 * sizes[s]}
        if not over:
            return {**target, **{s: level * w[s] for s in open_}}
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over


def test_mixing(spark, make):
    r = random.Random(4)
    docs = [(k, prose(r, r.randrange(0, 60)), r.choice(["a", "B", "é", "zz", None])) for k in range(600)]
    docs += [(1000, None, "a"), (1001, " \t\x0b ", "empty"), (1002, "x", "tiny"), (1002, "x", "tiny"), (None, "p q", "a")]
    out = mixing.mix(make(docs), leaf=16, fan=4).collect()
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(re.findall(mixing.WORD, t or ""))
    want, taken, longest = brute_targets(sizes), Counter(), Counter()
    for x in out:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] and 0 <= x.taken <= 3 * x.size and x.taken == x.copies * x.size
        taken[x.source] += x.taken
        longest[x.source] = max(longest[x.source], x.size)
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in want) and len(out) == len(docs)
    again = mixing.mix(make(docs).repartition(5), leaf=16, fan=4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert mixing.mix(make([])).collect() == []


@given(st.integers(1, 50), st.floats(0.01, 0.99), st.integers(1, 50), st.floats(0.01, 0.99), st.floats(0, 0.999))
def test_a_meeting_keeps_words(a, p, b, q, u):
    x, y = mixing.meet(a, p, b, q, u)
    assert abs(a * x + b * y - a * p - b * q) < 1e-9 * (a + b) and (x in (0, 1) or y in (0, 1)) and 0 <= x <= 1 and 0 <= y <= 1


# ---------------------------------------------------------------------- personal data


@settings(max_examples=300, deadline=None)
@given(st.text("a1@.+- 9(2)%:é", max_size=60))
def test_base_spans(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    assert pii.base_spans(text) == sorted(out, key=lambda s: (s[0], s[2], s[1]))


def test_pii_rows(spark, make):
    long = "1" * 200_000 + " a@b.co"
    docs = [(1, "x a.b@c.de 10.0.0.1, 4111 1111 1111 1111 +49 (30) 123-456"), (2, None), (3, ""), (3, ""), (4, "mail: jane [at] site [dot] org, phone: (212) 555-0199"), (5, long), (None, "é 1.2.3.4")]
    got = {(x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.spans) for x in pii.find_pii(make(docs)).collect()}
    assert (1, 1, 1, 1, 1, "email:2:10,ip:11:19,card:21:40,phone:41:57") in got and (2, 0, 0, 0, 0, "") in got and (None, 0, 1, 0, 0, "ip:2:9") in got
    assert (4, 0, 0, 0, 0, "email:6:30,phone:39:53") in got and len(got) == 6 and (5, 1, 0, 0, 0, "email:200001:200007") in got
    assert pii.find_pii(make([])).collect() == []
    assert pii.redact(docs[0][1], pii.base_spans(docs[0][1])) == "x [EMAIL] [IP], [CARD] [PHONE]"


def test_pii_in_rows_of_numbers():
    def added(text):
        (base, more), = pii.find([text], pii.judge())
        return [] if base else [(text[s:e], pii.KINDS[k]) for s, e, k in sorted(more)]

    card = "4465758382889437"
    assert added(f"nta ramiar, {card} {card} ojaga") == [(card, "card")] * 2
    assert added("write to john(at)example.com today") == [("john(at)example.com", "email")]
    got = {(text[s:e], k) for text in ["call 030 1234567 / 030 7654321, " * 9] for s, e, k in pii.candidates(text)}
    assert {("030 1234567", 3), ("030 7654321", 3)} <= got
    assert added("call 030 1234567 / 030 7654321 please") == [("030 1234567", "phone"), ("030 7654321", "phone")]



def test_the_judge_is_exact_on_new_examples():
    r = random.Random(99)
    made = [pii._sentence(r) for _ in range(800)]
    by = pii.judge()
    p = by.scale(by.trees.logits(np.array([pii.features(t, s) for t, s, _ in made])))
    taken = [(g, s) for (t, s, g), v in zip(made, p) if v >= by.limits[s[2]]]
    assert sum(g for g, _ in taken) >= 0.97 * len(taken) and len(taken) >= 0.6 * sum(g for _, _, g in made)


# ------------------------------------------------------------------------------ quality


def test_quality_rules(spark, make):
    r = random.Random(5)
    good = "\n".join(prose(r, 14, 3000).capitalize() + "." for _ in range(12))
    junk = "\n".join(" | ".join(f"c{r.randrange(9999)}" for _ in range(9)) for _ in range(12))
    docs = [(1, good), (2, junk), (3, "short text"), (4, None), (5, ""), (6, "a b c " * 40), (7, "x\x00y \x00 # $ 　 é" * 20), (8, good + "\n" + good), (8, good), (None, good)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    crf = linecrf.train(make(docs[:2]), labels)
    out = linecrf.quality(make(docs), crf).collect()
    want = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        three = Counter(zip(w, w[1:], w[2:]))
        hit = {i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append(repr((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))))
    assert sorted(repr((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed)) for x in out) == sorted(want)
    assert [x.kept for x in out if x.doc_id in (1, None)] == [True, True] and not any(x.kept for x in out if x.doc_id in (2, 3, 4, 5, 6))
    assert linecrf.quality(make([]), crf).collect() == []


def test_viterbi_is_the_best_labelling():
    crf, r = linecrf.LineCRF(), np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        x = r.random((n, len(linecrf.FEATURES)))
        score = x @ crf.emit
        best = max(range(1 << n), key=lambda m: (sum(score[k, m >> k & 1] for k in range(n)) + sum(crf.move[m >> k & 1, m >> k + 1 & 1] for k in range(n - 1))))
        assert crf.viterbi(x).tolist() == [best >> k & 1 for k in range(n)]


# ----------------------------------------------------------------------------- toxicity


def test_clauses():
    s = lambda text: [toxicity._WORDS.index(w) for w in text.split()]
    assert toxicity.clause_events(s("target other slur")) == [("insult", "aimed")]
    assert toxicity.clause_events(s("slur other target")) == [("insult",), ("aimed",)]
    assert toxicity.clause_events(s("negation other slur")) == [("insult", "negated")]
    assert toxicity.clause_events(s("report target slur")) == [("insult", "aimed", "reported")]
    assert toxicity.clause_events(s("negation other other other slur harm")) == [("insult",), ("harm",)]
    assert toxicity.clause_events(s("target intent negation harm target")) == [("threat", "aimed", "negated")]
    assert toxicity.clause_events(s("slur slur")) == [("insult",), ("insult", "repeat")]


@given(st.lists(st.sampled_from(toxicity._WORDS), max_size=14))
def test_composition_is_one_transducer_after_the_other(words):
    outputs, labels = list(words), [()] * len(words)
    for t in toxicity.transducers():
        made = t.read(outputs)
        outputs, labels = [m[0] for m in made], [had + m[1] for had, m in zip(labels, made, strict=True)]
    assert toxicity.GRAMMAR.read(words) == list(zip(outputs, labels, strict=True))


def test_what_a_clause_means_counts():
    model = toxicity.Model(toxicity.Lexicon([w.encode() for w in toxicity.INSULTS.split()], []), toxicity._PRIOR, toxicity._BIAS)
    score = lambda t: float(model.score(toxicity.events_of([t.encode()], model.lexicon))[0])
    assert score("I will kill you") >= toxicity.DECIDE and score("we will kill you all and hurt your family") >= toxicity.DECIDE
    assert score("I will not kill you") < 0.5 > score("they said he will kill you") and score("a plan to kill weeds") < 0.2
    assert score("you idiot") > score("an idiot") > score("she said you are an idiot") > score("you are not an idiot")


def test_toxicity(spark, make):
    r = random.Random(6)
    bad = ["zorgling", "blatherish", "quuxhead"]
    docs, labels = [], []
    for k in range(300):
        w, toxic = prose(r, 60).split(), k % 3 == 0
        for _ in range(4 * toxic):
            w.insert(r.randrange(len(w)), r.choice(bad))
        docs.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    labels = spark.createDataFrame([*labels, (5, 0, 1), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    extra = [(900, None), (901, ""), (902, "word " * 90_000), (900, None), (None, "x")]
    model = toxicity.train(make(docs), labels)
    out = {x.doc_id: x for x in toxicity.toxicity(make(docs + extra), model).collect()}
    held = [k for k, _ in docs if out[k].held_out]
    assert held and all((out[k].predicted == 1) == (k % 3 == 0) for k in held)
    assert all(out[k].predicted == 0 and 0 <= out[k].score < 0.7 for k in (900, 901, 902, None)) and out[None].held_out is False
    kept = {x.doc_id for x in toxicity.without_toxic(make(docs), model).collect()}
    assert kept == {k for k, _ in docs if not out[k].predicted}
    plain = toxicity.train(make([]), labels.limit(0))
    assert toxicity.toxicity(make([]), plain).collect() == []
    assert [x.predicted for x in toxicity.toxicity(make([(1, "you idiot and moron. scum, you loser"), (2, "a calm day")]), plain).orderBy("doc_id").collect()] == [1, 0]


def test_line_crf_learns_from_whole_documents():
    text = "\n".join(["A plain line of words that says something."] * 300 + ["All rights reserved | menu"])
    x, y = linecrf._teach(text, 1, linecrf.LineCRF())
    assert len(x) == len(y) == 301 and y[-1] == linecrf.BOILERPLATE
    assert np.flatnonzero(x[:, linecrf.FEATURES.index("edge")]).tolist() == [0, 300]


def test_unlike_lines_of_frequent_words_make_no_pairs(spark):
    """Long lines share the frequent words of their language, and lines that quote one phrase share it; neither makes them meet."""
    r = random.Random(23)
    phrase = " ".join(lettered(r, 6))
    texts = [" ".join(r.choice(("the", "of", "and", "to", "in", "a", "is", "that")) if k % 2 else lettered(r, 1)[0] for k in range(120)) + " " + phrase for _ in range(150)]
    lines = linededup.written(linededup.distinct_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "lines")
    rows = linededup.buckets(lines)
    pairs = rows.alias("x").join(rows.alias("y"), "key").filter("x.h < y.h").select("x.h", "y.h").distinct().count()
    assert pairs < 75


def test_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(k).getName() for k in range(found.size())}

    before = files()
    table = bucketed(spark.range(2000).selectExpr("id % 500 AS h", "id").groupBy("h").agg(F.count("*").alias("n")), "test", "h")
    until = time.time() + 20
    while (left := {f for f in files() - before if f.startswith("shuffle_")}) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert table.count() == 500
    discard(table)


def test_pairs_are_compared_in_rounds(spark, monkeypatch):
    """However many pairs there are, the texts of a few lie on disk at a time, and all links are found."""
    texts = [f"{'abcdefgh'[k % 8] * 40}{k:03d}" for k in range(64)]
    lines = linededup.written(linededup.distinct_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "lines")
    ends = [lines.select(F.col("h").alias(f"{x}h"), F.col("g").alias(f"{x}g")) for x in "ab"]
    pairs = linededup.written(ends[0].crossJoin(ends[1]).filter("ah < bh"), "pairs")
    whole = {(tuple(x.a), tuple(x.b)) for x in linededup.links(lines, pairs).collect()}
    tables = []
    monkeypatch.setattr(linededup, "LEAST", 1)
    monkeypatch.setattr(linededup, "written", lambda df, name: tables.append(name) or written(df, name))
    found = [(tuple(x.a), tuple(x.b)) for x in linededup.links(lines, pairs, likely=False).collect()]
    assert len(found) == len(whole) == 8 * 28 and set(found) == whole
    assert tables.count("leads") == 16


def test_blocks_are_narrow(spark):
    lines = linededup.distinct_lines(spark.createDataFrame([(1, "some words of a line that is long enough for blocks of words")], "doc_id long, text string"))
    assert linededup.blocks(lines).columns == ["key", "h"]
