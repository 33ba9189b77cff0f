"""Operators on texts against brute force, with the awkward rows every operator must take."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa
from quillon.llm import _text, jaccard_join, mixing, packing, quality_rules, substring_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size long, text_key string, rank int"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, ties, nulls and a long one."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "Gamma", "delta,", "é", "the", "of", "x", "|", "#"] + [f"w{i}" for i in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, base = text(40), text(120).split(" ")
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = text(rng.randint(1, 80))
        elif kind == 1:
            t = text(10) + "\n" + passage + " " + text(rng.randint(0, 30))
        elif kind == 2:
            words = list(base)
            words[rng.randrange(len(words))] = f"new{i}"
            t = " ".join(words)
        elif kind == 3:
            t = "line one here\nline one here\n\nother  line\tend " + "again and again " * rng.randint(0, 9)
        elif kind == 4:
            t = " ".join(base)
        else:
            t = text(3)
        rows.append((i * 3 % 101, t, f"s{i % 3}"))
    rows += [(500, None, None), (501, "", "s1"), (502, " \n\t ", None), (None, " ".join(base), "s2"), (503, text(5000), "s0"), (12, "same id, other text " * 9, "s0")]
    rows += [rows[0], rows[2]]
    return [(*r, 7, "clash", 1) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85 aAbé日𝄞", max_size=30)), max_size=6))
def test_split_follows_the_word_rule(texts):
    w = _text.split(pa.array(texts, pa.string()))
    expected = [WORD.findall(t or "") for t in texts]
    assert w.counts.tolist() == [len(x) for x in expected]
    found = [w.buf[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
    assert found == [x for e in expected for x in e]
    by_word = {}
    for word, h in zip(found, w.hashes.tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def measured(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_ledger(docs):
    rows = quality_rules.digest(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = Counter()
    for r in docs.collect():
        m = measured(r.text)
        want[(r.doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_quality_policies_and_ablation(docs):
    book = quality_rules.ledger(docs).cache()
    n = book.count()
    for r in quality_rules.ablation(book, "web.v1").collect():
        without = [x for x in quality_rules.POLICIES["web.v1"] if x != r.rule]
        names = list(quality_rules.rules())
        mask = sum(1 << names.index(x) for x in without)
        bits = [x.fail_bits for x in book.collect()]
        assert r.n_documents == n
        assert r.n_kept_without == sum(b & mask == 0 for b in bits)
        assert r.n_rejected == sum(b >> names.index(r.rule) & 1 for b in bits)


def test_accepted_keeps_rows_and_columns(docs):
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality_rules.ledger(docs).where(quality_rules.verdict("web.v1")).count()


def removed(rows, k=13):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - k + 1) if i is not None else ():
            x = tuple(w[j : j + k])
            first[x] = min(first.get(x, i), i)
    out = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - k + 1) if i is not None else ():
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def test_substring_dedup(docs):
    got = Counter(map(tuple, substring_dedup.digest(docs).collect()))
    assert got == removed([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_spans_have_true_sources(docs):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(WORD.findall(r.text or ""))
    spans = substring_dedup.repeated_spans(docs).collect()
    assert spans
    for s in spans:
        n = s.end - s.start
        assert n >= substring_dedup.K and s.source_id < s.doc_id
        own = {tuple(w[s.start : s.end]) for w in texts[s.doc_id]}
        assert own & {tuple(w[s.source_start : s.source_start + n]) for w in texts[s.source_id]}


def branching(seed=3, n=24):
    """Texts of shared passages that run into each other at different places, and of one word repeated."""
    rng = random.Random(seed)
    parts = [[f"p{k}_{i}" for i in range(rng.randint(13, 60))] for k in range(6)]
    texts = [" ".join(w for k in (rng.randrange(6), rng.randrange(6), rng.randrange(6)) for w in parts[k][rng.randint(0, 9) :]) for _ in range(n)]
    return list(enumerate(texts)) + [(n, "again " * 40), (n + 1, "again " * 30)]


def test_nonbranching_paths(spark):
    """Nodes of 12 words, edges that two texts hold, and paths that end where a node has not one edge in and one out."""
    rows, k = branching(), substring_dedup.K
    held = {}
    words = {i: WORD.findall(t) for i, t in rows}
    for i, w in words.items():
        for j in range(len(w) - k + 1):
            held.setdefault(tuple(w[j : j + k]), set()).add(i)
    edges = {e for e, own in held.items() if len(own) > 1}
    into, out = Counter(e[1:] for e in edges), Counter(e[:-1] for e in edges)
    single = {v for v in into if into[v] == 1 and out[v] == 1}
    after = {e[:-1]: e for e in edges}
    loops = {e for e in edges if e[1:] == e[:-1]}
    want = set()
    for e in edges - loops:
        if e[:-1] not in single:
            path = [e]
            while path[-1][1:] in single:
                path.append(after[path[-1][1:]])
            want.add(tuple(path))
    got = {}
    for r in substring_dedup.paths(substring_dedup.found(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        for j in range(r.n):
            got.setdefault(r.path, {})[r.offset + j] = tuple(words[r.doc_id][r.start + j : r.start + j + k])
    assert all(sorted(p) == list(range(len(p))) for p in got.values())
    paths = {tuple(p[j] for j in range(len(p))) for p in got.values()}
    assert {p for p in paths if p[0] not in loops} == want and len(paths) == len(got) and max(map(len, want)) > 20
    assert {e for p in paths for e in p} == edges


def test_substring_dedup_of_branching_texts(spark):
    rows = branching(4) + [(100 + i, t) for i, t in branching(4)[:5]]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, substring_dedup.digest(table).collect())) == removed(rows)


def test_unverified_spans_are_not_removed():
    """A span whose words have another digest than those at its source stays."""
    words = [f"w{i}" for i in range(30)]
    w = _text.split(pa.array([" ".join(words)]))
    right = substring_dedup.word_digests(w, jaccard_join.np.array([2]), jaccard_join.np.array([3]))[:, 0].tolist()
    for d1, left in ((right[0], 15), (right[0] + 1, 30)):
        span = {"start": 2, "n": 3, "same": False, "d1": d1, "d2": right[1]}
        rows = pa.RecordBatch.from_pylist([{"doc_id": 7, "text": " ".join(words), "spans": [span]}])
        out = next(substring_dedup.strip(rows, w))
        assert out["n_words"][0] - out["n_removed"][0] == left


def test_tasks_remember_what_they_sent():
    sent, a = substring_dedup.Sent(), jaccard_join.np.array
    sent.add(a([4, 2], "uint64"), a([9, 8]), a([0, 0]), a([1, 2]))
    sent.add(a([4], "uint64"), a([3]), a([5]), a([6]))
    hit, (doc, _, pos) = sent.find(a([1, 2, 4], "uint64"))
    assert hit.tolist() == [False, True, True] and doc[1:].tolist() == [8, 3] and pos[1:].tolist() == [2, 6]


def test_deduplicated_text(docs):
    for r in substring_dedup.deduplicated(docs).collect():
        assert len(WORD.findall(r.text)) == r.n_words - r.n_removed


def joined(rows, k, percent):
    """Each row's id and set, and the first (id, row) of its component; rows that share an id are rows of their own."""
    sets = []
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if None not in (i, j) and x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    label = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            label[root(a)] = min(label.get(root(a), i), i)
    return [(i, len(x), None if i is None else label[root(a)]) for a, (i, x) in enumerate(sets)], root


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_join(docs, k, percent):
    want, _ = joined([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    got = jaccard_join.Join(docs, k, percent).membership().select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_jaccard_join_of_an_id_with_two_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(12, one), (12, two), (13, one + " z"), (14, two + " z"), (15, two.upper()), (9, "c d")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.digest(table).collect())) == Counter(joined(rows, 4, 85)[0])
    assert sorted((r.doc_id, r.text) for r in jaccard_join.representatives(table).collect()) == sorted([(9, "c d"), (12, one), (12, two)])
    alike = spark.createDataFrame([(12, one), (12, one + " z"), (12, one), (13, one)], "doc_id long, text string")
    assert [r.doc_id for r in jaccard_join.representatives(alike).collect()] == [12]


def chained(n=40, seed=5):
    """Near copies that link in chains, around one passage all of them share: large regions."""
    rng = random.Random(seed)
    words = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(n):
        if i % 40 == 0:
            words = words[:30] + [f"z{i}_{j}" for j in range(170)] if i < 120 else words[:190] + [f"z{i}_{j}" for j in range(10)]
        words = list(words)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = f"n{i}_{rng.random()}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed, block, small", [(5, 2048, 64), (6, 2048, 8), (5, 40, 8), (6, 24, 4)])
def test_jaccard_join_of_large_regions(spark, monkeypatch, seed, block, small):
    """Cells in one task, cells that Spark divides, and blocks of regions that don't shrink."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 6)
    rows = chained(170, seed)
    want, _ = joined(rows, 4, 85)
    got = jaccard_join.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def grouped(groups, each, words=200, shared=0, seed=8):
    """Groups of near copies, their texts alike in so many words at the end."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        text = [f"g{g}_{j}" for j in range(words - shared)] + [f"s{j}" for j in range(shared)]
        for i in range(each):
            copy = list(text)
            for j in rng.sample(range(words), rng.randint(1, 3)):
                copy[j] = f"n{g}_{i}_{j}"
            rows.append((1000 * g + i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("table, frequent", [(grouped(1, 150), 1 << 18), (grouped(5, 40, shared=120), 0)])
def test_regions_that_spark_divides(spark, monkeypatch, table, frequent):
    """Regions of more members than a task takes: one that goes in blocks, and some that pivots divide."""
    divided = []
    inner = jaccard_join.Join._divided
    monkeypatch.setattr(jaccard_join, "BLOCK", 70)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join.Join, "_divided", lambda self, big, depth: divided.append(depth) or inner(self, big, depth))
    want, _ = joined(table, 4, 85)
    got = jaccard_join.digest(spark.createDataFrame(table, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert divided


def test_representatives_of_a_region_that_spark_divides(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 70)
    table = grouped(1, 120) + [(5000, "alone"), (None, "alone"), (5001, None)]
    want, _ = joined(table, 5, 80)
    got = jaccard_join.representatives(spark.createDataFrame(table, "doc_id long, text string"))
    assert sorted((r.doc_id is not None, r.doc_id) for r in got.collect()) == sorted((i is not None, i) for i, _, first in want if i == first)


def test_representatives_by_lists_that_are_not_broadcast(spark, monkeypatch):
    """Lists of dropped and repeated rows that are too long to broadcast, as a large table has them."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    table = grouped(3, 10) + grouped(3, 10)[:7] + [(5000, "alone"), (5000, "alone"), (None, "alone"), (5001, None)]
    want, _ = joined(list(dict.fromkeys(table)), 5, 80)
    got = jaccard_join.representatives(spark.createDataFrame(table, "doc_id long, text string"))
    assert sorted((r.doc_id is not None, r.doc_id) for r in got.collect()) == sorted((i is not None, i) for i, _, first in want if i == first)


def test_regions_of_nearly_the_same_members_share_a_name():
    rng = jaccard_join.np.random.default_rng(4)
    cls = jaccard_join.tx.mix64(rng.integers(0, 1 << 62, 4000).astype("uint64"))
    names = [jaccard_join.alike(cls[rng.random(4000) < 0.98]) for _ in range(60)]
    assert max(Counter(names).values()) >= 30
    assert len({jaccard_join.alike(cls[k : k + 50]) for k in range(0, 4000, 50)}) == 80


def test_hot_regions_are_gathered_nowhere(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 20)
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    rows = chained(170, 7)
    want, _ = joined(rows, 4, 85)
    got = jaccard_join.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(1))
    assert Counter(map(tuple, got.collect())) == Counter(want)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 40), st.integers(1, 8))
def test_cells_keep_all_links(seed, m, p):
    """Whatever the pivots, two rows within reach of each other meet in a cell where one of them is at home."""
    rng = random.Random(seed)
    sketch = jaccard_join.np.array([[rng.getrandbits(12), 0] for _ in range(m)], jaccard_join.tx.U64)
    d = jaccard_join.hamming(sketch, sketch[:p])
    radius = jaccard_join.np.array([rng.randint(0, 4) for _ in range(m)])
    guests = jaccard_join.np.array([rng.random() < 0.2 for _ in range(m)])
    meet = set()
    for homes, visits in jaccard_join.voronoi(d, radius, guests):
        for a in homes.tolist():
            meet |= {frozenset((a, b)) for b in (*homes.tolist(), *visits.tolist()) if a != b}
    between = jaccard_join.hamming(sketch, sketch)
    for a in range(m):
        for b in range(a):
            if between[a, b] <= min(radius[a], radius[b]) and not (guests[a] and guests[b]):
                assert frozenset((a, b)) in meet


def test_representatives(docs):
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    free = Counter((i, t) for i, t in rows if i is None or not WORD.findall(t or ""))
    assert Counter(x for x in got if x in free) == free
    want, root = joined(rows, 5, 80)
    at = {x: k for k, x in enumerate(rows)}
    linked = [x for x in got if x not in free]
    assert len({root(at[x]) for x in linked}) == len(linked) == len({root(k) for k, x in enumerate(rows) if x not in free})
    assert all(want[at[x]][2] == x[0] for x in linked)


def targets(sizes, weights=(1, 2, 3)):
    """Share by weight; whoever is above three times its size stops there and the rest is shared again."""
    total, out, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        w = sum(weights[i % 3] for i in free)
        over = [i for i in free if left * weights[i % 3] / w > 3 * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i % 3] / w
            break
        for i in over:
            out[i] = 3.0 * sizes[i]
            left -= out[i]
            free.discard(i)
    return out


def test_mix(docs):
    rows = mixing.digest(docs).collect()
    again = mixing.digest(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in rows) == Counter((r.doc_id, r.size, r.taken) for r in again)
    assert len(rows) == docs.count()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs.collect())
    sources = sorted({r.source for r in rows if r.source is not None}) + [None]
    sizes = [sum(r.size for r in rows if r.source == s) for s in sources]
    for s, n, t in zip(sources, sizes, targets(sizes)):
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == n for r in own)
        assert all(abs(r.target - t) < 1e-6 * max(1, t) for r in own)
        assert abs(sum(r.taken for r in own) - t) <= max(1, 0.004 * t)
    assert all(r.taken <= 3 * r.size for r in rows)


def test_mix_of_small_sources(spark):
    """Sources of 5 to 70 words beside a large one come near their targets, whatever their share of the slots."""
    rows, sizes = [], [5, 7, 10, 33, 35, 40, 70, 1, 0, 60_000]
    for k, n in enumerate(sizes):
        left, i = n, 0
        while left > 0:
            m = min(left, 3 + (i * 7) % 9 if n < 100 else 400)
            rows.append((1000 * k + i, " ".join(["w"] * m), f"s{k}"))
            left, i = left - m, i + 1
    rows.append((8000, "  ", "s8"))
    got = mixing.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for k, (n, t) in enumerate(zip(sizes, targets(sizes))):
        own = [r for r in got if r.source == f"s{k}"]
        assert abs(sum(r.taken for r in own) - t) <= max(1, 0.004 * t), (n, t)
        assert all(r.taken <= 3 * r.size for r in own)


def test_mix_schedule_is_even(spark):
    plan = spark.createDataFrame([(0, 100), (1, 300), (2, 600), (3, 0)], "rank int, slots long")
    slots = sorted((r.slot, r.rank, r.nth) for r in mixing.schedule(plan).collect())
    assert len({s for s, _, _ in slots}) == 1000 and slots[0][0] == 0
    seen = Counter()
    for k, (_, rank, nth) in enumerate(slots, 1):
        assert nth == seen[rank]
        seen[rank] += 1
        assert abs(seen[0] - 0.1 * k) < 6 and abs(seen[2] - 0.6 * k) < 6
    assert seen == {0: 100, 1: 300, 2: 600}


def test_realised_mix(docs):
    got = mixing.realised(docs)
    assert got.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        assert abs(r.copies * r.size - r.taken) <= r.size / 2
        want[(r.doc_id, r.size)] += r.copies
    have = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in got.collect())
    assert have == +want


@pytest.mark.parametrize("name", ["accepted", "representatives", "realised"])
def test_empty_tables(spark, name):
    none = spark.createDataFrame([], SCHEMA)
    fn = {"accepted": quality_rules.accepted, "representatives": jaccard_join.representatives, "realised": mixing.realised}[name]
    assert fn(none).count() == 0
    for module in (quality_rules, jaccard_join, mixing, substring_dedup, packing):
        assert module.digest(none).count() == 0
    assert token_counts.token_counts(none).count() == 0


def packed_rows(docs, capacity):
    return packing.packed(packing.pieces(docs, capacity=capacity, keep_ids=True), capacity)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_round_trip(docs, capacity):
    import numpy as np
    import zlib
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter((r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in docs.collect())
    rows = packed_rows(docs, capacity).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length <= capacity and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.piece, ids.tolist(), r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for (doc_id, ids), n in want.items():
        starts = [0, *range(len(ids) % capacity, len(ids), capacity)] if len(ids) % capacity else list(range(0, len(ids), capacity))
        own = by_doc[doc_id]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            assert sum((a, piece, list(ids[a:b]), b - a) == x for x in own) >= n
    assert sum(len(i) * n for (_, i), n in want.items()) == sum(r.length for r in rows)
    sizes = np.array([r.length for r in rows])
    assert len(by_sequence) <= packing.lower_bound(sizes[sizes < capacity], capacity) + int((sizes == capacity).sum()) + 2


def test_packing_exchange(docs, monkeypatch):
    """Many small partitions: what is exchanged still ends up in gapless sequences."""
    monkeypatch.setattr(packing, "PART", 8)
    rows = packed_rows(docs, 64).collect()
    assert len(rows) == packing.pieces(docs, capacity=64).count()
    spaces = {}
    for r in rows:
        spaces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in spaces.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_sequences_hold_their_ids(docs):
    rows = packed_rows(docs, 256)
    for r in packing.sequences(rows).collect():
        assert len(r.ids) == 4 * sum(p.length for p in r.pieces)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 19), min_size=1, max_size=9))
def test_lower_bound_and_best_fit(sizes):
    import numpy as np

    capacity = 20

    def fewest(items, bins):
        if not items:
            return len(bins)
        best = fewest(items[1:], [*bins, capacity - items[0]])
        for k, room in enumerate(bins):
            if room >= items[0] and room not in bins[:k]:
                best = min(best, fewest(items[1:], [*bins[:k], room - items[0], *bins[k + 1 :]]))
        return best

    bins = packing.best_fit(np.array(sizes), capacity)
    fill = np.bincount(bins, sizes)
    assert fill.max() <= capacity
    if len(sizes) <= 7:
        best = fewest(sorted(sizes, reverse=True), [])
        assert packing.lower_bound(np.array(sizes), capacity) <= best <= len(fill)


def test_tokenizer_agrees_on_odd_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.encoder(packing.tokenizer_path())
    rng = random.Random(3)
    alphabet = " \n\t\r  aAzZ09'sé日本𝄞́‍😀<|endoftext|>.,!?-_"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


END = "<|endoftext|>"


def test_tokenizer_agrees_on_added_tokens():
    """The default tokenizer, on texts that hold its added token."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.encoder(packing.tokenizer_path())
    assert encode(f"end.{END}Next") == [437, 13, 50256, 10019]
    rng = random.Random(4)
    parts = [END, END, END[:-1], END[1:], "<|", " ", "  ", "\n", "\r\n\t", "end.", "Next", "'s", "é", "日本", "𝄞", "123", "\u0301", "\u200d", "<|endoftext |>", "<|ENDOFTEXT|>"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert encode(text) == t.encode(text, add_special_tokens=False).ids, text


def test_packing_of_added_tokens(spark):
    import zlib
    from array import array

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = [f"end.{END}Next", f"a {END} b " * 40, END, f"{END}{END}", "plain " * 50]
    got = packing.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {i: array("I", [*t.encode(x, add_special_tokens=False).ids, 0]) for i, x in enumerate(texts)}
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


def best_count(word, pieces, unknown):
    """Highest sum of scores, then fewest tokens, over all segmentations."""
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            if word[start:end] in pieces:
                s, c = best[start]
                options.append((s + pieces[word[start:end]], c + 1))
        if word[end - 1] not in pieces:
            s, c = best[end - 1]
            n = len(word[end - 1].encode())
            options.append((s + n * unknown, c + n))
        best[end] = max(options, key=lambda o: (o[0], -o[1]))
    return best[len(word)][1]


def test_token_counts(docs, monkeypatch):
    pieces = token_counts.vocabulary(token_counts.vocabulary_path())
    unknown = min(pieces.values()) - math.log(256)
    assert abs(sum(map(math.exp, pieces.values())) - 1) < 1e-9
    want = Counter()
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        want[(r.doc_id, len(w), sum(map(len, w)), sum(best_count("▁" + x, pieces, unknown) for x in w))] += 1
    assert Counter(map(tuple, token_counts.token_counts(docs).collect())) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=8), max_size=30), st.integers(0, 5))
def test_trie_shares_prefixes(words, seed):
    rng = random.Random(seed)
    pieces = {p: -float(rng.randint(1, 5)) for p in ("a", "b", "ab", "abc", "ca", "bca", "aa")}
    trie = token_counts.Trie(pieces)
    for w in words:
        assert trie.insert(w) == best_count(w, pieces, trie.unknown) == trie.count(w)
    assert trie.nodes == 1 + len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_token_counts_of_long_words_and_a_full_trie(monkeypatch):
    """Words beyond the trie, and a trie that begins anew, change nothing."""
    pieces = {p: -float(k + 1) for k, p in enumerate(["▁", "a", "b", "ab", "▁ab", "ba", "abab"])}
    rng = random.Random(1)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 5, 300, 2000]))) for _ in range(60)]
    w = _text.split(pa.array([" ".join(words), None, words[0]]))
    for nodes in (1 << 19, 40):
        monkeypatch.setattr(token_counts, "NODES", nodes)
        counts = token_counts.Terminals(pieces)
        unknown = counts.trie.unknown
        for _ in range(2):
            assert counts.of(w).tolist() == [best_count("▁" + x, pieces, unknown) for x in [*words, words[0]]]
    assert counts.trie.nodes < 40 + 260 and len(counts.keys) <= 60
