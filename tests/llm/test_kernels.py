import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tessera.llm import kernels as K
from tessera.llm import op1_quality_classifier as op1
from tessera.llm import spark as S
from tessera.llm.fm_index import FMIndex, WaveletMatrix
from tessera.llm.graph import forest
from tessera.llm.packing import best_plan

TEXT = st.text(alphabet="ab é　\n\t\x0b\x1c.,A", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    raw, off = K.utf8(pa.array(texts, pa.string()))
    h, s, e, first = K.words(raw, off)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert list(np.diff(first)) == [len(w) for w in want]
    flat = [w for d in want for w in d]
    assert [bytes(raw[a:b]) for a, b in zip(s, e, strict=True)] == flat
    assert len(set(zip(h.tolist(), flat, strict=True))) == len(set(h.tolist())) == len(set(flat))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00", min_size=1, max_size=40), max_size=30))
@example(["a" * n for n in range(1, 40)] + ["a" * n + "\x00" for n in range(1, 40)] + ["\x00" * n for n in range(1, 40)])
def test_words_of_any_length_have_hashes_of_their_own(words):
    h = K.words(*K.utf8(pa.array([" ".join(words)])))[0]
    assert len(set(zip(h.tolist(), words, strict=True))) == len(set(h.tolist())) == len(set(words))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_grams_and_minima(values, n):
    h = K.mix(np.array(values, np.uint64))
    g = K.grams(h, n)
    want = [tuple(values[i : i + n]) for i in range(len(values) - n + 1)]
    assert len(g) == len(want) and len(set(zip(g.tolist(), want, strict=True))) == len(set(want)) == len(set(g.tolist()))
    assert K.sliding_min(h, n).tolist() == [min(h[i : i + n].tolist()) for i in range(len(want))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=80))
def test_wavelet_matrix_counts(values):
    x = np.array(values)
    m = WaveletMatrix(x, 7)
    sym, at = np.repeat(np.arange(7), len(x) + 1), np.tile(np.arange(len(x) + 1), 7)
    got, zero = m.rank(sym, at, np.zeros(len(at), np.int64))
    assert got.tolist() == [int((x[:i] == s).sum()) for s, i in zip(sym, at, strict=True)] and not zero.any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=14), min_size=1, max_size=6), st.lists(st.integers(0, 2), min_size=1, max_size=20), st.integers(2, 5))
def test_backward_search_finds_every_window(runs, query, depth):
    size = np.array([len(r) for r in runs])
    index = FMIndex(np.array([x for r in runs for x in r]), size, depth)
    have = [tuple(r[i : i + depth]) for r in runs for i in range(len(r) - depth + 1)]
    alphabet = {x for r in runs for x in r}
    if not set(query) <= alphabet or max(query) > max(alphabet):
        query = [min(alphabet)] * len(query)
    got = {}
    for run, back, lo, hi in index.stream(np.array(query), np.array([len(query)])):
        for b, n in zip(back.tolist(), (hi - lo).tolist(), strict=True):
            got[len(query) - b] = n
    want = {i: have.count(tuple(query[i : i + depth])) for i in range(len(query) - depth + 1)}
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in want.items() if n}


def test_forest():
    v, r = forest(np.array([5, 3, 9, 7]), np.array([3, 1, 8, 7]))
    assert dict(zip(v.tolist(), r.tolist(), strict=True)) == {5: 1, 3: 1, 9: 8}


@settings(max_examples=60, deadline=None)
@example({33: 9})
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_hold_every_piece_once(histogram):
    p = best_plan(histogram, 64)
    fill, seen = {}, {}
    for i, n in enumerate(p["length"]):
        nxt = p["rank_from"][i + 1] if i + 1 < len(p["length"]) and p["length"][i + 1] == n else histogram[int(n)]
        for k in range(int(nxt - p["rank_from"][i])):
            fill.setdefault(int(p["seq"][i]) + k, []).append((int(p["offset"][i]), int(n)))
        seen[int(n)] = int(nxt)
    assert seen == histogram and len(fill) == int(p["sequences"][0])
    for pieces in fill.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    # no packing has fewer sequences than the tokens fill, or than there are pieces of which no two fit together
    least = max(-(-sum(a * b for a, b in histogram.items()) // 64), sum(c for n, c in histogram.items() if n > 32))
    assert len(fill) <= least * 1.5 + 1


def test_gathered_and_find():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 200, 1000).astype(np.uint64) << np.uint64(50)
    order, begin = K.gathered(x)
    values, counts = np.unique(x, return_counts=True)
    assert (x[order[begin]] == values).all() and (np.diff(begin, append=len(x)) == counts).all()
    assert (K.find(values, x) == np.searchsorted(values, x)).all()
    assert [len(a) for a in K.gathered(x[:0])] == [0, 0] and not len(K.find(values, x[:0]))


def test_contexts_stand_together():
    """Words that differ only in bits that the sorted number has no room for, too."""
    rng = np.random.default_rng(6)
    many = np.arange(1 << 17, dtype=np.uint64)
    v, u = np.concatenate([many, rng.integers(0, 9, 500).astype(np.uint64)]), np.concatenate([many, rng.integers(0, 5, 500).astype(np.uint64)])
    order = op1._by_both(v, u)
    assert (np.diff(v[order].astype(np.int64)) >= 0).all() and len(K.changes(v[order], u[order])) == len(set(zip(v.tolist(), u.tolist(), strict=True)))


def test_one_question_a_shard():
    """A block asks each shard once for n-grams of all kinds, whatever the number of shards; names, documents and counts are whole."""
    rng = np.random.default_rng(7)
    for most, shards in ((50, 3), (1 << 17, 300)):
        grams = [(rng.integers(0, 1 << 62, 400).astype(np.uint64)[rng.integers(0, 400, 900)], rng.integers(0, most, 900).astype(np.uint64)) for _ in range(3)]
        want = Counter((int(k >> 20) % shards, kind << 40 | int(k) >> 24, int(d)) for kind, (keys, docs) in enumerate(grams) for k, d in zip(keys.tolist(), docs.tolist(), strict=True))
        got, asked = Counter(), Counter()
        for s, names, docs, many, times in op1._questions(grams, most, shards):
            asked[s] += 1
            assert (np.diff(names.astype(np.int64)) > 0).all()
            for name, doc, n in zip(np.repeat(names, many).tolist(), docs.tolist(), times.tolist(), strict=True):
                got[s, name, doc] += n
        assert got == want and set(asked.values()) == {1}


def test_table_of_weights():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5000):
        names = np.unique(op1._names(rng.integers(0, 1 << 40, n).astype(np.uint64), rng.integers(0, 3, n)))
        table = op1.Table(names, np.arange(1, len(names) + 1))
        known = dict(zip(names.tolist(), range(1, len(names) + 1), strict=True))
        asked = np.concatenate([names, names + np.uint64(1), rng.integers(0, 3 << 40, 500).astype(np.uint64), np.array([0, (3 << 40) - 1], np.uint64)])
        assert table.get(asked).tolist() == [known.get(x, 0) for x in asked.tolist()]


def test_memory_is_trimmed_after_several_batches(monkeypatch):
    seen = []
    monkeypatch.setattr(S, "trim", lambda: seen.append(1))
    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(10)]
    assert [r["x"] for r in S.rows(iter(batches), 8)] == list(range(10)) and len(seen) == 2
    assert len(list(S.rows(iter(batches)))) == 10 and len(seen) == 12
