"""Operators 2, 6, 8 and 9 against brute force."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import op2_ngram_jaccard_join as op2
from tessera.llm import op6_suffix_array_dedup as op6
from tessera.llm import op8_exact_dedup as op8
from tessera.llm import op9_substring_dedup as op9
from tests.llm.util import EDGE, corpus, frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CORPORA = [corpus(60, 0) + EDGE, corpus(90, 1), EDGE, []]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def jaccard(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(sets[i]), find(i)) for i in sets), key=str)


@pytest.mark.parametrize("docs", CORPORA)
def test_jaccard_join(spark, docs):
    assert rows(op2.jaccard_join(frame(spark, docs)), "doc_id", "n_shingles", "component_id") == jaccard(docs)


def test_jaccard_join_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(120):  # each changes its own few words; some only meet through the base
        words = list(base)
        for k in range(i % 3):
            words[(7 * i + 20 * k) % 60] = f"x{i}{k}"
        docs.append((i, " ".join(words)))
    assert rows(op2.jaccard_join(frame(spark, docs)), "doc_id", "n_shingles", "component_id") == jaccard(docs)


def test_jaccard_join_repeated_and_null_ids(spark):
    docs = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (9, "a b c d e f g")]
    assert rows(op2.jaccard_join(frame(spark, docs)), "doc_id", "n_shingles", "component_id") == [(5, 3, 5), (5, 3, 5), (9, 3, 5)]


@pytest.mark.parametrize("docs", CORPORA)
def test_exact_dedup(spark, docs):
    df = frame(spark, docs)
    got = rows(op8.exact_dedup(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    assert got == sorted(((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), sha((t or "").encode())) for i, t in docs), key=str)


def test_exact_dedup_ends_and_lengths(spark):
    docs = [(i, "x" * n) for i, n in enumerate([63, 64, 64, 65, 1087, 1088, 1088, 1089, 0, 0])] + [(50, "x" * 1088 + "y"), (51, "x" * 20_000 + "a"), (52, "x" * 20_000 + "b"), (53, "x" * 20_000 + "a")]
    got = {r.doc_id: r.keep_id for r in op8.exact_dedup(frame(spark, docs)).collect()}
    last = {t: i for i, t in docs}
    assert got == {i: last[t] for i, t in docs}


def test_exact_dedup_repeated_rows(spark):
    df = frame(spark, [(5, "a"), (5, "a"), (3, "a"), (None, "b"), (None, "b")])
    got = op8.exact_dedup(df)
    assert rows(got.where("kept"), "doc_id", "group_size") == [(5, 3), (None, 2)] and got.count() == 5


def cut_bytes(docs, n):
    seen, out = set(), []
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if b[k : k + n] in seen:
                gone[k : k + n] = b"\1" * n
            seen.add(b[k : k + n])
        out.append((i, len(b), [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))], bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("docs", CORPORA)
@pytest.mark.parametrize(("length", "anchor"), [(100, 32), (20, 5), (9, 9)])
def test_suffix_array_dedup(spark, docs, length, anchor):
    got = {r.doc_id: (r.doc_id, r.n_symbols, list(zip(r.starts, r.ends, strict=True)), bytes(r.kept)) for r in op6.suffix_array_dedup(frame(spark, docs), length, anchor).collect()}
    assert got == {x[0]: x for x in cut_bytes(docs, length)}


def test_suffix_array_dedup_periods(spark):
    docs = [(3, "ab" * 300), (1, "a" * 500), (2, "x" + "a" * 150 + "y" + "ab" * 80)]
    got = {r.doc_id: bytes(r.kept) for r in op6.suffix_array_dedup(frame(spark, docs)).collect()}
    assert got == {x[0]: x[3] for x in cut_bytes(docs, 100)}


def cut_words(docs, n):
    seen, out = {}, []
    for i, t in sorted(docs):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[k : k + n]), i) < i:
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    return out


@pytest.mark.parametrize("docs", CORPORA)
@pytest.mark.parametrize(("length", "anchor"), [(13, 5), (4, 2), (3, 3)])
def test_substring_dedup(spark, docs, length, anchor):
    got = {r.doc_id: (r.doc_id, r.n_symbols, sum(b - a for a, b in zip(r.starts, r.ends, strict=True)), bytes(r.kept)) for r in op9.substring_dedup(frame(spark, docs), length, anchor).collect()}
    assert got == {x[0]: x for x in cut_words(docs, length)}


def test_long_documents_are_cut_into_pieces(spark, monkeypatch):
    """One document longer than a slice of the hashing kernel."""
    text = " ".join(f"w{i % 9973}" for i in range(400_000))
    docs = [(1, text), (2, "head " + text[1000:3000] + " tail")]
    got = {r.doc_id: (r.n_symbols, bytes(r.kept)) for r in op6.suffix_array_dedup(frame(spark, docs)).collect()}
    assert got == {x[0]: (x[1], x[3]) for x in cut_bytes(docs, 100)}


@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op8_exact_dedup"])
def test_queries_equal_sql(spark, sf_dir, name):
    module = {"op2_ngram_jaccard_join": op2, "op8_exact_dedup": op8}[name]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = module.QUERIES[name](spark, sf_dir)
    r = con.sql(module.SQL[name])
    at = [r.columns.index(c) for c in df.columns]
    assert rows(df, *df.columns) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=str)


def test_digest_queries(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(op6.op6_suffix_array_dedup(spark, sf_dir), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((i, n, n - len(k), len(s), sha(k)) for i, n, s, k in cut_bytes(docs, 100)), key=str)
    assert rows(op9.op9_substring_dedup(spark, sf_dir), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(((i, n, g, sha(k)) for i, n, g, k in cut_words(docs, 13)), key=str)


def test_rows_that_share_a_doc_id_are_compared_like_others(spark):
    docs = [(5, "a b c d e f g h i j"), (5, "q r s t u v w x y z"), (7, "q r s t u v w x y z k"), (9, "a b c d e f g h i j k")]
    for parts in (1, 3):
        assert rows(op2.jaccard_join(frame(spark, docs, parts)), "doc_id", "component_id") == [(5, 5), (5, 5), (7, 5), (9, 5)]
    docs = [(3, "a b c d e f g h i j"), (4, "q r s t u v w x y z"), (4, "a b c d e f g h i j k"), (6, None), (6, ""), (8, "q r s t u v w x y z k")]
    assert rows(op2.jaccard_join(frame(spark, docs)), "doc_id", "component_id") == [(3, 3), (4, 3), (4, 4), (6, 6), (6, 6), (8, 4)]
