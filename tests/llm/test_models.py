"""Operators 1, 3, 4, 5, 7 and 10, and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import op1_quality_classifier as op1
from tessera.llm import op3_token_counts as op3
from tessera.llm import op4_quotation_linking as op4
from tessera.llm import op5_best_fit_packing as op5
from tessera.llm import op7_soft_mixing as op7
from tessera.llm import op10_topk_search as op10
from tessera.llm.tokens import default_path, encoder
from tests.llm.util import EDGE, corpus, frame, rows


def ids_of(text):
    return encoder(default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


def tokens(text):
    import re

    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\s0-9A-Za-z\x80-\U0010ffff]+", text)


def kneser_ney(train, texts):
    """Interpolated modified Kneser-Ney over trigrams, written down plainly: bits of each text."""
    tri = Counter()
    for t in train:
        w = ["<", "<", *tokens(t)]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)

    def discounts(c):
        n = Counter(c.values())
        if not (n[1] and n[2] and n[3]):
            return [0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i) for i in (1, 2, 3)]

    d3, d2, d1 = discounts(tri), discounts(bi), discounts(uni)
    of = lambda c, d: d[min(c, 3) - 1]
    x3, x2 = defaultdict(list), defaultdict(list)
    for (u, v, _), c in tri.items():
        x3[u, v].append(c)
    for (v, _), c in bi.items():
        x2[v].append(c)
    total = sum(uni.values())
    unseen = sum(of(c, d1) for c in uni.values()) / total / (len(uni) + 1)
    out = []
    for t in texts:
        w, bits = ["<", "<", *tokens(t)], 0.0
        for u, v, x in zip(w, w[1:], w[2:], strict=False):
            p = unseen + (uni[x] - of(uni[x], d1)) / total * (x in uni)
            if v in x2:
                s = sum(x2[v])
                p = (bi[v, x] - of(bi[v, x], d2)) / s * ((v, x) in bi) + sum(of(c, d2) for c in x2[v]) / s * p
            if (u, v) in x3:
                s = sum(x3[u, v])
                p = (tri[u, v, x] - of(tri[u, v, x], d3)) / s * ((u, v, x) in tri) + sum(of(c, d3) for c in x3[u, v]) / s * p
            bits -= math.log2(p)
        out.append(bits)
    return out


def test_perplexity_is_that_of_the_model(spark):
    docs = corpus(80, 3)
    train, rest = docs[:40], docs[40:] + [(2001, "never seen!! words, 12 é"), (2002, "")]
    model = op1.train(frame(spark, train).select("doc_id", "text"))
    got = {r.doc_id: r for r in op1.perplexity(frame(spark, train + rest), model).collect()}
    for (i, t), bits in zip(train + rest, kneser_ney([t for _, t in train], [t for _, t in train + rest]), strict=True):
        assert got[i].n_words == len(tokens(t or ""))
        assert got[i].bits == pytest.approx(bits, rel=2e-3, abs=1e-2)


def test_quality_classifier(spark):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "and", "ran"]) for _ in range(60))) for i in range(120)]
    junk = [(1000 + i, " ".join("".join(rng.choice("QXZ!%") for _ in range(6)) for _ in range(60))) for i in range(10)]
    edge = [(3000, None), (3001, ""), (3002, "the cat"), (None, "the cat")]
    trusted = spark.createDataFrame([(i,) for i, _ in good], "doc_id bigint")
    got = {r.doc_id: r for r in op1.quality_classifier(frame(spark, good + junk + edge), trusted).collect()}
    assert set(got) == {i for i, _ in good + junk + edge if i is not None}
    assert all(got[i].keep for i, _ in good) and not any(got[i].keep for i, _ in junk)
    assert got[3002].keep and not got[3000].keep and not got[3001].keep and got[3000].perplexity is None
    nobody = op1.quality_classifier(frame(spark, good[:3] + edge[:1]), trusted.where("doc_id < 0"))
    assert {r.doc_id: r.keep for r in nobody.collect()} == {0: True, 1: True, 2: True, 3000: False}
    assert op1.quality_classifier(frame(spark, []), trusted).count() == 0


def test_quality_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = op1.op1_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good, bad = (got.where(f"quality = {q}").agg(F.avg(F.col("keep").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.97 and bad < 0.35


def test_all_trusted_documents_count(spark):
    """Words that stand in one trusted document each, of more documents than any sample took: every word that isn't held out is known."""
    docs = [(i, f"the cat sat on a mat rare{i} rare{i}") for i in range(2400)]
    df = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id bigint, text string, lang string").repartition(3)
    seen = []
    train = op1.train
    op1.train = lambda *args: seen.append(train(*args)) or seen[-1]
    try:
        op1.quality_classifier(df, df.select("doc_id")).count()
    finally:
        op1.train = train
    counted = df.where("pmod(xxhash64(doc_id), 3) <> 0").count()
    assert seen[0].total == op1.train(df.where("pmod(xxhash64(doc_id), 3) <> 0").select("doc_id", "text")).total and seen[0].total > 2 * counted > 1000


def test_all_held_out_documents_give_the_threshold(spark):
    """A third of 2,400 documents is held out; median and quantile are those of all of them."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("abcdefghij") for _ in range(40)) + " x!" * (i % 90 == 0) * 30) for i in range(2400)]
    df = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id bigint, text string, lang string").repartition(3)
    held = df.where("pmod(xxhash64(doc_id), 3) = 0").select("doc_id")
    model = op1.train(df.join(held, "doc_id", "left_anti").select("doc_id", "text"))
    rows = [(r.bits, r.n_words) for r in op1.perplexity(df, model).join(held, "doc_id").collect()]
    usual = np.median([b / n for b, n in rows])
    want = 2 ** np.quantile([(b + op1.PRIOR * usual) / (n + op1.PRIOR) for b, n in rows], op1.QUANTILE) * op1.MARGIN
    assert len(rows) > 700
    assert op1.quality_classifier(df, df.select("doc_id")).first().threshold == pytest.approx(want, rel=2e-3)


def test_token_counts(spark):
    docs = corpus(30, 5) + EDGE
    got = op3.token_counts(frame(spark, docs), bucket=8).orderBy("n_tokens").collect()
    sizes = sorted(len(ids_of(t)) for _, t in docs)
    assert {r.n_tokens: r.n_docs for r in got} == Counter(sizes)
    for r in got:
        assert (r.docs_at_most, r.docs_longer) == (sum(s <= r.n_tokens for s in sizes), sum(s > r.n_tokens for s in sizes))
        assert r.truncated_tokens == sum(min(s, r.n_tokens) for s in sizes) and r.tokens_at_most == sum(s for s in sizes if s <= r.n_tokens)
        assert (r.total_docs, r.total_tokens) == (len(sizes), sum(sizes)) and r.quantile == r.docs_at_most / len(sizes)
    assert op3.token_counts(frame(spark, [])).count() == 0


def test_fast_encoder_is_exact():
    rng = random.Random(2)
    parts = ["a", "b1", " ", "  ", "\n", "\t", ".,", "'s", "é", " ", "　", "\x0b", "\x1c", "<|endoftext|>", "\U0001f600", "中", "ll've"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(2000)] + [" " * 5000, "a" * 5000]
    e = encoder(default_path())
    assert e.fast is not None and [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("docs", [corpus(40, 6) + EDGE + [(None, "x"), (7000, "word " * 3000), (7000, "word " * 3000)], []])
def test_best_fit_packing(spark, docs):
    cap = 256
    got = op5.best_fit_packing(frame(spark, docs), cap).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, t in docs:
        ids = [*ids_of(t), 0]
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]})
        assert [p[0] for p in pieces] == list(range(len(pieces))) and all(p[2] == cap for p in pieces[1:])
        for _, start, length, crc in pieces:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        assert sum(p[2] for p in pieces) == len(ids)
    total = 0
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(len(ids_of(t)) + 1 for _, t in docs)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= cap
    assert len(seqs) <= -(-total // cap) * 1.08 + 1


def test_rates_meet_the_targets(spark):
    rng = random.Random(8)
    rows_ = []
    for i in range(300):
        p = [rng.random() ** 3 for _ in range(3)]
        rows_.append((i, rng.randint(0, 500), [x / sum(p) for x in p]))
    df = spark.createDataFrame(rows_, "doc_id bigint, n_tokens bigint, p array<double>")
    targets = [0.7, 0.25, 0.05]
    rate, now = op7.rates(df, targets, steps=200)
    assert now == pytest.approx(targets, abs=1e-6)
    out = df.withColumn("rate", rate).collect()
    assert min(r.rate for r in out) >= 0
    total = sum(r.n_tokens for r in out)
    assert [sum(r.rate * r.n_tokens * r.p[d] for r in out) / total for d in range(3)] == pytest.approx(targets, abs=1e-6)
    # by hand: the same steps in plain NumPy
    t, p = np.array([r.n_tokens for r in out], float), np.array([r.p for r in out])
    gram, r, y, m = (p * t[:, None]).T @ p / total, np.ones(len(t)), np.ones(len(t)), 1.0
    while np.abs((p * t[:, None]).T @ r / total - targets).max() >= op7.EXACT:
        before, r = r, np.maximum(0, y - p @ np.linalg.pinv(gram) @ ((p * t[:, None]).T @ y / total - targets))
        m, last = (1 + math.sqrt(1 + 4 * m * m)) / 2, m
        y = r + (last - 1) / m * (r - before)
    assert [x.rate for x in out] == pytest.approx(r.tolist(), abs=1e-6)
    _, impossible = op7.rates(spark.createDataFrame([(1, 10, [0.5, 0.5])], "doc_id bigint, n_tokens bigint, p array<double>"), [0.9, 0.1])
    assert impossible == pytest.approx([0.5, 0.5], abs=1e-6)


def test_soft_mixing(spark):
    sf = "/root/testdata/sf0.01"
    labels = op7.domains_of(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("domain", F.lit("x"))
    half = labels.where("doc_id % 2 = 0")
    scored = op7.posteriors(docs, half, op7.DOMAINS).join(labels.where("doc_id % 2 = 1"), "doc_id")
    right = scored.select((F.get("p", F.lit(0)) > 0.5).alias("good"), "domain").where("domain <> 'toxic'").select((F.col("good") == (F.col("domain") == "good")).cast("int").alias("ok"))
    assert right.agg(F.avg("ok")).first()[0] > 0.85
    edge = frame(spark, EDGE + [(None, "a")])
    got = op7.soft_mixing(edge, labels.where("doc_id < 0"), {"a": 0.5, "b": 0.5})
    assert got.count() == len(EDGE) + 1 and all(r.rate == pytest.approx(1) and r.p == [0.5, 0.5] for r in got.collect())
    assert op7.soft_mixing(frame(spark, []), labels, op7.TARGETS).count() == 0


def brute_top(vectors, k):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(b) == len(a))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_top_k(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(op10, "VECTORS", 64)
    dim = (1, 3, 8, 16)[seed]
    vectors = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(dim)]) for i in range(300)]
    vectors += [(300, None), (350, [None] * dim), (400, [float("nan")] * dim), (450, [float("inf")] * dim), (None, [1.0] * dim), (500, [1.0] * (dim + 1)), (501, [2.0] * (dim + 1)), (550, [0.0] * dim), (7, [1.0] * dim)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id bigint, embedding array<float>, nr int").repartition(3)
    assert rows(op10.top_k(df, df.where("vec_id % 50 = 0")), "query_id", "rank", "vec_id", "score") == brute_top(vectors, 5)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert op10.top_k(df, df).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    values = rng.normal(0, 1, (4000, 4)).round(2) * 100
    values[17] = 1000
    seen = []

    class Rows(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.ndim == 1:
                seen.append(len(key))
            return np.asarray(super().__getitem__(key))

    falling = np.argsort(-values, axis=0, kind="stable").T.copy()
    ids, score = op10.threshold_search(np.array([1.0, 1, 1, 1]), -1, np.arange(4000), values.view(Rows), falling, 1)
    assert ids.tolist() == [17] and score.tolist() == [4000] and sum(seen) < 1000
    others = np.delete(values, 17, 0)
    falling = np.argsort(-others, axis=0, kind="stable").T.copy()
    looked = []
    for known in (-np.inf, 4000.0):  # a score known from elsewhere stops the search earlier
        seen.clear()
        op10.threshold_search(np.array([1.0, 1, 1, 1]), -1, np.arange(3999), others.view(Rows), falling, 5, known)
        looked.append(sum(seen))
    assert looked[1] < looked[0]


def test_top_k_beyond_64_bits(spark):
    df = spark.createDataFrame([(i, [1e15, 1e15]) for i in range(51)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        op10.top_k(df, df.where("vec_id % 50 = 0")).collect()


def test_quotes():
    body, own, quoted = op4.parse("Yes.\n\nOn Monday X wrote:\n> > deep line\n> A  Line\n> second\nthanks")
    assert body == "Yes.\n\nthanks" and len(own) == 3
    assert sorted({x for x, _ in quoted}) == [1, 2]
    assert (1, op4.digest("a line second")) in quoted and (2, op4.digest("deep line")) in quoted
    assert op4.parse("") == ("", [], [])


def test_quotation_linking(spark):
    msgs = [
        (1, 0, "user", "First line here\nother words"), (1, 1, "assistant", "Reply one"), (1, 2, "user", "> First line here\nabout the start"), (1, 3, "assistant", "> > First line here\n> about the start\nsure"),
        (1, 4, "user", "no quote"), (2, 0, "user", "> Reply one\ncontinuing elsewhere"), (2, 1, "assistant", "ok"), (3, 0, "user", "> nobody said this\nhm"), (4, 0, "user", "> ok\nchain"),
        (None, 5, "user", "> ok"), (5, None, None, None), (6, 0, "user", ""), (6, 0, "user", ""),
    ]
    df = spark.createDataFrame([(*m, 1, "x") for m in msgs], "conv_id bigint, turn bigint, role string, text string, mid int, unit string").repartition(3)
    out = op4.quotation_linking(df)
    assert out.count() == len(msgs)
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    parent = {k: (r.parent_conv, r.parent_turn) for k, r in got.items()}
    assert parent[1, 0] == (None, None) and parent[1, 1] == (1, 0) and parent[1, 2] == (1, 0) and parent[1, 3] == (1, 2) and parent[1, 4] == (1, 3)
    assert parent[2, 0] == (1, 1) and parent[2, 1] == (2, 0) and parent[3, 0] == (None, None) and parent[4, 0] == (2, 1)
    assert [got[k].thread_id for k in ((1, 0), (2, 1), (3, 0), (4, 0))] == [1, 1, 3, 1] and [got[k].hop for k in ((1, 0), (2, 0), (4, 0))] == [0, 1, 2]
    assert got[1, 3].text == "sure" and got[1, 3].n_quotes > 0 and got[3, 0].n_linked == 0
    order = [(r.conv_id, r.turn) for r in out.where("thread_id = 1").orderBy("thread_id", "hop", "conv_id", "turn").collect()]
    assert all(order.index(parent[k]) < i for i, k in enumerate(order) if parent[k] != (None, None))
    assert op4.quotation_linking(df.where("conv_id = 99")).count() == 0


def test_latest_original_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(op4, "BUCKET", 4)
    msgs = [(1, t, "u", "the same line" if t in (0, 2, 9) else "> the same line" if t in (1, 7, 10, 30) else f"t{t}") for t in range(31)]
    df = spark.createDataFrame(msgs, "conv_id bigint, turn bigint, role string, text string")
    got = {r.turn: r.parent_turn for r in op4.quotation_linking(df).collect()}
    assert (got[1], got[7], got[10], got[30]) == (0, 2, 9, 9) and got[4] == 3 and got[5] == 4


def test_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "soft_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == columns and 0 < kept.count() <= docs.count()
    once = corpus_pipeline.exact(spark, kept, sf_dir)
    last = {r.text: r.m for r in kept.groupBy("text").agg(F.max("doc_id").alias("m")).collect()}
    assert {r.doc_id for r in once.collect()} == set(last.values()) and once.columns == columns
    apart = corpus_pipeline.near(spark, once, sf_dir)
    from tests.llm.test_dedup import jaccard

    assert {r.doc_id for r in apart.collect()} == {c for _, _, c in jaccard([(r.doc_id, r.text) for r in once.collect()])} and apart.columns == columns
    mixed = corpus_pipeline.mixed(spark, apart, sf_dir)
    assert mixed.columns == columns
    times, rate = Counter(r.doc_id for r in mixed.collect()), {r.doc_id: r.rate for r in op7.soft_mixing(apart, op7.domains_of(spark, sf_dir), op7.TARGETS).collect()}
    assert all(math.floor(x) <= times[i] <= math.floor(x) + 1 for i, x in rate.items()) and set(times) <= set(rate)
    out = corpus_pipeline.packed(spark, mixed, sf_dir)
    assert {r.doc_id for r in out.collect()} == set(times)


def test_pipeline_on_repeated_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (2, "a b", "en", "s", 3), (2, "c", None, None, None), (3, None, "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = rows(corpus_pipeline.exact(spark, docs, sf_dir), "doc_id", "text")
    assert got == [(2, "a b"), (2, "c"), (3, None)]
    assert corpus_pipeline.near(spark, docs, sf_dir).count() >= 1
