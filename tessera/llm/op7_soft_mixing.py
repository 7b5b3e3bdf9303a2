"""Mixing sources to target weights: a classifier gives each document's domain posteriors, least squares its rate."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import spark as S

#: Labelled documents that the classifier is trained on: those with the smallest hashes.
TRAIN = 4000
#: Bits of a word's hash that name a feature; a feature must be in so many training documents.
BITS, RARE = 16, 5
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.97, "poor": 0.01, "toxic": 0.02}
STEPS, EXACT = 60, 1e-7


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and feature of each different word of a document, and each document's number of words."""
    h, _, _, first = K.words(raw, off, signs=True)
    size = np.diff(first)
    both = np.unique((np.repeat(np.arange(len(size)), size) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
    return both >> BITS, both & ((1 << BITS) - 1), size


def fit(rows: np.ndarray, cols: np.ndarray, label: np.ndarray, classes: int, rounds: int = 80, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a softmax regression on the presence of features, by gradient steps with momentum (Adam)."""
    n, dims = len(label), 1 << BITS
    frequent = np.bincount(cols, minlength=dims) >= RARE
    keep = frequent[cols]
    rows, cols = rows[keep], cols[keep]
    names, cols = np.unique(cols, return_inverse=True)
    w = np.zeros((len(names) + 1, classes))
    want = np.eye(classes)[label]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.stack([np.bincount(rows, w[:-1, c][cols], n) for c in range(classes)], 1) + w[-1]
        z = np.exp(z - z.max(1, keepdims=True))
        error = (z / z.sum(1, keepdims=True) - want) / n
        g = np.vstack([np.stack([np.bincount(cols, error[rows, c], len(names)) for c in range(classes)], 1), error.sum(0)]) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    out = np.zeros((dims, classes))
    out[names] = w[:-1]
    return out, w[-1]


def posteriors(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], train_docs: int = TRAIN) -> DataFrame:
    """doc_id, n_tokens (words), p: the posterior of each domain for every document, in the order of domains."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    S.hold(spark)
    known = labelled.where(F.col("domain").isin(*domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    have = docs.where("doc_id is not null").select("doc_id").distinct()
    chosen = S.cut(known.join(have, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))  # at most train_docs rows
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "domain")

    def learn(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            ids, raw, off = S.unpack(r)
            doc, feature, _ = features(raw, off)
            at = np.searchsorted(doc, np.arange(len(ids) + 1))
            yield S.batch([("domain", pa.string()), ("found", pa.binary())], [(d, K.blob(feature[at[i] : at[i + 1]].astype(np.uint16))) for i, d in enumerate(r["tags"])])

    rows = S.over(sample, learn, "domain string, found binary", "domain").collect()
    found = sorted(((r.domain, bytes(r.found)) for r in rows))  # in any order the same model
    sets = [np.frombuffer(x, np.uint16).astype(np.int64) for _, x in found]
    label = np.array([domains.index(d) for d, _ in found], int)
    if len(label):
        weights, offset = fit(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets), label, len(domains))
    else:
        weights, offset = np.zeros((1 << BITS, len(domains))), np.zeros(len(domains))
    shared = spark.sparkContext.broadcast((weights, offset))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for part in S.gather(batches, 4 << 20):
            raw, off = K.utf8(part.column(1))
            doc, feature, size = features(raw, off)
            z = np.stack([np.bincount(doc, w[:, c][feature], len(size)) for c in range(len(b))], 1) + b
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).combine_chunks(), pa.array(size), pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * len(b)), pa.array(z.reshape(-1)))], names=["doc_id", "n_tokens", "p"]
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(judge, "doc_id long, n_tokens long, p array<double>")


def rates(scored: DataFrame, targets: list[float], budget: float = 1.0, steps: int = STEPS) -> tuple[Column, list[float]]:
    """A column with the rate of each row of scored (n_tokens, p), and what the expected shares are then.

    The rates r >= 0 minimise the squared distance of sum(r * n_tokens * p) from the targets, times budget and all tokens, in
    the metric in which one step would be exact without the bound; they start at 1 and move by projected gradients with
    momentum. A step needs only one residual for each domain, so a row's rate follows from the residuals so far and no state is
    kept by row.
    """
    dims = len(targets)
    mass = lambda *cols: [F.sum(F.col("n_tokens") * c) for c in cols]
    p = [F.get("p", F.lit(i)) for i in range(dims)]
    first = scored.agg(F.sum("n_tokens"), *mass(*(a * b for i, a in enumerate(p) for b in p[i:]))).first()
    total = float(first[0] or 0)
    if not total:
        return F.lit(1.0), [0.0] * dims
    gram, it = np.zeros((dims, dims)), iter(first[1:])
    for i in range(dims):
        for j in range(i, dims):
            gram[i, j] = gram[j, i] = next(it) / total
    inverse = np.linalg.pinv(gram, hermitian=True)
    goal, history = budget * np.array(targets), []
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))  # the rate, and the point at which the next gradient is taken

    def step(s: Column, g: Column) -> Column:
        r = F.greatest(F.lit(0.0), s["y"] - sum((p[i] * g[i] for i in range(1, dims)), p[0] * g[0]))
        return F.struct(r.alias("r"), (r + g[dims] * (r - s["r"])).alias("y"))

    state, momentum, off = start, 1.0, np.inf
    for _ in range(steps):
        sums = scored.withColumn("s", state).agg(*mass(*(F.col(f"s.{at}") * x for at in "ry" for x in p))).first()
        now, ahead = (np.array([x or 0.0 for x in part]) / total for part in (sums[:dims], sums[dims:]))
        off = np.abs(now - goal).max()
        if off < EXACT:
            break
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        history.append([*(inverse @ (ahead - goal)), (momentum - 1) / following])
        momentum = following
        moves = F.array(*(F.array(*map(F.lit, map(float, g))) for g in history))
        state = F.aggregate(moves, start, step)
    if off >= EXACT:  # nonnegative rates can't meet the targets, or not in so many steps
        warnings.warn(f"the mixture's shares are off by up to {off:.2g} after {steps} steps", stacklevel=2)
    return state["r"], now.tolist()


def soft_mixing(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0, train_docs: int = TRAIN) -> DataFrame:
    """doc_id, n_tokens, p (an array in the order of targets), rate for every document: how often it should be seen so that
    the expected tokens of each domain are budget * all tokens * its target.

    labelled: doc_id, domain; a document with several labels takes the first by name; labels of other domains count as none.
    Targets must sum to 1. Null and empty texts have no tokens, the posterior of an empty text and a rate of their own; null doc_ids stay; repeated
    rows count each; without labels the posteriors are even; an empty table gives no rows. Where targets cannot be met with
    nonnegative rates, the distance falls for STEPS steps; a warning then says how far the shares are off, if by EXACT or more.
    """
    assert abs(sum(targets.values()) - 1) < 1e-9 and min(targets.values()) >= 0
    scored = S.cut(posteriors(docs, labelled, tuple(targets), train_docs))
    rate, _ = rates(scored, list(targets.values()), budget)
    return scored.select("doc_id", "n_tokens", "p", rate.alias("rate"))


def domains_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = soft_mixing(S.table(spark, sf_dir, "documents"), domains_of(spark, sf_dir), TARGETS)
    return mixed.select("doc_id", "n_tokens", *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(TARGETS)), "rate")


QUERIES = {"op7_soft_mixing": op7_soft_mixing}
SQL: dict[str, str] = {}
