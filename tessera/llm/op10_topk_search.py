"""Exact top-k search: Fagin's threshold algorithm over sorted per-dimension lists, block by block with kth scores carried on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import spark as S
from tessera.llm.kernels import blob

#: Vectors and queries in a block; a task holds one block of each.
VECTORS, QUERIES_AT_ONCE = 8192, 1024
#: Blocks of queries whose kth scores a task carries from one block of vectors to the next (8 MB); for others each block starts anew.
CARRIED = 1024


def _blocks(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """Vectors as integer matrices: nr, dim, ids, values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, nr = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        schema = [("nr", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())]

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal nr
            ids, values = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            nr += 1
            return S.batch(schema, [((pid << 24) | nr, dim, blob(ids), blob(values))])

        for b in batches:
            lists = b.column(1)
            sizes, ids = lists.value_lengths().to_numpy(), b.column(0).to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            firsts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                for a in range(0, len(own), size):
                    at = own[a : a + size]
                    values = np.floor(scale * flat[firsts[at][:, None] + np.arange(dim)[None, :]]).astype(np.int64)
                    held.setdefault(int(dim), []).append((ids[at], values.reshape(len(at), dim)))
                    if sum(len(x) for x, _ in held[int(dim)]) >= size:
                        yield flush(int(dim))
        for dim in list(held):
            yield flush(dim)

    return vectors.mapInArrow(run, "nr long, dim int, ids binary, values binary")


def threshold_search(query: np.ndarray, own: int, ids: np.ndarray, values: np.ndarray, falling: np.ndarray, k: int, known: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows for a query. falling: for each dimension, the rows by falling value.

    known: a kth score that other rows have reached already; rows that can't beat it may be left out.
    """
    n, dims = len(ids), np.flatnonzero(query)
    seen = np.zeros(n, bool)
    got_ids, got = np.zeros(0, np.int64), np.zeros(0, np.int64)
    weights = query[dims]
    done, depth = 0, max(k, n // 64)
    while done < n:
        depth = min(depth, n)
        fresh = np.zeros(n, bool)
        if len(dims):
            for d, w in zip(dims, weights, strict=True):
                fresh[falling[d, done:depth] if w > 0 else falling[d, n - depth : n - done]] = True
        else:
            fresh[:] = True
            depth = n
        fresh &= ~seen
        seen |= fresh
        rows = np.flatnonzero(fresh & (ids != own))
        score = values[rows] @ query
        got_ids, got = np.concatenate([got_ids, ids[rows]]), np.concatenate([got, score.astype(np.int64)])
        best = np.lexsort((got_ids, -got))[:k]
        got_ids, got = got_ids[best], got[best]
        if len(dims) and depth < n:
            edge = np.where(weights > 0, values[falling[dims, depth - 1], dims], values[falling[dims, n - depth], dims])
            if max(known, got[-1] if len(got) == k else -np.inf) > int(edge @ weights):  # a tie could have a smaller id, so it doesn't stop
                break
        done, depth = depth, depth * 4
    return got_ids, got


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    Both inputs: vec_id, embedding. Components become floor(scale * x). Rows with a null id, a null vector or null or non-finite
    components take no part; vectors of other lengths than the query's aren't compared with it; empty vectors score 0; rows with the query's own id aren't its
    candidates; repeated rows count again. All rows are searched; an empty table gives no rows; other columns are left out,
    whatever their names. Scores that could be beyond 64 bits raise.

    Blocks of vectors are dealt to salts and sent once; blocks of queries go to every salt. So a block of vectors meets all
    queries in one task, and the kth scores that a query has reached stop it in the task's later blocks.
    """
    spark = vectors.sparkSession

    def fit(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
            "vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
        )

    q = S.cut(_blocks(fit(queries).repartition(max(1, S.parts(spark) // 8)), QUERIES_AT_ONCE, scale)).select(F.col("nr").alias("q_nr"), "dim", F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    v = S.cut(_blocks(fit(vectors), VECTORS, scale))
    salts = S.parts(spark)
    schema = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        nr, values, falling = None, None, None
        for r in S.rows(batches):
            dim, ids, q_ids = r["dim"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
            if r["nr"] != nr:
                nr, values = r["nr"], np.frombuffer(r["values"], np.int64).reshape(len(ids), dim)
                falling = np.argsort(-values, axis=0, kind="stable").T.copy()
            wanted, rows = np.frombuffer(r["q_values"], np.int64).reshape(len(q_ids), dim), values
            largest = float(np.abs(values).max()) * float(np.abs(wanted).max()) * dim if dim else 0.0
            if largest >= 2**63:
                raise OverflowError("scores beyond 64 bits")
            if dim and largest < 2**53:
                rows, wanted = values.astype(np.float64), wanted.astype(np.float64)  # still exact
            kth = known.get(r["q_nr"], np.full(len(q_ids), -np.inf))
            out: list[tuple[int, int, int]] = []
            for i, (own, query) in enumerate(zip(q_ids.tolist(), wanted, strict=True)):
                found, score = threshold_search(query, own, ids, rows, falling, k, kth[i])
                if 0 < k == len(found):
                    kth[i] = max(kth[i], np.nextafter(float(score[-1]), -np.inf))  # not above the score when rounded
                out.extend(zip([own] * len(found), found.tolist(), score.tolist(), strict=True))
            if r["q_nr"] in known or len(known) < CARRIED:
                known[r["q_nr"]] = kth
            yield S.batch(schema, out)

    v = v.withColumn("salt", F.pmod(F.xxhash64("nr"), F.lit(salts))).repartition(salts, "salt")
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    found = v.join(q, ["dim", "salt"]).mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = S.table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES = {"op10_topk_search": op10_topk_search}
SQL = {
    "op10_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
