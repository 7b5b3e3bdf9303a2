"""Token counts: an exact histogram of encoded lengths answers totals, quantiles and truncated totals by suffix sums."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import spark as S
from tessera.llm.tokens import default_path, encoder


def length_histogram(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many texts have each encoded length. Null and empty texts have length 0; an empty table gives no rows; repeated rows count again."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: Counter[int] = Counter()
        for b in batches:
            for a in range(0, b.num_rows, 256):
                sizes.update(len(x) >> 2 for x in encoder(path).encode([t or "" for t in b.column(0)[a : a + 256].to_pylist()]))
        if sizes:
            yield pa.RecordBatch.from_arrays([pa.array(sizes.keys(), pa.int64()), pa.array(sizes.values(), pa.int64())], names=["n_tokens", "n"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def token_counts(docs: DataFrame, path: str | None = None, bucket: int = 1024) -> DataFrame:
    """One row per distinct encoded length n_tokens, which is also a context limit.

    n_docs: texts of this length; docs_longer: texts beyond it; docs_at_most; quantile: share of texts of at most this length;
    tokens_at_most: tokens of those; total_tokens, total_docs: of all; truncated_tokens: tokens left when each text is cut at
    n_tokens. Between two rows the answers follow from the row below: each further token of the limit adds docs_longer.
    Suffix sums run in buckets of lengths, then over the buckets, so no window holds all lengths.
    """
    h = S.cut(length_histogram(docs, path)).withColumn("bucket", F.floor(F.col("n_tokens") / bucket))
    sums = h.groupBy("bucket").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("b_tokens"))
    up = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    sums = sums.select(
        "bucket",
        F.coalesce(F.sum("b_docs").over(up), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("b_tokens").over(up), F.lit(0)).alias("tokens_before"),
        F.sum("b_docs").over(total).alias("total_docs"),
        F.sum("b_tokens").over(total).alias("total_tokens"),
    )
    own = Window.partitionBy("bucket").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return (
        h.join(sums, "bucket")
        .withColumn("docs_at_most", F.col("docs_before") + F.sum("n_docs").over(own))
        .withColumn("tokens_at_most", F.col("tokens_before") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(own))
        .withColumn("docs_longer", F.col("total_docs") - F.col("docs_at_most"))
        .select(
            "n_tokens", "n_docs", "docs_at_most", "docs_longer", "tokens_at_most",
            (F.col("tokens_at_most") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_tokens"),
            "total_docs", "total_tokens", (F.col("docs_at_most") / F.col("total_docs")).alias("quantile"),
        )
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(S.table(spark, sf_dir, "documents"))


QUERIES = {"op3_token_counts": op3_token_counts}
SQL: dict[str, str] = {}
