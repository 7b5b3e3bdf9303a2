"""Exact dedup: distributed radix partitioning from the first byte on; only groups that still hold several texts go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import spark as S

#: Bytes split off in the first round; each later round takes GROW times as many, up to MOST.
FIRST, GROW, MOST = 64, 16, 1 << 20


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Rows are split by the next bytes of their text, round by round, until a group is one row or its texts have ended; texts are
    only ever compared as bytes. A group's count and largest id are summed up in the map tasks, so a hot group costs a row a task;
    the rows of a hot group meet its one row in as many tasks as AQE's skew join splits them into. Null text is empty text. Of equal texts the row with the largest doc_id stays; among rows repeating that doc_id, one of them;
    a null doc_id is smaller than any other. Other columns are left out, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("rid"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
    ).select("doc_id", "rid", F.lit(0).cast("long").alias("gid"), F.sha2("t", 256).alias("text_sha256"), F.col("t").cast("binary").alias("rest"))
    if not S.scan_only(docs):  # a row keeps its number however often it is read
        rows = S.cut(rows)
    done, step = [], FIRST
    while True:
        rows = rows.withColumn("digits", F.expr(f"substring(rest, 1, {step})"))
        groups = S.cut(
            rows.groupBy("gid", "digits").agg(
                F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("rid", "doc_id"), F.min("rid")).alias("keep_rid"), F.min("rid").alias("next")
            ).where("n > 1")
        )
        open_ = F.col("n").isNotNull() & (F.octet_length("digits") == step)
        state = S.cut(
            rows.join(groups, ["gid", "digits"], "left").select(
                "doc_id", "rid", F.col("next").alias("gid"), "text_sha256", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                (F.col("n").isNull() | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
                F.when(open_, F.expr(f"substring(rest, {step + 1})")).alias("rest"),
            )
        )
        done.append(state.where("rest is null").select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
        rows = state.where("rest is not null").select("doc_id", "rid", "gid", "text_sha256", "rest")
        if rows.isEmpty():
            break
        step = min(step * GROW, MOST)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(S.table(spark, sf_dir, "documents"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
SQL = {
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
