"""Output paths that would overwrite each other, or lie below each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import hashed_name


def same_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """key and n of paths that differ at most in case and occur more than once."""
    return paths.groupBy(F.lower(path).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def prefixes(paths: DataFrame, path: str = "path") -> DataFrame:
    """ancestor: all proper directory prefixes of the lower-cased paths, each once. A path of d parts gives d - 1 rows, so no pair of paths is ever compared."""
    parts = F.split(F.lower(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return paths.select(F.explode(F.when(F.size(parts) > 1, up)).alias("ancestor")).distinct()


def prefix_collisions(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is a directory prefix of another row's path."""
    return paths.join(prefixes(paths, path), F.lower(path) == F.col("ancestor"), "left_semi")


def identity_collisions(existing: DataFrame) -> DataFrame:
    """device, inode, paths for files that several paths name."""
    return existing.groupBy("device", "inode").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths")).where("n > 1")


def resolve(plan: DataFrame, rounds: int = 5) -> DataFrame:
    """plan (relative, output) with final: outputs that clash, by name or as a directory of another one, carry a hash of their source.

    Rounds go on until nothing clashes; a clash among hashed names is an error. plan must be the same each time it is read.
    """
    state = plan.withColumn("hashed", F.lit(False))
    for _ in range(rounds):
        named = state.withColumn("final", F.when(F.col("hashed"), hashed_name(F.col("output"), F.col("relative"))).otherwise(F.col("output"))).withColumn("key", F.lower("final"))
        twice = same_paths(named, "final").select("key", F.lit(True).alias("twice"))
        below = prefixes(named, "final").select(F.col("ancestor").alias("key"), F.lit(True).alias("below"))
        marked = named.join(twice, "key", "left").join(below, "key", "left").withColumn("clash", F.col("twice").isNotNull() | F.col("below").isNotNull())
        counts = marked.agg(F.count_if("clash").alias("clash"), F.count_if(F.col("clash") & ~F.col("hashed")).alias("fresh")).first()
        if not counts.clash:
            return named.select(*plan.columns, "hashed", "final")
        if not counts.fresh:
            break
        state = marked.select(*plan.columns, (F.col("hashed") | F.col("clash")).alias("hashed"))
    raise ValueError("outputs still clash with hashed names")


def unexplained(nodes: DataFrame, edges: DataFrame, explained: DataFrame, reason: str = "unexplained_reference") -> DataFrame:
    """node and reason of nodes that an edge outside explained points to; a node's first reason by name stays."""
    rest = edges.join(explained.select("source", "target"), ["source", "target"], "left_anti")
    hit = rest.groupBy(F.col("target").alias("node")).agg(F.min(F.coalesce(F.col("reason"), F.lit(reason)) if "reason" in edges.columns else F.lit(reason)).alias("reason"))
    return nodes.select("node").join(hit, "node")
