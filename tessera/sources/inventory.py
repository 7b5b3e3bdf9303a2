"""Files as rows: scans, opt-in patterns, selections by name, pilot samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import globs


def scan(spark: SparkSession, root: str, extensions: list[str], fingerprint: bool = True) -> DataFrame:
    """path, relative, size, modified and, if wanted, sha256 of files below root with one of the extensions, in any case. Without the fingerprint no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*(e.lower() for e in extensions))
    relative = F.regexp_replace("path", r"^(?:[a-z0-9]+:)?/*\Q" + root.split(":", 1)[-1].strip("/").replace(r"\E", r"\E\\E\Q") + r"\E/", "")
    out = files.where(wanted).select("path", relative.alias("relative"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("sha256")] if fingerprint else []))
    return out


def ordered(files: DataFrame, path: str = "path") -> DataFrame:
    """Files by their path without regard to case, then by the path."""
    return files.orderBy(F.lower(path), path)


def stable(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths whose size, time or digest differ between two scans, or that only one has."""
    both = first.alias("a").join(second.alias("b"), "path", "full_outer")
    same = F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.modified").eqNullSafe(F.col("b.modified")) & F.col("a.sha256").eqNullSafe(F.col("b.sha256"))
    return both.where(~same).select("path")


def opted_in(files: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """Files that match a pattern, without lock files (names that begin with ~$). No patterns: no files."""
    lock = F.regexp_extract(path, r"([^/]*)$", 1).startswith("~$")
    return files.where(globs.matches_any(F.col(path), globs.normalize_patterns(patterns)) & ~lock)


def select_named(files: DataFrame, names: DataFrame, path: str = "path") -> DataFrame:
    """Files whose path is in names, each once; an error if there is none."""
    chosen = files.join(names.select(path).distinct(), path, "left_semi").dropDuplicates([path])
    if chosen.isEmpty():
        raise ValueError("no file of the selection exists")
    return chosen


def pilot(files: DataFrame, limit: int, random_half: bool = True, seed: int = 0, path: str = "path") -> DataFrame:
    """The limit // 2 largest files, and as many of the rest as are missing, drawn by a seeded hash."""
    largest = files.orderBy(F.desc("size"), path).limit(limit // 2)
    if not random_half:
        return largest
    rest = files.join(largest.select(path), path, "left_anti")
    return largest.unionByName(rest.orderBy(F.xxhash64(path, F.lit(seed)), path).limit(limit - limit // 2))
