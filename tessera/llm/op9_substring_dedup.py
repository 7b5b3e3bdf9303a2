"""Substring dedup: an FM-index per shard, backward search of streamed documents, repeated word windows removed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import spark as S
from tessera.llm.fm_index import FMIndex
from tessera.llm.windows import Windows, cover

LENGTH, ANCHOR = 13, 5


def matcher(w: Windows, text: np.ndarray, size: np.ndarray, count: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Segments are indexed, then streamed through the index; a window whose range holds a smaller doc_id is a repeat."""
    _, text = np.unique(text, return_inverse=True)
    index = FMIndex(text, size, w.length)
    owner = np.zeros(len(index.sa), np.int64)
    owner[index.where] = np.repeat(doc, size)
    ends = np.ones(len(owner), bool)
    ends[index.where] = False
    owner[ends] = np.iinfo(np.int64).max
    least = np.minimum.reduceat(owner[index.sa], index.narrow[:-1])
    first = np.cumsum(count) - count
    hits = np.zeros(int(count.sum()), bool)
    for runs, back, lo, _ in index.stream(text, size):
        hits[first[runs] + size[runs] - back] = least[index.of_narrow[lo]] < doc[runs]
    return hits


def substring_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_symbols (words), starts, ends, kept: every word under a window of length words whose sequence also starts in a
    document with a smaller doc_id goes. Windows are judged on the input. See windows.cover for nulls, repeats and empty tables."""
    return cover(docs, Windows("words", length, anchor, False), matcher)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return substring_dedup(S.table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_symbols").alias("n_words"), gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
SQL: dict[str, str] = {}
