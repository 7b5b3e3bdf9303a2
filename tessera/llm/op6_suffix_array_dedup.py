"""Suffix-array dedup: byte spans that occur earlier in the corpus are found by prefix doubling, and removed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import spark as S
from tessera.llm.windows import Windows, cover

LENGTH, ANCHOR = 100, 32


def doubled(w: Windows, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rank of the window at each position of the segments, the same for equal windows; -1 where none starts.

    Positions are first ranked by a short prefix; then pairs of ranks at a growing offset are sorted and ranked again, for
    positions whose rank isn't unique yet, until the prefix is as long as a window.
    """
    n, at = len(text), np.cumsum(size) - size
    room = np.repeat(at + size, size) - np.arange(n)  # symbols left in the segment
    h = -(-w.length // 4)
    pre = K.prefix(K._BYTE[text])
    pos = np.flatnonzero(room >= h)
    rank = np.full(n, -1, np.int64)
    rank[pos] = np.unique(K.ranges(pre, pos, pos + h), return_inverse=True)[1]
    while h < w.length:
        longer = min(2 * h, w.length)
        pos = pos[room[pos] >= longer]
        many = np.bincount(rank[pos], minlength=1)
        again = many[rank[pos]] > 1
        open_ = pos[again]
        fresh = np.full(n, -1, np.int64)
        _, inverse = np.unique(rank[open_] * np.int64(n + 1) + rank[open_ + longer - h], return_inverse=True)
        fresh[open_] = inverse
        alone = pos[~again]
        fresh[alone] = np.arange(len(alone)) + (int(inverse.max()) + 1 if len(open_) else 0)
        rank, h = fresh, longer
    return rank


def matcher(w: Windows, text: np.ndarray, size: np.ndarray, count: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    at = np.cumsum(size) - size
    starts = K.ragged(at, count)
    rank = doubled(w, text, size)[starts]
    own, pos = np.repeat(doc, count), K.ragged(place, count)
    again = np.flatnonzero(np.bincount(rank, minlength=1)[rank] > 1)
    order = again[np.lexsort((pos[again], own[again], rank[again]))]
    hits = np.zeros(len(rank), bool)
    if len(order):
        new = np.ones(len(order), bool)
        new[1:] = rank[order][1:] != rank[order][:-1]
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        hits[order] = (own[order] > own[head]) | (pos[order] > pos[head])
    return hits


def suffix_array_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_symbols (bytes), starts, ends, kept: every byte covered by a string of length bytes that also starts earlier
    (smaller doc_id, or earlier in the document) goes. Matches never cross documents; strings are judged on the input. See windows.cover for nulls, repeats and empty tables."""
    return cover(docs, Windows("bytes", length, anchor, True), matcher)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(S.table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_symbols").alias("n_bytes"), (F.col("n_symbols") - F.octet_length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op6_suffix_array_dedup": op6_suffix_array_dedup}
SQL: dict[str, str] = {}
