"""Best-fit packing: a linear grouping scheme plans on the histogram of lengths, then every piece finds its place by its rank."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import spark as S
from tessera.llm.packing import best_plan
from tessera.llm.tokens import default_path, encoder

CAPACITY = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, own_rank long"
_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_pieces(docs: DataFrame, capacity: int, path: str, end_id: int) -> DataFrame:
    """Pieces of at most capacity tokens with their rank among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ranks, end = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist(), np.array([end_id], "<u4").tobytes()
        most = 4 * capacity
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part, out = b.slice(a, 256), []
                for doc, ids in zip(part.column(0).to_pylist(), encoder(path).encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    at, size, k = 0, len(ids) % most or most, 0
                    while at < len(ids):
                        n = size >> 2
                        out.append((doc, k, at >> 2, n, zlib.crc32(ids[at : at + size]), task, ranks[n]))
                        ranks[n] += 1
                        at, size, k = at + size, most, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "own_rank"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0, groups: int = 100) -> DataFrame:
    """Every document's ids and end_id, packed into as few sequences of at most capacity tokens as the plan finds.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Longer documents are cut into pieces of capacity
    tokens, of which the first may be shorter. Null text is empty (one piece, the end token); a null doc_id stays null; repeated
    rows are packed again; an empty table gives no rows. The driver sees the counts by length, capacity rows at most.
    """
    S.hold(docs.sparkSession)
    pieces = S.cut(cut_pieces(docs, capacity, path or default_path(), end_id))
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    slots = best_plan({r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity, groups)
    key = (slots["length"] << 44) | slots["rank_from"]
    shared = docs.sparkSession.sparkContext.broadcast((key, slots["rank_from"], slots["seq"], slots["offset"]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rank_from, seq, offset = shared.value
        for b in batches:
            rank, length = b.column("own_rank").to_numpy() + b.column("base").to_numpy(), b.column("length").to_numpy()
            at = np.searchsorted(key, (length << 44) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq[at] + rank - rank_from[at]), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.join(base, ["task", "length"]).mapInArrow(place, _OUT)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(S.table(spark, sf_dir, "documents"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
SQL: dict[str, str] = {}
