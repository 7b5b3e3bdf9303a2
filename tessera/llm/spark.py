"""Helpers that all operators of the subpackage use: lineage cuts, partition counts, packed blocks of documents."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import kernels as K

#: Bytes of text in a packed block of documents; a longer document has a block of its own.
BLOCK = 4 << 20
#: Documents in a block, so that a number in the block takes 16 bits.
IN_BLOCK = 1 << 16
BLOCK_SCHEMA = "block long, ids binary, offs binary, z binary"


def hold(spark: SparkSession) -> None:
    """Settings of the session that the operators need, where they aren't set already.

    Batches that go to Python are held to 8 MB: rows here are texts and packed arrays, of which several batches are in a task's
    memory at once. Spark cuts a scan by the number of cores, which changes as executors come and go; the least number of parts is
    held fixed, so that a scan is cut the same way each time it is read.
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20, "spark.sql.files.minPartitionNum": spark.sparkContext.defaultParallelism}
    for key, value in wanted.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


#: Shuffle files go as soon as the query that wrote them has ended, instead of when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in spark.checkpoint.dir (a temporary folder only on a local master where none is set, as in tests)."""
    spark = df.sparkSession
    hold(spark)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-"))
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def free(*dfs: DataFrame) -> None:
    """Deletes the checkpoints that hold dfs, which nothing may read from now on."""
    for df in dfs:
        jvm, rdd = df.sparkSession._jvm, df._jdf.queryExecution().analyzed().rdd()
        if rdd.getCheckpointFile().isDefined():
            path = jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shards(docs: DataFrame, each: int = 32 << 20) -> int:
    """Shards for all texts: as many as shuffle partitions, or one for each so many bytes of text."""
    size = docs.selectExpr("sum(octet_length(cast(text as string))) as n").first().n or 0
    return max(parts(docs.sparkSession), -(-size // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gather(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.Table]:
    """Batches of (doc_id, text) put together or cut to tables of about most bytes of text."""
    held, size, many = [], 0, 0
    for batch in batches:
        sizes = np.diff(K.utf8(batch.column(1))[1])
        at = 0
        while at < batch.num_rows:
            n = max(1 if not held else 0, int(np.searchsorted(np.cumsum(sizes[at:]), most - size, "right")))
            n = min(n, batch.num_rows - at, IN_BLOCK - many)
            if n:
                held.append(batch.slice(at, n))
                size += int(sizes[at : at + n].sum())
                at, many = at + n, many + n
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size, many = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def trim() -> None:
    """Gives memory that arrays have left back to the system; workers live on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def documents(batches: Iterator[pa.RecordBatch], most: int = BLOCK, every: int = 1) -> Iterator[dict]:
    """Blocks of consecutive documents of a task: block, ids, offs, raw and, if there is a third column, tags.

    A block's number is a hash of its place and ids, so a block that came out otherwise would never pass for the same one. Memory
    is trimmed after so many blocks and at the end; what is trimmed has to be mapped again, page by page.
    """
    pid = TaskContext.get().partitionId()
    n = -1
    for n, t in enumerate(gather(batches, most)):
        raw, off = K.utf8(t.column(1))
        ids = K.blob(t.column(0).to_numpy().astype(np.int64))
        name = hashlib.blake2b(K.blob(np.array([pid, n])) + ids + K.blob(off), digest_size=8).digest()
        yield {"block": int.from_bytes(name, "little", signed=True), "ids": ids, "offs": K.blob(off), "raw": raw, "tags": t.column(2).to_pylist() if t.num_columns > 2 else None}
        if (n + 1) % every == 0:
            trim()
    if (n + 1) % every:
        trim()


def _columns(docs: DataFrame, tag: str | None) -> DataFrame:
    """Null text is empty; rows with a null doc_id take no part."""
    hold(docs.sparkSession)
    more = [f"cast({tag} as string) tags"] if tag else []
    return docs.where("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", *more)


def over(docs: DataFrame, run: Callable[[Iterator[dict]], Iterator[pa.RecordBatch]], schema: str, tag: str | None = None, every: int = 1) -> DataFrame:
    """run over the blocks of docs, in the tasks that read them."""
    return _columns(docs, tag).mapInArrow(lambda batches: run(documents(batches, every=every)), schema)


def pack(docs: DataFrame, tag: str | None = None) -> DataFrame:
    """Blocks as rows: ids, offsets and compressed bytes of consecutive documents, and the tag column as an array."""
    schema = [("block", pa.int64()), ("ids", pa.binary()), ("offs", pa.binary()), ("z", pa.binary()), *([("tags", pa.list_(pa.string()))] if tag else [])]

    def run(blocks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3)
        for r in blocks:
            yield batch(schema, [(r["block"], r["ids"], r["offs"], squeeze.compress(K.blob(r["raw"])), r["tags"])])

    return over(docs, run, BLOCK_SCHEMA + ", tags array<string>" * bool(tag), tag)


@dataclass
class Blocks:
    """Blocks that come out the same each time they're read: made anew from docs if that is only a scan, else kept behind a checkpoint (docs is None). every: blocks from one trim of memory to the next."""

    rows: DataFrame
    docs: DataFrame | None = None
    tag: str | None = None
    every: int = 1

    def map(self, run: Callable[[Iterator[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        if self.docs is not None:
            return over(self.docs, run, schema, self.tag, self.every)
        every = self.every
        return self.rows.mapInArrow(lambda batches: run(rows(batches, every)), schema)


def scan_only(df: DataFrame) -> bool:
    """Whether df is a file scan with deterministic projections and filters, so that it comes out the same each time it's read."""

    def fine(p) -> bool:
        return p.nodeName() in ("Project", "Filter", "LogicalRelation", "SubqueryAlias", "Union") and p.deterministic() and all(fine(p.children().apply(i)) for i in range(p.children().size()))

    return fine(df._jdf.queryExecution().optimizedPlan())


def blocks(docs: DataFrame, tag: str | None = None, every: int = 1) -> Blocks:
    if scan_only(docs):
        return Blocks(pack(docs, tag), docs, tag, every)
    return Blocks(cut(pack(docs, tag)), every=every)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a block."""
    off = np.frombuffer(row["offs"] or b"", np.int64)
    if "raw" in row:
        return np.frombuffer(row["ids"], np.int64), row["raw"], off
    if row["z"] is None:
        raise RuntimeError("the input was cut into other blocks when it was read again")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["z"], max_output_size=max(1, int(off[-1]))), np.uint8) if off[-1] else np.zeros(0, np.uint8)
    return np.frombuffer(row["ids"], np.int64), raw, off


def rows(batches: Iterator[pa.RecordBatch], every: int = 1) -> Iterator[dict]:
    """Row by row; for rows that hold packed arrays, so one row is much work. every: batches from one trim of memory to the next."""
    seen = 0
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
        seen += 1
        if seen % every == 0:
            trim()
    if seen % every:
        trim()


def batch(schema: list[tuple[str, pa.DataType]], out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])
