"""Connected components over edges; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import spark as S


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges and the smallest node that each reaches over them; roots themselves are left out."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        left = root[x] != root[y]
        x, y = x[left], y[left]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def components(edges: DataFrame) -> DataFrame:
    """v, label for each node of edges (a, b): the smallest node that it can reach. An empty table gives no rows.

    Each task contracts its own edges; where tasks disagree on a node's root, the roots are edges of the next round; then each
    node moves on to its root's root, until nothing changes.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            v, r = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(r)], names=["v", "r"])

    todo = edges.where("a <> b").select(F.col("a").alias("v"), F.col("b").alias("r"))
    while True:
        # a node has at most as many roots as there are tasks
        roots = todo.mapInArrow(contract, "v long, r long").groupBy("v").agg(F.collect_set("r").alias("rs")).withColumn("m", F.array_min("rs"))
        pairs = F.concat(F.array(F.struct("v", F.col("m").alias("r"), F.lit(False).alias("open"))), F.transform(F.array_except("rs", F.array("m")), lambda r: F.struct(r.alias("v"), F.col("m").alias("r"), F.lit(True).alias("open"))))
        stars = S.cut(roots.select(F.explode(pairs).alias("p")).select("p.*"))
        up = stars.groupBy(F.col("v").alias("r")).agg(F.min("r").alias("higher"))
        moved = S.cut(stars.join(up, "r", "left").select("v", F.coalesce("higher", "r").alias("r"), (F.col("open") | F.col("higher").isNotNull()).alias("open")))
        todo = moved.select("v", "r")
        if moved.where("open").isEmpty():
            break
    tops = moved.select(F.col("r").alias("v"), F.col("r").alias("label")).distinct()
    return moved.select("v", F.col("r").alias("label")).unionByName(tops)
