"""Blocks of documents: whole, named by what they hold, the same on each read."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import spark as S
from tessera.llm.graph import components
from tests.llm.util import EDGE, corpus, frame


def test_blocks_hold_everything(spark):
    docs = corpus(40, 9) + EDGE + [(None, "dropped"), (3, "again")]
    got = []
    for r in S.pack(frame(spark, docs), "lang").collect():
        ids, raw, off = S.unpack(r.asDict())
        assert len(r.tags) == len(ids)
        got += [(int(i), bytes(raw[a:b]).decode()) for i, a, b in zip(ids, off[:-1], off[1:], strict=True)]
    assert sorted(got) == sorted((i, t or "") for i, t in docs if i is not None)


def test_gather_cuts_by_size_and_number(monkeypatch):
    monkeypatch.setattr(S, "IN_BLOCK", 5)
    texts = ["x" * n for n in (3, 100, 1, 1, 1, 1, 1, 1, 0, 0, 50, 50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    tables = list(S.gather(iter([batch, batch]), 60))
    assert [i for t in tables for i in t.column(0).to_pylist()] == [*range(len(texts))] * 2
    assert all(t.num_rows <= 5 and (t.num_rows == 1 or sum(map(len, t.column(1).to_pylist())) <= 60) for t in tables)


def test_equal_tables_have_blocks_of_their_own(spark, tmp_path):
    frame(spark, corpus(5)).write.parquet(str(tmp_path / "d"))
    once = spark.read.parquet(str(tmp_path / "d"))
    names = [r.block for r in S.pack(once.unionByName(once)).collect()]
    assert len(set(names)) == len(names)


def test_only_scans_are_read_again(spark, tmp_path):
    frame(spark, corpus(5)).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    again = lambda df: S.blocks(df).docs is not None
    assert again(docs) and again(docs.where("n_chars > 3").withColumn("text", F.upper("text")))
    assert not again(docs.repartition(2)) and not again(docs.dropDuplicates(["doc_id"]))


def test_a_changed_cut_is_an_error():
    with pytest.raises(RuntimeError, match="other blocks"):
        S.unpack({"z": None, "ids": b"", "offs": np.zeros(1, np.int64).tobytes()})


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100 - i, 100) for i in range(5)] + [(7, 7), (300, 200)]
    got = {r.v: r.label for r in components(spark.createDataFrame(chain, "a bigint, b bigint").repartition(6)).collect()}
    want = {i: 0 for i in range(41)} | {i: 96 for i in range(96, 101)} | {200: 200, 300: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
