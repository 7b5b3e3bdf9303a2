"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text gives each document's perplexity, held against quantiles of its language.

The model is trained and applied by joins on shards of count tables:

* trigrams uvw are counted where their context uv belongs, bigrams vw (in how many ways each is preceded) where v does, words
  where they do; so a very frequent word costs its bigrams at most, not its trigrams, in one place.
* P(w | uv) = (c - d) / total + g(uv) * P(w | v), and so on down. A document's log-probability is therefore a sum over its
  n-grams: log P(w) for each word, log g(v) and log g(uv) for each context, and for each n-gram that the model has the step
  log P(w | uv) - log g(uv) - log P(w | v). These steps are the model: a table from n-grams to weights, dealt by hash.
* each block of documents sends its n-grams with the documents that hold them, and shards answer with sums by document. Texts are
  never sent, and nothing is kept by n-gram.

The hash space of n-grams is gone through in PASSES parts, one after the other, so that what is on disk at once is that part of
the corpus's n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import spark as S
from tessera.llm.kernels import loosen, squeeze

U = np.uint64
#: A document is rejected if its perplexity is more than MARGIN times this quantile of the trusted ones of its language.
QUANTILE, MARGIN = 0.99, 1.25
#: So many words of the language's usual perplexity are added to a document's own, as short texts say little.
PRIOR = 30
#: Parts of the hash space that are gone through one after the other, when the model is trained and when it is asked.
TURNS, PASSES = 3, 5
#: Bytes of text for each shard, and in a corpus of few shards, of which there are FEW then at most.
SHARD, SMALL, FEW = 128 << 20, 16 << 20, 64
#: Bytes of the bits that tell which documents are trusted, a bit each; with more documents, trusted texts are joined instead.
MOST_BITS = 32 << 20
#: Trigrams that a task holds while it deals their weights out.
AT_ONCE = 1 << 22
#: Bytes of text whose n-grams are made at once, so that scratch arrays stay in the cache.
RUN = 1 << 18
#: Blocks or batches from one trim of a worker's memory to the next; at each one it took a fifth of the workers' CPU time.
EVERY = 8
#: Weights are whole numbers of 1 / SCALE bit.
SCALE = 1024
#: A word is 48 bits of its hash; an n-gram in a shard of the weights 40 bits, so one in a million absent ones passes for another.
_BOS = U(0x0123456789AB)
UNI, UNI_CONTEXT, BI, BI_CONTEXT, TRI = range(5)


def before(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words u and v before each word in its document."""
    n = len(w)
    v, u = np.full(n, _BOS, U), np.full(n, _BOS, U)
    v[1:], u[2:] = w[:-1], w[:-2]
    begin = first[:-1][np.diff(first) > 0]
    v[begin] = u[begin] = _BOS
    second = first[:-1][np.diff(first) > 1] + 1
    u[second] = _BOS
    return u, v


def words(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each run of documents: its first document, the words, and each document's first word in the run."""
    for a, h, _, _, first in K.word_slices(raw, off, signs=True, most=RUN):
        yield a, h >> U(16), first


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> U(20)) % U(shards)


def _parts(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard and positions of its keys, in the order of keys."""
    shard = _shard(keys, shards).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    order = np.argsort(shard, kind="stable")  # of 16 bits: in linear time
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), order[cuts[s] : cuts[s + 1]]


def _turn(keys: np.ndarray, turns: int) -> np.ndarray:
    """The part of the hash space that each key is in; told by the bits that name it in its shard, too."""
    return (keys >> U(24)).astype(np.uint16) % np.uint16(turns)


def _rows(names: str, *out: tuple) -> pa.RecordBatch:
    """names: part, then binary columns; n: a list of counts."""
    kinds = {"part": pa.int32(), "kind": pa.int32(), "back": pa.int32(), "turn": pa.int32(), "block": pa.int64(), "n": pa.list_(pa.int64()), "tags": pa.list_(pa.string())}
    return S.batch([(x, kinds.get(x, pa.binary())) for x in names.split()], list(out))


def _schema(names: str) -> str:
    kinds = {"part": "int", "kind": "int", "back": "int", "turn": "int", "block": "long", "n": "array<long>", "tags": "array<string>"}
    return ", ".join(f"{x} {kinds.get(x, 'binary')}" for x in names.split())


def _reduce(rows: DataFrame, shards: int, run, names: str, order: tuple[str, ...] = ()) -> DataFrame:
    """run over the rows of each part, one part a task."""
    dealt = rows.repartitionById(shards, "part")
    return (dealt.sortWithinPartitions(*order) if order else dealt).mapInArrow(lambda batches: run(S.rows(batches, EVERY)), _schema(names))


def _joined(rows: list[dict], name: str, rising: bool = False) -> np.ndarray:
    return np.concatenate([loosen(r[name], rising) for r in rows])


def _often(c: np.ndarray) -> list[int]:
    """How many n-grams are seen once, twice, three and four times, how many there are, and the sum of their counts."""
    return [*(int((c == i).sum()) for i in range(1, 5)), len(c), int(c.sum())]


def _summed(rows: DataFrame) -> list[int]:
    return [int(x or 0) for x in rows.agg(*(F.sum(F.col("n")[i]) for i in range(6))).first()]


def _discounts(often: list[int]) -> np.ndarray:
    """Discounts of n-grams seen once, twice and more often."""
    n1, n2, n3, n4 = often[:4]
    if not (n1 and n2 and n3):
        return np.array([0.5, 0.75, 0.9])  # too few to tell
    y = n1 / (n1 + 2 * n2)
    return np.array([min(max(i - (i + 1) * y * b / a, 0.1), float(i)) for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)])


def _sums(c: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the counts from each begin on to the next."""
    return np.add.reduceat(c, begin) if len(begin) else c


def _by_both(v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """An order in which v rises and, of each v, equal u stand together."""
    order, new = K.gathered(v)
    bits = max(1, int(len(new)).bit_length())
    rank = np.repeat(np.arange(len(new), dtype=U), np.diff(new, append=len(order)))
    mine = u[order]
    both = (rank << U(64 - bits)) | (mine >> U(max(0, bits - 16)))  # a word is 48 bits
    again = np.argsort(both)
    both, mine = both[again], mine[again]
    if ((both[1:] == both[:-1]) & (mine[1:] != mine[:-1])).any():  # words that differ only in the bits left off
        return np.lexsort((u, v))
    return order[again]


def _less(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c - d[np.minimum(c, 3).astype(np.int64) - 1]


def _mass(c: np.ndarray, begin: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals of the counts of each context, whose n-grams begin at begin, and the share that discounts leave."""
    total = np.add.reduceat(c.astype(np.int64), begin)
    return total, np.add.reduceat(d[np.minimum(c, 3).astype(np.int64) - 1], begin) / total


def _marked(blocks: S.Blocks, ids: DataFrame) -> tuple[Broadcast, int]:
    """For each block a bit for each of its documents that ids holds, and the bytes of all texts; the caller has checked how many documents there are."""

    def numbered(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            own = np.frombuffer(r["ids"], np.int64)
            size = np.diff(np.frombuffer(r["offs"], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r["block"], np.int64)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own), pa.array(size)], names=["block", "at", "doc_id", "size"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in S.rows(batches, EVERY):
            bits = np.zeros(r["n"], bool)
            bits[r["at"]] = True
            yield S.batch([("block", pa.int64()), ("bits", pa.binary()), ("size", pa.int64())], [(r["block"], K.blob(np.packbits(bits)), r["size"])])

    wanted = ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("chosen")).distinct()
    found = blocks.map(numbered, "block long, at int, doc_id long, size long").join(wanted, "doc_id", "left").groupBy("block").agg(
        F.count("*").cast("int").alias("n"), F.collect_list(F.when(F.col("chosen"), F.col("at"))).alias("at"), F.sum("size").alias("size")
    )
    rows = found.mapInArrow(pack, "block long, bits binary, size long").collect()
    return ids.sparkSession.sparkContext.broadcast({r.block: bytes(r.bits) for r in rows}), sum(r.size for r in rows)


def _part(r: dict, chosen: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a block's chosen documents."""
    _, raw, off = S.unpack(r)
    if r["block"] not in chosen:
        raise RuntimeError("the input was cut into other blocks when it was read again")
    own = np.flatnonzero(np.unpackbits(np.frombuffer(chosen[r["block"]], np.uint8), count=len(off) - 1))
    return np.concatenate([np.zeros(0, np.uint8), *(raw[off[i] : off[i + 1]] for i in own)]), np.concatenate([[0], np.cumsum(np.diff(off)[own])]).astype(np.int64)


def _trigrams(blocks: S.Blocks, shards: int, turn: int, chosen: Broadcast | None) -> DataFrame:
    """Counts of the trigrams uvw whose v falls into this turn, where uv belongs: v (rising), contexts of each, u, trigrams of each, w, c."""

    def deal_out(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            own = []
            for _, w, first in words(*(_part(r, chosen.value) if chosen else S.unpack(r)[1:])):
                u, v = before(w, first)
                mine = np.flatnonzero(_turn(K.mix(v), TURNS) == turn)
                own.append((u[mine], v[mine], w[mine]))
            if not own:
                continue
            u, v, w = (np.concatenate(x) for x in zip(*own, strict=True))
            uv = K.follow(u, v)
            order, new = K.gathered(K.follow(uv, w))
            at, c = order[new], np.diff(new, append=len(order))
            yield _rows("part u v w c", *((s, squeeze(u[at[own]]), squeeze(v[at[own]]), squeeze(w[at[own]]), squeeze(c[own])) for s, own in _parts(uv[at], shards)))

    def count(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        if rows := list(rows):
            u, v, w, c = (_joined(rows, x) for x in "uvwc")
            rows.clear()
            order, new = K.gathered(K.follow(K.follow(u, v), w))
            at, c = order[new], _sums(c[order], new)
            order = _by_both(v[at], u[at])
            u, v, w, c = u[at[order]], v[at[order]], w[at[order]], c[order]
            uv = K.changes(v, u)
            vs = K.changes(v[uv])
            yield _rows("v nv u nu w c n", (squeeze(v[uv][vs], True), squeeze(np.diff(vs, append=len(uv))), squeeze(u[uv]), squeeze(np.diff(uv, append=len(w))), squeeze(w), squeeze(c), _often(c)))

    return _reduce(blocks.map(deal_out, _schema("part u v w c")), shards, count, "v nv u nu w c n")


def _opened(r: dict) -> tuple[np.ndarray, ...]:
    """v and u of each context, where its trigrams begin and how many there are, w and c of each trigram."""
    many = loosen(r["nu"]).astype(np.int64)
    return np.repeat(loosen(r["v"], True), loosen(r["nv"]).astype(np.int64)), loosen(r["u"]), np.cumsum(many) - many, many, loosen(r["w"]), loosen(r["c"])


def _bigrams(trigrams: DataFrame, shards: int) -> DataFrame:
    """In how many ways each bigram is preceded, where v belongs: v (rising), bigrams of each, w, c."""

    def deal_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in S.rows(batches, EVERY):
            v, _, _, many, w, _ = _opened(r)
            v = np.repeat(v, many)
            order, new = K.gathered(K.follow(v, w))
            at, c = order[new], np.diff(new, append=len(order))
            at, c = at[order := np.argsort(v[at])], c[order]
            yield _rows("part v w c", *((s, squeeze(v[at[own]], True), squeeze(w[at[own]]), squeeze(c[own])) for s, own in _parts(K.mix(v[at]), shards)))

    def count(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        part, u, v, w, c = 0, [], [], [], []
        for r in rows:
            part = r["part"]
            for x, name in ((v, "v"), (w, "w"), (c, "c")):
                x.append(loosen(r[name], name == "v"))
        if v:
            v, w, c = map(np.concatenate, (v, w, c))
            order, new = K.gathered(K.follow(v, w))
            at, c = order[new], _sums(c[order], new)
            order = np.argsort(v[at])
            v, w, c = v[at[order]], w[at[order]], c[order]
            vs = K.changes(v)
            yield _rows("part v nv w c n", (part, squeeze(v[vs], True), squeeze(np.diff(vs, append=len(v))), squeeze(w), squeeze(c), _often(c)))

    return _reduce(trigrams.mapInArrow(deal_out, _schema("part v w c")), shards, count, "part v nv w c n")


def _words(bigrams: DataFrame, shards: int) -> DataFrame:
    """In how many ways each word is preceded."""

    def deal_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in S.rows(batches, EVERY):
            w, c = np.unique(loosen(r["w"]), return_counts=True)
            yield _rows("part w c", *((s, squeeze(w[at], True), squeeze(c[at])) for s, at in _parts(K.mix(w), shards)))

    def count(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        if rows := list(rows):
            w = _joined(rows, "w", True)
            order, new = K.gathered(w)
            c = _sums(_joined(rows, "c")[order], new)
            yield _rows("part w c n", (rows[0]["part"], squeeze(w[order[new]], True), squeeze(c), _often(c)))

    return _reduce(bigrams.mapInArrow(deal_out, _schema("part w c")), shards, count, "part w c n")


_PROBABLE = "part turn v nv w low p left"


def _probable(bigrams: DataFrame, single: DataFrame, shards: int, p1, d2: np.ndarray) -> DataFrame:
    """The rows of bigrams, with P(w) and P(w | v) of each bigram and the share that v leaves, as negative logarithms in 1 / SCALE bit: words ask for their probability where they belong."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in S.rows(batches, EVERY):
            w = np.unique(loosen(r["w"]))
            yield _rows("part back w p", *((s, r["part"], squeeze(w[at], True), None) for s, at in _parts(K.mix(w), shards)))

    def answer(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        w = p = None
        for r in rows:  # the table comes first
            if r["back"] < 0:
                w, p = loosen(r["w"], True), p1(loosen(r["p"]))
            else:
                yield _rows("part back w p", (r["back"], r["part"], r["w"], K.blob(p[np.searchsorted(w, loosen(r["w"], True))].astype(np.float32))))

    def merge(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        own, w, p = None, [], []
        for r in rows:
            if r["back"] is None:
                own = r
            else:
                w.append(loosen(r["w"], True))
                p.append(np.frombuffer(r["p"], np.float32))
        if own:
            w, p, mine = np.concatenate(w), np.concatenate(p), loosen(own["w"])
            order = np.argsort(w)
            low = p[order][K.find(w[order], mine)].astype(float)
            many = loosen(own["nv"]).astype(np.int64)
            c, begin = loosen(own["c"]), np.cumsum(many) - many
            total, left = _mass(c, begin, d2)
            p2 = _less(c, d2) / np.repeat(total, many) + np.repeat(left, many) * low
            turns = _turn(K.mix(loosen(own["v"], True)), TURNS)
            for turn in range(TURNS):
                vs = turns == turn
                bi = np.repeat(vs, many)
                yield _rows(_PROBABLE, (own["part"], turn, squeeze(loosen(own["v"], True)[vs], True), squeeze(many[vs]), squeeze(loosen(own["w"])[bi]), *(squeeze(_bits(-np.log2(x))) for x in (low[bi], p2[bi], left[vs]))))

    table = single.select("part", F.lit(-1).alias("back"), "w", F.col("c").alias("p"))
    answers = _reduce(bigrams.mapInArrow(ask, _schema("part back w p")).unionByName(table), shards, answer, "part back w p", ("back",))
    both = answers.unionByName(bigrams.select("part", "v", "nv", "w", "c"), allowMissingColumns=True)
    return _reduce(both, shards, merge, _PROBABLE)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.rint(np.maximum(x, 0) * SCALE).astype(U)


def _dealt(kind: int, keys: np.ndarray, bits: np.ndarray, shards: int) -> Iterator[tuple]:
    """Weights of n-grams, dealt to their shards; those of 0 need none."""
    keys, bits = keys[some := bits > 0], bits[some]
    order = np.argsort(keys)
    keys, bits = keys[order], bits[order]
    for s, at in _parts(keys, shards):
        yield s, kind, squeeze(keys[at] >> U(24), True), squeeze(bits[at])


_WEIGHTS, _TABLE = "part kind keys bits", "part turn kind keys bits"


def _gather(rows: DataFrame, shards: int) -> DataFrame:
    """Weights of a shard, one row for each turn and kind of n-gram."""

    def run(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[dict]] = {}
        part = 0
        for r in rows:
            part = r["part"]
            by.setdefault(r["kind"], []).append(r)
        for kind, own in by.items():
            keys, bits = _joined(own, "keys", True), _joined(own, "bits")
            order = np.argsort(keys)
            keys, bits = keys[order], bits[order]
            turns = keys.astype(np.uint16) % np.uint16(PASSES)
            for turn in range(PASSES):
                yield _rows(_TABLE, (part, turn, kind, squeeze(keys[mine := turns == turn], True), squeeze(bits[mine])))

    return _reduce(rows, shards, run, _TABLE)


def _low_weights(probable: DataFrame, single: DataFrame, shards: int, p1, unseen: float) -> DataFrame:
    """Weights of words and bigrams, and of words as contexts."""

    def of_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in S.rows(batches, EVERY):
            v, many = loosen(r["v"], True), loosen(r["nv"]).astype(np.int64)
            low, p, left = (loosen(r[x]).astype(np.int64) for x in ("low", "p", "left"))
            step = np.maximum(low + np.repeat(left, many) - p, 0)
            yield _rows(_WEIGHTS, *_dealt(UNI_CONTEXT, K.mix(v), left, shards), *_dealt(BI, K.follow(np.repeat(v, many), loosen(r["w"])), step, shards))

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in S.rows(batches, EVERY):
            yield _rows(_WEIGHTS, *_dealt(UNI, K.mix(loosen(r["w"], True)), _bits(np.log2(p1(loosen(r["c"]))) - np.log2(unseen)), shards))

    return _gather(probable.mapInArrow(of_bigrams, _schema(_WEIGHTS)).unionByName(single.mapInArrow(of_words, _schema(_WEIGHTS))), shards)


def _high_weights(trigrams: DataFrame, probable: DataFrame, shards: int, turn: int, d3: np.ndarray) -> DataFrame:
    """Weights of trigrams, and of bigrams as contexts, of the trigrams of this turn: they go to where v belongs and stream past its bigrams."""
    names = "part back v nv u nu w c p"

    def deal_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in S.rows(batches, EVERY):
            v, many = loosen(r["v"], True), loosen(r["nv"]).astype(np.int64)
            u, size, w, c = loosen(r["u"]), loosen(r["nu"]).astype(np.int64), loosen(r["w"]), loosen(r["c"])
            at, begin = np.cumsum(many) - many, np.cumsum(size) - size
            out = []
            for s, own in _parts(K.mix(v), shards):
                uv = K.ragged(at[own], many[own])
                tri = K.ragged(begin[uv], size[uv])
                out.append((s, 1, squeeze(v[own], True), squeeze(many[own]), squeeze(u[uv]), squeeze(size[uv]), squeeze(w[tri]), squeeze(c[tri]), None))
            yield _rows(names, *out)

    def weigh(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        keys = p2 = None
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                uv, left, tri, step = (np.concatenate(x) for x in zip(*held, strict=True))
                yield _rows(_WEIGHTS, *_dealt(BI_CONTEXT, uv, left, shards), *_dealt(TRI, tri, step, shards))
                held, size = [], 0

        for r in rows:  # the bigrams come first
            if not r["back"]:
                keys = K.follow(np.repeat(loosen(r["v"], True), loosen(r["nv"]).astype(np.int64)), loosen(r["w"]))
                order = np.argsort(keys)
                keys, p2 = keys[order], np.exp2(loosen(r["p"])[order].astype(float) / -SCALE)
                continue
            v, u, begin, many, w, c = _opened(r)
            total, left = _mass(c, begin, d3)
            low = p2[K.find(keys, K.follow(np.repeat(v, many), w))]
            p = _less(c, d3) / np.repeat(total, many) + np.repeat(left, many) * low
            uv = K.follow(u, v)
            held.append((uv, _bits(-np.log2(left)), K.follow(np.repeat(uv, many), w), _bits(np.log2(p) - np.log2(low) - np.repeat(np.log2(left), many))))
            size += len(w)
            if size > AT_ONCE:  # a very frequent v goes on in parts
                yield from flush()
        yield from flush()

    table = probable.where(F.col("turn") == turn).select("part", F.lit(0).alias("back"), "v", "nv", "w", "p")
    both = trigrams.mapInArrow(deal_out, _schema(names)).unionByName(table, allowMissingColumns=True)
    return _gather(_reduce(both, shards, weigh, _WEIGHTS, ("back",)), shards)


@dataclass
class Model:
    """Weights of n-grams in shards, how many bigrams there are, and an unseen word's probability."""

    weights: DataFrame
    shards: int
    total: int
    unseen: float


def train(trusted: DataFrame | S.Blocks, chosen: Broadcast | None = None, shards: int | None = None) -> Model:
    """An interpolated modified Kneser-Ney model of trigrams, of all documents or those that are marked as chosen; lower orders count how many different words stand before."""
    blocks = trusted if isinstance(trusted, S.Blocks) else S.blocks(trusted, every=EVERY)
    shards = shards or S.parts(blocks.rows.sparkSession)
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    counted = [S.cut(_trigrams(blocks, shards, i, chosen)) for i in range(TURNS)]
    trigrams = union(counted)
    bigrams = S.cut(_bigrams(trigrams, shards))
    single = S.cut(_words(bigrams, shards))
    often = _summed(single)
    d1, d2, d3 = _discounts(often), _discounts(_summed(bigrams)), _discounts(_summed(trigrams))
    left = d1 @ [often[0], often[1], often[4] - often[0] - often[1]] / often[5] if often[5] else 1.0
    unseen = float(left) / (often[4] + 1)
    p1 = lambda c: _less(c, d1) / often[5] + unseen
    probable = S.cut(_probable(bigrams, single, shards, p1, d2))
    S.free(bigrams)
    weights = [S.cut(_low_weights(probable, single, shards, p1, unseen))]
    for i, own in enumerate(counted):
        weights.append(S.cut(_high_weights(own, probable, shards, i, d3)))
        S.free(own)
    S.free(single, probable)
    return Model(union(weights), shards, often[5], unseen)


def _asked(raw: np.ndarray, off: np.ndarray, turn: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """How many words each document has, and keys and documents of the n-grams of this turn: words, bigrams, trigrams.

    A document's number is doubled, and one more for the n-gram that ends it and so is no context. Each word and bigram counts as
    predicted and as a context; the start is added as a context that nothing predicts.
    """
    bos = np.array([_BOS])
    start, pair = K.mix(bos), K.follow(bos, bos)
    size, by = [np.zeros(0, np.int64)], [([np.zeros(0, U)], [np.zeros(0, U)]) for _ in range(3)]

    def take(kind: int, keys: np.ndarray, docs: np.ndarray) -> None:
        mine = np.flatnonzero(_turn(keys, PASSES) == turn)
        by[kind][0].append(keys[mine])
        by[kind][1].append(docs[mine])

    for a, w, first in words(raw, off):
        many = np.diff(first)
        size.append(many)
        some = np.flatnonzero(many)
        begin = first[:-1][some]
        doc = np.repeat(np.arange(2 * a, 2 * (a + len(many)), 2, dtype=U), many)
        v = np.empty_like(w)
        v[1:], v[begin] = w[:-1], _BOS
        vw = K.follow(v, w)
        uv = v
        uv[1:], uv[begin] = vw[:-1], pair  # the bigram before is the context of the next trigram
        take(TRIGRAMS, K.follow(uv, w), doc)
        doc[first[1:][some] - 1] += U(1)
        take(BIGRAMS, vw, doc)
        take(WORDS, K.mix(w), doc)
    some = np.flatnonzero(np.concatenate(size))
    for kind, key in ((WORDS, start), (BIGRAMS, pair)):
        take(kind, np.repeat(key, len(some)), (2 * some).astype(U))
    return np.concatenate(size), [(np.concatenate(keys), np.concatenate(docs)) for keys, docs in by]


def _questions(grams: list[tuple[np.ndarray, np.ndarray]], most: int, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each shard the names of its n-grams (kind and 40 bits, rising), their documents (numbers below most), how many documents each has, and how often it occurs in each.

    Shard, name and document are sorted as one number; where that has more than 64 bits, shards are taken in groups.
    """
    keys, docs = (np.concatenate(x) for x in zip(*grams, strict=True))
    shard, below = _shard(keys, shards), U(max(1, (most - 1).bit_length()))
    names = _names(keys >> U(24), np.repeat(np.arange(len(grams)), [len(x) for x, _ in grams]))
    room = 1 << (22 - int(below))
    for group in range(0, shards, room):
        own = slice(None) if shards <= room else np.flatnonzero((shard >= group) & (shard < group + room))
        both = ((((shard[own] - U(group)) << U(42)) | names[own]) << below) | docs[own]
        both.sort()
        new = K.changes(both)
        if not len(new):
            continue
        times, both = np.diff(new, append=len(both)), both[new]
        wanted, documents = both >> below, both & ((U(1) << below) - U(1))
        first = K.changes(wanted)
        many, wanted = np.diff(first, append=len(wanted)), wanted[first]
        first = np.append(first, len(documents))
        parts = wanted >> U(42)
        wanted &= U((1 << 42) - 1)
        cuts = np.append(K.changes(parts), len(parts))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield group + int(parts[a]), wanted[a:b], documents[first[a] : first[b]], many[a:b], times[first[a] : first[b]]


def _names(keys: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return keys | (np.asarray(kind).astype(U) << U(40))


class Table:
    """Weights of n-grams by name (rising), found by the place that a name's first bits point to: hashes are even, so a few steps from there at most."""

    def __init__(self, names: np.ndarray, bits: np.ndarray) -> None:
        self.shift = U(max(0, 40 - len(names).bit_length()))
        begin = np.cumsum(np.bincount((names >> self.shift).astype(np.int64), minlength=4 << (40 - int(self.shift))))
        self.begin = np.concatenate([[0], begin])
        self.names, self.bits = np.append(names, U(1 << 42)), np.append(bits.astype(np.int64), 0)

    def get(self, names: np.ndarray) -> np.ndarray:
        """The weight of each name, 0 if there is none."""
        at = self.begin[names >> self.shift]
        late = np.flatnonzero(self.names[at] < names)
        while len(late):
            at[late] += 1
            late = late[self.names[at[late]] < names[late]]
        return np.where(self.names[at] == names, self.bits[at], 0)


WORDS, BIGRAMS, TRIGRAMS = range(3)
#: Kinds of weights of n-grams as predicted, and as contexts, with the kind of n-gram.
_PREDICTED, _CONTEXTS = {UNI: WORDS, BI: BIGRAMS, TRI: TRIGRAMS}, {UNI_CONTEXT: WORDS, BI_CONTEXT: BIGRAMS}
#: Rows of kind -1 hold what is known of a block's documents.
_ASKS, _ANSWERS = "part kind block keys docs n many times ids tags size", "block sums ids tags size"


def _scored(blocks: S.Blocks, model: Model, turn: int) -> DataFrame:
    """block, sums: for each document the weights of its n-grams of this turn; and in the first turn ids, tags, size: its id, tag and number of words."""
    shards = model.shards

    def ask(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            ids, raw, off = S.unpack(r)
            size, grams = _asked(raw, off, turn)
            if not turn:
                yield _rows(_ASKS, (r["block"] % shards, -1, r["block"], None, None, None, None, None, K.blob(ids), r["tags"], K.blob(size)))
            if out := [(s, 0, r["block"], squeeze(names, True), squeeze(docs), [len(size)], squeeze(many), squeeze(times), None, None, None) for s, names, docs, many, times in _questions(grams, 2 * len(size), shards)]:
                yield _rows(_ASKS, *out)

    def answer(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        predicted = contexts = None
        held: dict[int, list[dict]] = {}

        def table(kinds: dict[int, int]) -> Table:
            names = np.concatenate([np.zeros(0, U), *(_names(loosen(r["keys"], True), gram) for kind, gram in kinds.items() for r in held.get(kind, ()))])
            bits = np.concatenate([np.zeros(0, U), *(loosen(r["docs"]) for kind in kinds for r in held.get(kind, ()))])
            order = np.argsort(names, kind="stable")  # a few rising runs, which are merged
            return Table(names[order], bits[order])

        for r in rows:
            if r["block"] is None:  # the weights come first
                held.setdefault(r["kind"], []).append(r)
                continue
            if r["kind"] < 0:
                yield _rows(_ANSWERS, (r["block"], None, r["ids"], r["tags"], r["size"]))
                continue
            if predicted is None:
                predicted, contexts = table(_PREDICTED), table(_CONTEXTS)
                held.clear()
            names, docs, many = loosen(r["keys"], True), loosen(r["docs"]).astype(np.int64), loosen(r["many"]).astype(np.int64)
            found = np.repeat(predicted.get(names), many)
            low = int(np.searchsorted(names, U(TRIGRAMS << 40)))
            left = np.repeat(contexts.get(names[:low]), many[:low])
            found[: len(left)] -= left * (1 - (docs[: len(left)] & 1))
            if found.any():
                sums = np.bincount(docs >> 1, found * loosen(r["times"]).astype(np.int64), r["n"][0]).astype(np.int64)
                yield _rows(_ANSWERS, (r["block"], squeeze((sums << 1) ^ (sums >> 63)), None, None, None))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, np.ndarray] = {}
        for r in S.rows(batches, EVERY):
            if r["sums"] is None:
                yield _rows(_ANSWERS, (r["block"], None, r["ids"], r["tags"], r["size"]))
            else:
                z = loosen(r["sums"]).astype(np.int64)
                by[r["block"]] = by.get(r["block"], 0) + ((z >> 1) ^ -(z & 1))
        for block, sums in by.items():
            yield _rows(_ANSWERS, (block, K.blob(sums), None, None, None))

    parts = S.parts(model.weights.sparkSession)
    mine = model.weights.where(F.col("turn") == turn).select("part", "kind", F.lit(None).cast("long").alias("block"), "keys", F.col("bits").alias("docs")).coalesce(parts)
    asked = blocks.map(ask, _schema(_ASKS)).unionByName(mine, allowMissingColumns=True)
    answers = _reduce(asked, shards, answer, _ANSWERS, ("block",))  # nulls first
    return answers.repartition(parts, "block").mapInArrow(add, _schema(_ANSWERS))


def perplexity(docs: DataFrame | S.Blocks, model: Model, tag: str = "lang") -> DataFrame:
    """doc_id, tag, n_words, bits: length and negative log2 probability of every document.

    Weights are rounded to 1 / SCALE bit, so bits are off by at most 4 / SCALE a word; 40 bits of a hash name an n-gram in its
    shard, so about one in a million that the model lacks is taken for one that it has.
    """
    blocks = docs if isinstance(docs, S.Blocks) else S.blocks(docs.select("doc_id", "text", tag), tag, EVERY)

    per_word = -np.log2(model.unseen)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in S.rows(batches, EVERY):
            if r["ids"] is None:
                raise RuntimeError("the input was cut into other blocks when it was read again")
            size = np.frombuffer(r["size"], np.int64)
            sums = sum((np.frombuffer(x, np.int64) for x in r["sums"] or ()), np.zeros(len(size), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["ids"], np.int64)), pa.array(r["tags"], pa.string()), pa.array(size), pa.array(size * per_word - sums / SCALE)], names=["doc_id", "tag", "n_words", "bits"])

    scored = reduce(DataFrame.unionByName, [S.cut(_scored(blocks, model, i)) for i in range(PASSES)])
    known = scored.groupBy("block").agg(*(F.any_value(x, True).alias(x) for x in ("ids", "tags", "size")), F.collect_list("sums").alias("sums"))  # PASSES rows a block
    return S.cut(known.mapInArrow(score, "doc_id long, tag string, n_words long, bits double"))


def quality_classifier(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, prior: float = PRIOR) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, keep for every document.

    trusted: doc_id of documents whose text is trusted. Those whose hash three divides are held out, all others train one model.
    All held-out documents of a language give its median and quantile, counted by values of four decimals, which bounds what a
    task holds; a language without any takes those of all. Perplexity is by word, with prior words of the language's median.
    Null and empty texts have no words: perplexity is null, keep is false. Rows with a null doc_id take no part; a null lang is a
    language, and an empty one is taken as null; repeated rows are judged each; without trusted text nothing can be judged and
    all documents with words stay. Other columns are left out, whatever their names. An empty table gives no rows.
    """
    ids, held_out = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    named = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    blocks = S.blocks(named, "lang", EVERY)
    learnt = ids.where(~held_out)
    shards = lambda size: max(1, -(-(size or 0) // SHARD), min(FEW, -(-(size or 0) // SMALL)))
    if docs.count() <= 8 * MOST_BITS:
        chosen, size = _marked(blocks, learnt)
        model = train(blocks, chosen, shards(size))
    else:  # a bit for each document is too much for every task
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0]
        model = train(named.join(learnt, "doc_id", "left_semi"), None, shards(size))
    scored = perplexity(blocks, model).withColumnRenamed("tag", "lang")
    held = scored.join(ids.where(held_out), "doc_id", "left_semi")
    held = held.where("n_words > 0").withColumn("each", F.round(F.col("bits") / F.col("n_words"), 4))
    usual = held.groupBy("lang").agg(F.median("each").alias("usual"))
    every = F.median("each").alias("usual")
    all_usual = held.agg(every).first().usual
    shrunk = lambda usual: (F.col("bits") + prior * usual) / (F.col("n_words") + prior)
    limits = held.join(usual, "lang").withColumn("shrunk", F.round(shrunk(F.col("usual")), 4))
    all_limit = limits.agg(F.percentile("shrunk", F.lit(quantile)).alias("q")).first().q
    limits = S.cut(limits.groupBy("lang", "usual").agg(F.percentile("shrunk", F.lit(quantile)).alias("q")))  # a row a language of the sample
    out = scored.join(F.broadcast(limits), "lang", "left")
    value = F.pow(F.lit(2.0), shrunk(F.coalesce("usual", F.lit(all_usual))))
    limit = F.pow(F.lit(2.0), F.coalesce("q", F.lit(all_limit))) * margin
    return out.select(
        "doc_id", F.nullif("lang", F.lit("")).alias("lang"), "n_words", F.when(F.col("n_words") > 0, value).alias("perplexity"), limit.alias("threshold"),
        F.when(F.col("n_words") == 0, False).otherwise(F.coalesce(value <= limit, F.lit(True))).alias("keep"),
    )


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(S.table(spark, sf_dir, "documents"), trusted_documents(spark, sf_dir))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
SQL: dict[str, str] = {}
