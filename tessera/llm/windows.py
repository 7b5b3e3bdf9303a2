"""Windows of a fixed number of symbols (words or bytes) that start earlier in the corpus, found shard by shard.

Windows are dealt out by content. The least hash of the anchors (runs of a few symbols) in a window names its shard, so equal
windows always meet, whatever documents hold them. Windows in a row with the same anchor occurrence are one segment, which is
shipped once. Three passes over packed blocks of documents:

1. anchors: each block sends the hashes of its anchors; shards answer which occur more than once in the corpus. A window whose
   anchor occurs once is unique.
2. segments: those left go to the shards, each content once for a block, with the earliest document that has it; the other
   copies in the block are known to be repeats. Shards look for earlier equal windows with a matcher that the operator gives.
3. cover: blocks take the answers and mark the symbols under repeated windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import spark as S

U = np.uint64
_AT = U((1 << 24) - 1)
#: Symbols that a shard matches at once; segments with the same anchor always stay together.
AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Windows:
    kind: str  # "words" or "bytes"
    length: int
    anchor: int
    #: whether a repeat in the same document counts, or only one in a document with a smaller id
    same_document: bool


@dataclass
class Segments:
    start: np.ndarray  # first symbol in the block
    count: np.ndarray  # windows
    key: np.ndarray  # anchor
    content: np.ndarray  # hash of its symbols
    doc: np.ndarray  # number of the document in the block


def symbols(w: Windows, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Symbols (None: the bytes themselves) and each document's first symbol, one more at the end."""
    if w.kind == "bytes":
        return None, off
    h, _, _, first = K.words(raw, off)
    return h, first


def segments(w: Windows, raw: np.ndarray, h: np.ndarray | None, first: np.ndarray) -> Segments:
    most, found = K.SLICE, []
    for a, b in K.slices(first, most):
        pieces = [(first[a], first[b], first[a : b + 1])]
        if first[b] - first[a] > most:  # one long document, in overlapping pieces
            cuts = range(int(first[a]), int(first[b]) - w.length + 1, most)
            pieces = [(c, min(c + most + w.length - 1, int(first[b])), None) for c in cuts]
        for s, e, firsts in pieces:
            own = h[s:e] if h is not None else K._BYTE[raw[s:e]]
            bounds = np.array([0, e - s]) if firsts is None else firsts - s
            at = K.spread(bounds, w.length - 1)
            if not len(at):
                continue
            pre = K.prefix(own)
            n = len(own) - w.anchor + 1
            i = np.arange(n, dtype=np.int64)
            g = K.ranges(pre, i, i + w.anchor)
            least = K.sliding_min((g & ~_AT) | i.astype(U), w.length - w.anchor + 1)[at]
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(at)))
            start = at[begin]
            key = K.mix(g[(least[begin] & _AT).astype(np.int64)] ^ U(0x5851F42D4C957F2D))
            content = K.ranges(pre, start, start + count + w.length - 1)
            doc = np.full(len(start), a) if firsts is None else np.searchsorted(bounds, start, "right") - 1 + a
            found.append((start + s, count, key, content, doc))
    if not found:
        z = np.zeros(0, np.int64)
        return Segments(z, z, z.astype(U), z.astype(U), z)
    return Segments(*(np.concatenate(x) for x in zip(*found, strict=True)))


def deal(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard and positions of its keys, in the order of keys."""
    shard = (keys >> U(20)) % U(shards)
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(part):
            yield int(shard[part[0]]), part


def first_of(content: np.ndarray, key: np.ndarray, doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each segment the position of the one with the same content whose (doc_id, start) is least."""
    order = np.lexsort((start, doc_id, key, content))
    new = np.ones(len(order), bool)
    new[1:] = (content[order][1:] != content[order][:-1]) | (key[order][1:] != key[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def later(w: Windows, doc_id: np.ndarray, start: np.ndarray, than: np.ndarray) -> np.ndarray:
    """Whether each segment stands later than another one, so that all its windows are repeats."""
    out = doc_id > doc_id[than]
    return out | ((doc_id == doc_id[than]) & (start > start[than])) if w.same_document else out


def _bits(x: np.ndarray) -> bytes:
    return K.blob(np.packbits(x))


def _unbits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)


@dataclass
class Repeated:
    """What a block knows of its segments with repeated anchors."""

    seg: Segments
    doc_id: np.ndarray
    place: np.ndarray  # first symbol in the document
    head: np.ndarray  # position of the earliest segment of the block with the same content
    ships: np.ndarray  # positions of the segments sent to the shards, in order of sending
    shard: list[tuple[int, np.ndarray]]


def repeated(w: Windows, shards: int, seg: Segments, ids: np.ndarray, first: np.ndarray, flags: dict[int, bytes]) -> Repeated:
    keys = np.unique(seg.key)
    known = np.zeros(len(keys), bool)
    for shard, at in deal(keys, shards):
        known[at] = _unbits(flags[shard], len(at))
    sel = known[np.searchsorted(keys, seg.key)]
    seg = Segments(seg.start[sel], seg.count[sel], seg.key[sel], seg.content[sel], seg.doc[sel])
    doc_id, place = ids[seg.doc], seg.start - first[seg.doc]
    head = first_of(seg.content, seg.key, doc_id, place)
    ships = np.flatnonzero(head == np.arange(len(head)))
    return Repeated(seg, doc_id, place, head, ships, [(s, ships[at]) for s, at in deal(seg.key[ships], shards)])


Matcher = Callable[[Windows, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _matched(w: Windows, matcher: Matcher, rows: list[dict]) -> Iterator[tuple[int, bytes]]:
    """Answers of a shard: for each block a bit for each window it sent."""
    cols = {n: [np.frombuffer(r[n], t) for r in rows] for n, t in (("key", U), ("content", U), ("doc", np.int64), ("place", np.int64), ("count", np.int32), ("text", np.uint8 if w.kind == "bytes" else U))}
    sent = [len(x) for x in cols["key"]]
    key, content, doc, place, count, text = (np.concatenate(cols[n]) for n in cols)
    cols.clear()
    count = count.astype(np.int64)
    size = count + w.length - 1
    at = np.cumsum(size) - size
    head = first_of(content, key, doc, place)
    own = np.flatnonzero(head == np.arange(len(head)))
    own = own[np.argsort(key[own], kind="stable")]
    new = np.ones(len(own), bool)
    new[1:] = key[own][1:] != key[own][:-1]
    group = np.cumsum(new) - 1
    several = np.bincount(group, minlength=1)[group] > 1 if len(own) else np.zeros(0, bool)
    own, group = own[several], group[several]
    hit_at = np.cumsum(count) - count
    hits = np.zeros(int(count.sum()), bool)
    a = 0
    while a < len(own):
        load = np.cumsum(size[own[a:]])
        b = a + max(1, int(np.searchsorted(load, AT_ONCE, "right")))
        while b < len(own) and group[b] == group[b - 1]:
            b += 1
        part = own[a:b]
        got = matcher(w, text[K.ragged(at[part], size[part])], size[part], count[part], doc[part], place[part])
        hits[K.ragged(hit_at[part], count[part])] = got
        a = b
    # copies share the fate of the head; those that stand later are repeats as a whole
    copies = np.flatnonzero(head != np.arange(len(head)))
    hits[K.ragged(hit_at[copies], count[copies])] = hits[K.ragged(hit_at[head[copies]], count[copies])]
    whole = copies[later(w, doc, place, head)[copies]]
    hits[K.ragged(hit_at[whole], count[whole])] = True
    done = 0
    for r, n in zip(rows, sent, strict=True):
        b = int(hit_at[done + n - 1] + count[done + n - 1])
        yield r["block"], _bits(hits[int(hit_at[done]) : b])
        done += n


def cover(docs: DataFrame, w: Windows, matcher: Matcher) -> DataFrame:
    """doc_id, n_symbols, starts, ends, kept: for each document the runs of symbols under windows that start earlier in the
    corpus (starts and ends as positions of symbols), and what is left: bytes as they were, or words joined by one space.

    Null text is empty; rows with a null doc_id take no part; rows repeating a doc_id count as the same document; an empty table
    gives no rows.
    """
    blocks = S.blocks(docs.select("doc_id", "text"))
    shards = S.shards(docs)

    def anchors(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        schema = [("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())]
        for r in rows:
            _, raw, off = S.unpack(r)
            h, first = symbols(w, raw, off)
            keys, counts = np.unique(segments(w, raw, h, first).key, return_counts=True)
            yield S.batch(schema, [(s, r["block"], K.blob(keys[at]), _bits(counts[at] > 1)) for s, at in deal(keys, shards)])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(S.rows(batches))
        by: dict[int, list[dict]] = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r)
        for shard, own in by.items():
            keys = [np.frombuffer(r["keys"], U) for r in own]
            u, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            many = np.concatenate([_unbits(r["many"], len(k)) for r, k in zip(own, keys, strict=True)])
            known = (counts > 1)[inverse]
            twice = np.zeros(len(u), bool)
            twice[inverse[many]] = True
            known |= twice[inverse]
            out, at = [], 0
            for r, k in zip(own, keys, strict=True):
                out.append((r["block"], shard, _bits(known[at : at + len(k)])))
                at += len(k)
            yield S.batch([("block", pa.int64()), ("shard", pa.int32()), ("bits", pa.binary())], out)

    flags = blocks.map(anchors, "shard int, block long, keys binary, many binary").repartitionById(shards, "shard").mapInArrow(counted, "block long, shard int, bits binary")
    flags = S.cut(flags.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("flags")))
    known = blocks.rows.join(flags, "block", "left")

    def opened(r: dict) -> tuple:
        ids, raw, off = S.unpack(r)
        h, first = symbols(w, raw, off)
        return ids, raw, off, h, first, repeated(w, shards, segments(w, raw, h, first), ids, first, {f["shard"]: f["bits"] for f in r["flags"] or ()})

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [("shard", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in ("key", "content", "doc", "place", "count", "text"))]
        for r in S.rows(batches):
            _, raw, _, h, _, rep = opened(r)
            out = []
            for shard, at in rep.shard:
                text = (raw if h is None else h)[K.ragged(rep.seg.start[at], rep.seg.count[at] + w.length - 1)]
                out.append((shard, r["block"], *map(K.blob, (rep.seg.key[at], rep.seg.content[at], rep.doc_id[at], rep.place[at], rep.seg.count[at].astype(np.int32), text))))
            if out:
                yield S.batch(schema, out)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[dict]] = {}
        for r in S.rows(batches):
            by.setdefault(r["shard"], []).append(r)
        for shard, rows in by.items():
            yield S.batch([("block", pa.int64()), ("shard", pa.int32()), ("bits", pa.binary())], [(b, shard, x) for b, x in _matched(w, matcher, rows)])
        by.clear()
        S.trim()

    sent = known.mapInArrow(ship, "shard int, block long, key binary, content binary, doc binary, place binary, count binary, text binary")
    hits = sent.repartitionById(shards, "shard").mapInArrow(match, "block long, shard int, bits binary")
    hits = S.cut(hits.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("hits")))

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in S.rows(batches):
            ids, raw, off, h, first, rep = opened(r)
            answers, seg = {x["shard"]: x["bits"] for x in r["hits"] or ()}, rep.seg
            hit_at = np.cumsum(seg.count) - seg.count
            hits = np.zeros(int(seg.count.sum()), bool)
            for shard, at in rep.shard:
                hits[K.ragged(hit_at[at], seg.count[at])] = _unbits(answers[shard], int(seg.count[at].sum()))
            copies = np.flatnonzero(rep.head != np.arange(len(rep.head)))
            hits[K.ragged(hit_at[copies], seg.count[copies])] = hits[K.ragged(hit_at[rep.head[copies]], seg.count[copies])]
            whole = copies[later(w, rep.doc_id, rep.place, rep.head)[copies]]
            hits[K.ragged(hit_at[whole], seg.count[whole])] = True
            begin = K.ragged(seg.start, seg.count)[hits]
            edge = np.zeros(int(first[-1]) + 1, np.int32)
            np.add.at(edge, begin, 1)
            np.subtract.at(edge, begin + w.length, 1)
            gone = np.cumsum(edge[:-1]) > 0
            yield from _left(w, ids, raw, off, first, gone)

    return known.join(hits, "block", "left").mapInArrow(covered, "doc_id long, n_symbols long, starts array<long>, ends array<long>, kept binary")


def _left(w: Windows, ids: np.ndarray, raw: np.ndarray, off: np.ndarray, first: np.ndarray, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for a block's documents, from the mask of symbols to remove."""
    before = np.zeros(len(gone) + 1, bool)
    before[1:] = gone
    inner = first[1:-1]
    before[inner] = False
    after = np.zeros(len(gone) + 1, bool)
    after[:-1] = gone
    after[inner] = False
    starts, ends = np.flatnonzero(gone & ~before[:-1]), np.flatnonzero(gone & ~after[1:]) + 1
    doc = np.searchsorted(first, starts, "right") - 1
    list_off = np.searchsorted(doc, np.arange(len(ids) + 1))
    starts, ends = starts - first[doc], ends - first[doc]
    if w.kind == "bytes":
        keep, text = ~gone, raw
    else:
        _, s, e, _ = K.words(raw, off)
        stay = np.flatnonzero(~gone)
        edge = np.zeros(len(raw) + 1, np.int8)
        edge[s[stay]] += 1
        np.subtract.at(edge, e[stay], 1)
        keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
        owner = np.searchsorted(first, stay, "right") - 1
        gap = s[stay[1:][owner[1:] == owner[:-1]]] - 1
        text = raw.copy()
        text[gap] = 0x20
        keep[gap] = True
    size = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=size[1:])
    bounds, left = size[off], text[keep]
    for a, b in K.slices(bounds, 4 << 20):
        o = (bounds[a : b + 1] - bounds[a]).astype(np.int64)
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(K.blob(o)), pa.py_buffer(K.blob(left[bounds[a] : bounds[b]]))]).cast(pa.binary())
        lo = pa.array((list_off[a : b + 1] - list_off[a]).astype(np.int32))
        part = slice(int(list_off[a]), int(list_off[b]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[a:b]), pa.array(np.diff(first[a : b + 1])), pa.ListArray.from_arrays(lo, pa.array(starts[part])), pa.ListArray.from_arrays(lo, pa.array(ends[part])), kept],
            names=["doc_id", "n_symbols", "starts", "ends", "kept"],
        )
