"""N-gram Jaccard join: prefixes in the order of frequency, documents with the same prefix and size joined as one group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import spark as S
from tessera.llm.graph import components

U = np.uint64
WORDS, PERCENT = 5, 75
_LOW = U(0xFFFF)


def shingles(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each document, document by document in rising order, and how many each has."""
    h, _, _, first = K.words(raw, off, lower=True)
    size = np.diff(first)
    pos = K.spread(first, n - 1)
    parts, docs = [K.grams(h, n)[pos]], [np.repeat(np.arange(len(size)), np.maximum(size - n + 1, 0))]
    for short in range(1, n):  # the whole of a shorter text is one
        own = np.flatnonzero(size == short)
        if len(own):
            parts.append(K.follow(K.grams(h, short)[first[own]], np.full(len(own), short, U)))
            docs.append(own)
    h, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.argsort((doc.astype(U) << U(48)) | (h >> U(16)), kind="stable")
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(size))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Two sets of which one has n tokens share one of their first so many, in any common order, or aren't similar enough."""
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def _fingerprints(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each document's set."""
    a, b = np.zeros(len(size), U), np.zeros(len(size), U)
    full = np.flatnonzero(size)
    if len(full):
        at = (np.cumsum(size) - size)[full]
        a[full] = np.add.reduceat(K.mix(h ^ U(0x8E51)), at)
        b[full] = np.bitwise_xor.reduceat(K.mix(h * U(0xB5)), at)
    return a.view(np.int64), b.view(np.int64)


def _fresh(fa: np.ndarray, fb: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of equal sets the one with the smallest id."""
    order = np.lexsort((ids, size, fb, fa))
    new = np.ones(len(ids), bool)
    new[1:] = (fa[order][1:] != fa[order][:-1]) | (fb[order][1:] != fb[order][:-1]) | (size[order][1:] != size[order][:-1])
    out = np.zeros(len(ids), bool)
    out[order[new]] = True
    return out


def _of_text(words: int) -> Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, shingles and their number for each document of a block."""

    def of(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, raw, off = S.unpack(r)
        return ids, *shingles(raw, off, words)

    return of


def _of_sets(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["hashes"], U), np.frombuffer(r["sizes"], np.int64)


def _tokens(blocks: S.Blocks, sets: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]], shards: int, percent: int, half: bool) -> DataFrame:
    """Tokens that could be in a prefix, dealt by hash; and for each block what it knows of its documents.

    Tokens are ordered by frequency. half: those with a small hash come first, by frequency, then the others by hash, so that
    only one half is counted, but for documents whose prefix is longer than their half. A token is 48 bits of the hash here: a
    clash costs a vain comparison, as pairs are verified on all 64. Of equal sets in a block one is sent.
    """
    schema = [("shard", pa.int32()), ("block", pa.int64()), ("tokens", pa.binary()), ("info", pa.binary())]

    def run(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            ids, h, size = sets(r)
            fa, fb = _fingerprints(h, size)
            sends = _fresh(fa, fb, size, ids)
            doc = np.repeat(np.arange(len(ids)), size)
            first = h >> U(63) == 0 if half else np.ones(len(h), bool)
            counted = np.bincount(doc[first], minlength=len(ids))
            rank = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            want = sends[doc] & (first | (rank < prefix_length(size, percent)[doc]))
            tokens = (h[want] & ~_LOW) | doc[want].astype(U)
            info = np.stack([ids, size, counted, fa, fb, sends.astype(np.int64)])
            shard = ((tokens >> U(16)) % U(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[by], np.arange(shards + 1))
            out = [(s, r["block"], K.blob(tokens[by[a:b]]), None) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield S.batch(schema, [*out, (r["block"] % shards, r["block"], None, K.blob(info))])

    return blocks.map(run, "shard int, block long, tokens binary, info binary")


def _frequent(tokens: DataFrame, shards: int) -> DataFrame:
    """For each block its tokens that other documents have too, with the number of documents."""
    schema = [("block", pa.int64()), ("tokens", pa.binary()), ("freq", pa.binary()), ("info", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for r in S.rows(batches):
            if r["info"] is not None:
                yield S.batch(schema, [(r["block"], None, None, r["info"])])
            else:
                by.setdefault(r["shard"], []).append((r["block"], np.frombuffer(r["tokens"], U)))
        for own in by.values():
            _, inverse, counts = np.unique(np.concatenate([t for _, t in own]) >> U(16), return_inverse=True, return_counts=True)
            counts, at, out = counts.astype(np.uint32)[inverse], 0, []
            for block, t in own:
                c = counts[at : at + len(t)]
                at += len(t)
                if (many := c > 1).any():
                    out.append((block, K.blob(t[many]), K.blob(c[many]), None))
            yield S.batch(schema, out)

    return tokens.repartitionById(shards, "shard").mapInArrow(run, "block long, tokens binary, freq binary, info binary")


def _documents(frequent: DataFrame, percent: int, half: bool) -> DataFrame:
    """doc_id, block, at (place in the block), n, fa, fb; and for documents that could have a partner: prefix tokens and their places, group key."""
    rows = frequent.groupBy("block").agg(F.max("info").alias("info"), F.collect_list(F.when(F.col("tokens").isNotNull(), F.struct("tokens", "freq"))).alias("shared"))
    names = ["doc_id", "block", "at", "n", "fa", "fb", "ga", "gb", "tokens", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in S.rows(batches):
            ids, size, counted, fa, fb, sends = np.frombuffer(r["info"], np.int64).reshape(6, -1)
            t = np.concatenate([np.zeros(0, U), *(np.frombuffer(x["tokens"], U) for x in r["shared"])])
            freq = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x["freq"], np.uint32) for x in r["shared"])])
            doc, tok = (t & _LOW).astype(np.int64), t >> U(16)
            first = tok >> U(47) == 0 if half else np.ones(len(tok), bool)
            freq = np.where(first, freq, 0)
            order = np.lexsort((tok, freq, ~first, doc))
            doc, tok, first = doc[order], tok[order], first[order]
            shared = np.bincount(doc[first], minlength=len(ids))
            alone = counted - shared  # counted tokens that no other document has; they come first
            total = np.bincount(doc, minlength=len(ids))
            rank = np.arange(len(doc)) - np.repeat(np.cumsum(total) - total, total)
            place = np.where(first, alone[doc] + rank, counted[doc])
            length = prefix_length(size, percent)
            keep = ~first | (place < length[doc])
            doc, tok, place = doc[keep], tok[keep], place[keep]
            have = np.bincount(doc, minlength=len(ids))
            at = np.cumsum(have) - have
            # a prefix that others could have as a whole names its group
            whole = (have == length) & (length > 0)
            ga, gb = fa.copy(), fb.copy()
            full = np.flatnonzero(whole)
            if len(full):
                pick = K.ragged(at[full], have[full])
                starts = np.cumsum(have[full]) - have[full]
                ga[full] = np.add.reduceat(K.mix(tok[pick] ^ U(0x51)), starts).view(np.int64)
                gb[full] = np.bitwise_xor.reduceat(K.mix(tok[pick] * U(0x35)), starts).view(np.int64)
            open_ = sends.astype(bool) & (have > 0)
            toks = [K.blob(tok[at[i] : at[i] + have[i]]) if open_[i] else None for i in range(len(ids))]
            places = [K.blob(place[at[i] : at[i] + have[i]].astype(np.int32)) if open_[i] else None for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.full(len(ids), r["block"])), pa.array(np.arange(len(ids), dtype=np.int32)), *map(pa.array, (size, fa, fb, ga, gb)), pa.array(toks, pa.binary()), pa.array(places, pa.binary())], names=names
            )

    return rows.mapInArrow(run, "doc_id long, block long, at int, n long, fa long, fb long, ga long, gb long, tokens binary, places binary")


def _candidates(groups: DataFrame, shards: int, percent: int, chains: bool) -> DataFrame:
    """a, b: pairs of groups that share a token of their prefixes and could be similar enough by sizes and places.

    groups: g, n, label, tokens, places. chains: in a token's list each is compared only with its neighbour and with the one that
    has the fewest tokens of its own; else all pairs with different labels.
    """
    schema = [("shard", pa.int32()), *((x, pa.binary()) for x in ("tokens", "g", "n", "label", "place", "own"))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks = [np.frombuffer(x, U) for x in b.column(3).to_pylist()]
            many = np.array([len(x) for x in toks])
            tok = np.concatenate([np.zeros(0, U), *toks])
            place = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for x in b.column(4).to_pylist())])
            g, n, label = (np.repeat(b.column(i).to_numpy(), many) for i in range(3))
            own = np.repeat(np.array([np.frombuffer(x, np.int32).min() for x in b.column(4).to_pylist()], np.int32), many)  # tokens of its own come first
            shard = (tok % U(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[by], np.arange(shards + 1))
            yield S.batch(schema, [(s, *map(K.blob, (tok[by[x:y]], g[by[x:y]], n[by[x:y]], label[by[x:y]], place[by[x:y]], own[by[x:y]]))) for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x])

    def pairs(tok, g, n, label, place, own) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((g, own, tok) if chains else (g, label, tok))
        tok, g, n, label, place = tok[order], g[order], n[order], label[order], place[order].astype(np.int64)

        def emit(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            need = -(-percent * (n[i] + n[j]) // (100 + percent))
            ok = (label[i] != label[j]) & (g[i] != g[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= need)
            a, b = np.minimum(g[i], g[j])[ok], np.maximum(g[i], g[j])[ok]
            o = np.lexsort((b, a))
            a, b = a[o], b[o]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

        same = tok[1:] == tok[:-1]
        if chains:
            i = np.flatnonzero(same)
            pivot = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(tok)), 0)) if len(tok) else i
            yield emit(np.concatenate([i, pivot[i + 1]]), np.concatenate([i + 1, i + 1]))
            return
        # each is compared with those of its list that have a larger label, so a large component costs nothing by itself
        run = K.changes(tok, label) if len(tok) else np.zeros(0, np.int64)
        size = np.diff(run, append=len(tok))
        after = np.repeat(run + size, size)
        ends = K.changes(tok) if len(tok) else run
        size = np.diff(ends, append=len(tok))
        count = np.repeat(ends + size, size) - after
        step, load, a = 1 << 20, np.cumsum(count), 0
        while a < len(tok):
            b = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + step, "right")))
            yield emit(np.repeat(np.arange(a, b), count[a:b]), K.ragged(after[a:b], count[a:b]))
            a = b

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[dict]] = {}
        for r in S.rows(batches):
            by.setdefault(r["shard"], []).append(r)
        for own in by.values():
            yield from pairs(*(np.concatenate([np.frombuffer(r[c], t) for r in own]) for c, t in (("tokens", U), ("g", np.int64), ("n", np.int64), ("label", np.int64), ("place", np.int32), ("own", np.int32))))

    dealt = groups.select("g", "n", "label", "tokens", "places").mapInArrow(deal, "shard int, tokens binary, g binary, n binary, label binary, place binary, own binary")
    found = dealt.repartitionById(shards, "shard").mapInArrow(meet, "a long, b long")
    return found.distinct()


def _sets(blocks: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """block, ids, sizes, hashes: the whole sets of wanted (block, at), named by their items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in S.rows(batches):
            _, raw, off = S.unpack(r)
            own, ids = np.array(r["at"], np.int64), np.array(r["items"], np.int64)
            size = np.diff(off)[own]
            h, many = shingles(raw[K.ragged(off[own], size)], np.concatenate([[0], np.cumsum(size)]), words)
            yield S.batch([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary())], [(r["block"], K.blob(ids), K.blob(many.astype(np.int64)), K.blob(h))])

    by_block = wanted.groupBy("block").agg(F.collect_list(F.struct("at", "item")).alias("w")).select("block", F.col("w.at").alias("at"), F.col("w.item").alias("items"))
    return by_block.join(blocks, "block", "left").mapInArrow(run, "block long, ids binary, sizes binary, hashes binary")


def _each(sets: DataFrame) -> DataFrame:
    """item, hashes from sets in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in S.rows(batches):
            ids, h, size = _of_sets(r)
            at = np.concatenate([[0], np.cumsum(size)])
            for a in range(0, len(ids), 256):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 256]), pa.array([K.blob(h[at[i] : at[i + 1]]) for i in range(a, min(a + 256, len(ids)))], pa.binary())], names=["item", "hashes"])

    return sets.mapInArrow(run, "item long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = np.zeros(t.num_rows, bool)
            for i, (x, y) in enumerate(zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                out[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            keep = pa.array(out)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], names=["a", "b"])

    side = lambda c: sets.select(F.col("item").alias(c), F.col("hashes").alias(f"{c}_set"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document: links join documents whose sets of shingles are at least percent
    per cent similar; component_id is the smallest doc_id reachable.

    Equal sets are one item. Documents whose prefix holds a token of their own only, and so can't have a partner, drop out before
    whole sets are read. Items with the same prefix and size are one group; pairs of groups that share a token of their
    prefixes are candidates, expanded to items and verified on whole sets. A first round compares only some neighbours in the tokens'
    lists; a last one compares all candidates that aren't in one component yet, so no link between components is missed and a
    large group of near copies doesn't cost a comparison for each pair.
    Words are split at white space, A-Z lower-cased. Null and empty texts have no shingles and no links; rows with a null doc_id
    take no part; rows repeating a doc_id are compared like others, whatever their texts, and each gives a row; other columns are
    left out, whatever their names; an empty table gives no rows.
    """
    blocks = S.blocks(docs.select("doc_id", "text"))
    shards = S.shards(docs)
    found = S.cut(_documents(_frequent(_tokens(blocks, _of_text(words), shards, percent, True), shards), percent, True))
    items = S.cut(found.where("n > 0").groupBy("n", "fa", "fb").agg(F.min(F.struct("doc_id", "block", "at")).alias("home")))
    items = S.cut(items.select("n", "fa", "fb", "home", F.monotonically_increasing_id().alias("item")))
    # those that could have a partner are counted again, among themselves and with all their tokens
    maybe = found.where("tokens is not null").join(items, ["n", "fa", "fb"]).where("block = home.block and at = home.at").select("block", "at", "item")
    sets = S.cut(_sets(blocks.rows, maybe, words))
    again = S.cut(_documents(_frequent(_tokens(S.Blocks(sets), _of_sets, shards, percent, False), shards), percent, False).where("tokens is not null"))
    members = again.withColumnRenamed("doc_id", "item").join(again.groupBy("n", "ga", "gb").agg(F.min("doc_id").alias("g")), ["n", "ga", "gb"])
    own = F.col("item") == F.col("g")
    members = S.cut(members.select("item", "n", "g", F.when(own, F.col("tokens")).alias("tokens"), F.when(own, F.col("places")).alias("places")))
    groups = members.where("tokens is not null").select("g", "n", "tokens", "places")
    # first round: each group is compared with some others of its tokens' lists, members with the first of their group
    pairs = S.cut(_candidates(groups.withColumn("label", F.col("g")), shards, percent, True).unionByName(members.where(~own).select(F.col("g").alias("a"), F.col("item").alias("b"))))
    links = S.cut(_verified(pairs, _each(sets), percent))
    labels = components(links)
    labelled = S.cut(members.select("item", "g").join(labels.withColumnRenamed("v", "item"), "item", "left").select("item", "g", F.coalesce("label", "item").alias("label")))
    # last round: all pairs of groups, and pairs within a group, with members of different components
    spread = labelled.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = groups.join(spread, "g").select("g", "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-F.col("g") - 1).alias("label"), "tokens", "places")
    more = _candidates(mixed, shards, percent, False).unionByName(spread.where("lo < hi").select(F.col("g").alias("a"), F.col("g").alias("b")))
    to = lambda c: labelled.select(F.col("g").alias(c), F.col("item").alias(f"{c}_item"), F.col("label").alias(f"{c}_label"))
    more = more.join(to("a"), "a").join(to("b"), "b").where("a_label <> b_label").select(F.least("a_item", "b_item").alias("a"), F.greatest("a_item", "b_item").alias("b"))
    more = S.cut(more.distinct().join(pairs, ["a", "b"], "left_anti"))
    rest = S.cut(_verified(more, _each(sets), percent))
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))
    named = items.join(labels.withColumnRenamed("v", "item"), "item", "left").select("n", "fa", "fb", "home.doc_id", F.coalesce("label", "item").alias("label"))
    lowest = S.cut(named.groupBy("label").agg(F.min("doc_id").alias("component_id")))  # cut, so that AQE can split a large component in the join
    named = named.join(lowest, "label").select("n", "fa", "fb", "component_id")
    return found.select("doc_id", "n", "fa", "fb").join(named, ["n", "fa", "fb"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(S.table(spark, sf_dir, "documents"))


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
SQL = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2) p
  JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 75 * (nx.n + ny.n - common)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id"""
}
