"""Near duplicates by b-bit MinHash.

A document's shingles are its runs of ``SHINGLE`` tokens (see ``textkit``). Of ``HASHES`` random hash functions each keeps the
smallest value over all shingles. ``ROWS`` minima at a time make a band key; documents that share a key are candidates. Of each
minimum the lowest four bits are retained and packed into ten 64-bit words; two documents' similarity is estimated from the number
of equal fields, counted with ``bit_count`` and corrected for the 1 in 16 fields that agree by chance.

Documents with the same minima are one node of the search, so thousands of exact copies cost one comparison each. In a band, all
nodes are compared with the band's smallest; those that match it are connected through it, and those that don't are compared with
every member where there are at most ``SMALL``. So the components are those of all candidate pairs, though a band of m copies needs m
comparisons and not m * m. A band's smallest node and size are grouped sums, made before anything is shuffled. Nothing is capped.
With 40 bands of 4 rows a pair of similarity 0.5 is a candidate with a probability of 0.92, one of 0.6 with 0.996.

Larger bands, as those of a passage that very many documents share, are split by a prefix filter: two nodes that agree in enough fields have at
least ``need`` minima in common, so with the minima of each in one order, by how many nodes have them, both share one among the first
``HASHES - need + 1``. Nodes that share such a minimum are a group, which is treated as a band is; what a passage gives to
all of them is frequent and comes last. ``need`` allows for ``SLACK`` fields that agree by chance, more than which two unlike
texts have once in a million. Groups whose nodes are connected by then have nothing left to compare.

Defined results: a null text is an empty one; a text with fewer tokens than a shingle is one shingle, and one without tokens is
known by its bytes, so that empty texts are copies of each other; rows are known by doc_id and text, so that different texts that share a
doc_id are judged each on its own, and rows alike in both are copies; of a group the row with the smallest doc_id stays, one without
doc_id only if the whole group has none, and of those that tie the one whose text hashes lowest; ``near_duplicates`` names no row
without doc_id and none that stays under its own; an empty table gives none; a very long text is hashed in blocks, whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, fresh, sized
from graphloom.llm.textkit import Hasher, chunks, grams, mix
from graphloom.session import stored

SHINGLE = 3
ROWS, BANDS = 4, 40
HASHES = ROWS * BANDS
BITS = 4
WORDS = HASHES * BITS // 64
THRESHOLD = 0.5
BLOCK = 8192
LOW = 0x1111111111111111
SMALL, SLACK = 64, 21

WORD_COLUMNS = [f"s{i}" for i in range(WORDS)]


def _constants() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return seeds | np.uint64(1), mix(seeds + np.uint64(1))


def minima(h: np.ndarray, at: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """The minima (documents x HASHES). h, at: the documents' tokens; raw: their texts, for those without any."""
    odd, flip = _constants()
    g, begin = grams(h, at, SHINGLE)
    first = np.searchsorted(begin, at)
    n = np.diff(first)
    few = np.flatnonzero(n == 0)
    if len(few):  # one shingle for each of these
        own = np.empty(len(few), np.uint64)
        for i, d in enumerate(few):
            t = h[at[d] : at[d + 1]]
            if not len(t):
                t = np.frombuffer(raw[d] + b"\0", np.uint8).astype(np.uint64)
            x = np.uint64(len(t))
            for part in np.array_split(t, max(1, len(t) // BLOCK)):
                x = mix(np.array([np.bitwise_xor.reduce(mix(part + np.arange(1, len(part) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) + x]))[0]
            own[i] = x
        g = np.insert(g, first[few], own)
        n[few] = 1
    start = np.concatenate([[0], np.cumsum(n)])
    out = np.full((HASHES, len(n)), np.iinfo(np.uint64).max, np.uint64)
    value = np.empty(BLOCK, np.uint64)
    for low in range(0, len(g), BLOCK):
        part = g[low : low + BLOCK]
        d0 = int(np.searchsorted(start, low, "right")) - 1
        d1 = int(np.searchsorted(start, low + len(part), "left"))
        cuts = np.maximum(start[d0:d1] - low, 0)
        v = value[: len(part)]
        for p in range(HASHES):
            np.multiply(part, odd[p], out=v)
            np.bitwise_xor(v, flip[p], out=v)
            row = out[p, d0:d1]
            np.minimum(row, np.minimum.reduceat(v, cuts), out=row)
    return out.T


def pack(low: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of each minimum, as WORDS 64-bit words."""
    fields = (mix(low) & np.uint64(2**BITS - 1)).reshape(len(low), WORDS, 64 // BITS)
    shift = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(fields << shift, axis=2)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, row = Hasher(), TaskContext.get().partitionId() << 40
    weight = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
    band = mix(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(20))
    for batch in chunks(batches, "text", 1 << 20):
        texts = batch.column("text")
        h, at = hasher.tokens(texts)
        low = minima(h, at, [x or b"" for x in texts.cast(pa.binary()).to_pylist()] if (np.diff(at) == 0).any() else [])
        mixed = mix(low)
        keys = mix((mixed * weight).reshape(len(low), BANDS, ROWS).sum(axis=2, dtype=np.uint64) + band)
        whole = (mixed * weight).sum(axis=1, dtype=np.uint64), mix(low + weight).sum(axis=1, dtype=np.uint64)
        words = pack(low)
        rows, row = np.arange(row, row + len(low)), row + len(low)
        fine = pa.ListArray.from_arrays(np.arange(0, mixed.size + 1, HASHES, dtype=np.int32), pa.array((mixed >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), batch.column("doc_id"), batch.column("content"), *[pa.array(mix(w).view(np.int64)) for w in whole], pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).ravel())), *[pa.array(np.ascontiguousarray(words[:, i]).view(np.int64)) for i in range(WORDS)], fine],
            ["row", "doc_id", "content", "w0", "w1", "bands", *WORD_COLUMNS, "fine"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, content, w0, w1, bands, s0 ... s9, fine)`` of each row, stored: a number for it, a hash of its text; w0 and w1 stand for all
    minima; fine has 32 bits of each, which only nodes of large bands are asked for."""
    schema = "row long, doc_id long, content long, w0 long, w1 long, bands array<long>, " + ", ".join(f"{c} long" for c in WORD_COLUMNS) + ", fine array<int>"
    text = F.col("text").cast("string")
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text")).mapInArrow(_signatures, schema))


def estimate(left: str, right: str) -> Column:
    """Similarity from the packed words of two structs of them; below zero if fewer fields agree than by chance."""
    unlike: Column = F.lit(0)
    for c in WORD_COLUMNS:
        x = F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))
        for by in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        unlike = unlike + F.bit_count(x.bitwiseAND(F.lit(LOW)))
    chance = 2.0**-BITS
    return ((1 - unlike / F.lit(float(HASHES))) - chance) / (1 - chance)


def _estimated(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Adds ``similarity`` to pairs (u, v)."""
    words = F.struct(*WORD_COLUMNS)
    return pairs.join(sigs.select(F.col("node").alias("u"), words.alias("a")), "u").join(sigs.select(F.col("node").alias("v"), words.alias("b")), "v").select("u", "v", estimate("a", "b").alias("similarity"))


def _led(groups: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of groups (key, node, odd): members (key, node, leader, n, odd) beside the leader; their estimated pairs with it; and (key, u, n) of the odd ones that don't match it.
    Groups of one, and those without an odd node, have nothing to compare."""
    leaders = stored(groups.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n"), F.max("odd").alias("any")).where("n > 1 and any").drop("any"))
    shared = stored(groups.join(leaders, "key").where("node <> leader"))
    first = stored(_estimated(shared.select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct(), nodes))
    unlike = first.where(F.col("similarity") < threshold).select(F.col("u").alias("node"), F.col("v").alias("leader"))
    return shared, first, shared.join(unlike, ["node", "leader"]).select("key", F.col("node").alias("u"), "n")


def _within(odd: DataFrame, shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Estimated pairs of what doesn't match its group's leader with all of the group."""
    rest = odd.select("key", "u").join(shared.select("key", F.col("node").alias("v")), "key").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return _estimated(rest, nodes)


def _split(hot: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Groups (key, node, odd) of the nodes in large bands, by the minima they share: every pair of a band that could match is in one of them."""
    own = stored(hot.select("node").distinct())
    total = own.count()
    item = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    items = stored(sigs.select(F.col("row").alias("node"), "fine").join(sized(own), "node").select("node", F.posexplode("fine")).select("node", item.alias("item")))
    counts = stored(items.groupBy("item").agg(F.count("*").alias("n")).where("n > 1"))
    # What a thousandth of the nodes has is at most 1000 * HASHES minima, so they can be broadcast; no other is frequent.
    common = F.broadcast(counts.where(F.col("n") * 1000 > total))
    rare = items.join(common.select("item"), "item", "left_anti").join(counts.where(F.col("n") * 1000 <= total), "item")
    again = items.join(common, "item").select("node", "item", "n").union(rare.select("node", "item", "n"))
    need = max(1, int(np.ceil(HASHES * (threshold * (1 - 2.0**-BITS) + 2.0**-BITS))) - SLACK)
    # Minima that no other node has come first in the order and lead to nothing.
    ranked = again.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("x"))
    first = ranked.select("node", F.explode(F.expr(f"slice(x, 1, greatest(0, size(x) - {need - 1}))")).alias("x"))
    return stored(hot.join(first, "node").select(F.xxhash64("key", "x.item").alias("key"), "node", "odd"))


def edges(sigs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (u, v) between row numbers that connect every group of near duplicates."""
    nodes = stored(sigs.groupBy("w0", "w1").agg(F.min("row").alias("node"), F.first("bands").alias("bands"), *[F.first(c).alias(c) for c in WORD_COLUMNS]))
    copies = sigs.select("row", "w0", "w1").join(nodes.select("node", "w0", "w1"), ["w0", "w1"]).where("row <> node").select(F.col("row").alias("u"), F.col("node").alias("v"))
    shared, first, odd = _led(nodes.select("node", F.explode("bands").alias("key"), F.lit(True).alias("odd")), nodes, threshold)
    like = F.col("similarity") >= threshold
    found = first.union(_within(odd.where(F.col("n") <= SMALL), shared, nodes)).where(like).select("u", "v")
    many = stored(odd.where(F.col("n") > SMALL))
    if many.isEmpty():
        return copies.union(found)
    large = shared.join(sized(stored(many.select("key").distinct())), "key", "left_semi").select("key", "node")
    hot = stored(large.join(many.select("key", F.col("u").alias("node"), F.lit(True).alias("_odd")), ["key", "node"], "left").select("key", "node", F.coalesce("_odd", F.lit(False)).alias("odd")))
    shared, first, odd = _led(_split(hot, sigs, threshold), nodes, threshold)
    found = stored(found.union(first.where(like).select("u", "v")))
    known = stored(components(found))
    rooted = shared.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lead = shared.select("key", F.col("leader").alias("node")).distinct().join(known, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    apart = stored(rooted.select("key", "root").union(lead).groupBy("key").agg((F.min("root") < F.max("root")).alias("apart")).where("apart").select("key"))
    left = _within(odd.join(apart, "key", "left_semi"), shared.join(apart, "key", "left_semi"), nodes)
    return copies.union(found).union(left.where(like).select("u", "v"))


def members(sigs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(row, doc_id, content, kept)`` of all rows in a group of several, stored; kept is the (no_id, doc_id, content, row) of the one that stays."""
    own = components(edges(sigs, threshold)).withColumnRenamed("node", "row").join(sigs.select("row", "doc_id", "content"), "row")
    own = stored(own)
    best = own.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "content", "row")).alias("kept"))
    return own.join(best, "root").select("row", "doc_id", "content", "kept")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, duplicate_of, similarity)`` of every document that is not the smallest of its group; similarity to that one."""
    sigs = signatures(docs)
    pairs = stored(members(sigs, threshold).where("doc_id <> kept.doc_id").select(F.col("row").alias("u"), F.col("kept.row").alias("v"), "doc_id", F.col("kept.doc_id").alias("duplicate_of")))
    estimated = _estimated(pairs.select("u", "v"), sigs.withColumnRenamed("row", "node"))
    return pairs.join(estimated, ["u", "v"]).groupBy("doc_id", "duplicate_of").agg(F.max("similarity").alias("similarity"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each group stays."""
    sigs = signatures(docs)
    own = stored(members(sigs, threshold))
    id_, content = fresh(docs, "row_id"), fresh(docs, "row_content")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(id_), F.xxhash64(F.col("doc_id").isNull(), F.col("content")).alias(content)]
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("content") == F.col("kept.content"))
    gone = stored(own.where(~stays).select(*key).distinct())
    again = stored(own.where(stays).groupBy(*key).count().where("count > 1").select(id_, content))
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), content: F.xxhash64(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string")))})
    kept = keyed.join(sized(gone), [id_, content], "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    # Of rows alike in doc_id and text any one stays.
    one = kept.join(sized(again), [id_, content], "left_semi").dropDuplicates([id_, content])
    return kept.join(sized(again), [id_, content], "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))
