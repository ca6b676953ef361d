"""Benchmark decontamination with a distributed positional inverted index.

The corpus is split into segments of about ``SEGMENT`` bytes of text. Each segment stores, for every one of its tokens, the list
of the token's positions (offsets in the segment's stream of tokens) and the number of its documents; one more row of the segment
holds the document ids and where each begins. All token postings are stored, as a Parquet table in the shared folder.

A search adds up document frequencies over all segments, orders each benchmark item's terms from the rarest (its places in the item by
frequency, then by the term's first place), and intersects the offset-adjusted lists (position minus the term's offset in the item)
within each segment, for all items at once:

* ``exact``: at least ``n`` tokens of the item (all, if it has fewer) stand in the document consecutively. Every window of ``n``
  tokens is looked up from its rarest term, and what is left is intersected with the next rarer one's list. Each maximal run is one row.
* ``proximity``: of the item's D distinct terms at least ``need`` = ceil(0.7 D) stand within ``slop`` tokens of where one alignment
  puts them (an item of L tokens has slop max(3, L div 4)). At most D - need terms may be missing, so one of the D - need + 1 rarest
  must be hit: their lists give all alignments to look at, and an alignment is given up once too many terms are missing. Only for items of 6
  distinct terms or more, and for documents in which no window of that item is exact. The best alignment is one row: most terms, then the first.

Items of which a segment has too few terms, or no n in a row, cost a look-up of their terms in its vocabulary and no more.

Defined results: a null text is an empty one; documents without id and items without id are not reported by ``decontaminate``, while
``drop_contaminated`` knows documents by their texts and so judges those without id, and texts that share an id, each on its own; an item without tokens
matches nothing; repeated rows are searched each on their own and report each their matches; empty tables give none; a very long text
is a segment of its own, of whatever size; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fresh, sized
from graphloom.llm.textkit import TOKEN, Hasher, chunks
from graphloom.session import discard, stored

SEGMENT = 8 << 20
#: Items searched in one pass; more are searched in several, so that what each task holds of the benchmark stays small.
ITEMS = 20_000
MATCH = "doc_id long, item_id long, kind string, doc_start int, item_start int, n_tokens int"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, part = Hasher(), TaskContext.get().partitionId()
    for k, batch in enumerate(chunks(batches, "text", SEGMENT)):
        h, at = hasher.tokens(batch.column("text"))
        order = np.argsort(h, kind="stable")
        h = h[order]
        doc = np.searchsorted(at, order, "right")
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        begin = np.flatnonzero(first)
        first[1:] |= doc[1:] != doc[:-1]
        n_docs = np.add.reduceat(first.astype(np.int32), begin) if len(begin) else np.empty(0, np.int32)
        ends = np.concatenate([begin, [len(h)], [len(h) + len(at)]]) * 4
        lists = np.concatenate([order, at]).astype(np.int32)
        n = len(begin)
        ids = [None] * n + [np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64).tobytes()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, (part << 32) + k, np.int64)),
                pa.array(np.append(h[begin], np.uint64(0)).view(np.int64), mask=np.arange(n + 1) == n),
                pa.array(np.concatenate([n_docs, [len(at) - 1]]).astype(np.int32)),
                pa.Array.from_buffers(pa.binary(), n + 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(lists)]),
                pa.array(ids, pa.binary()),
            ],
            ["segment", "token", "n_docs", "positions", "doc_ids"],
        )


def build_index(docs: DataFrame) -> DataFrame:
    """The stored postings ``(segment, token, n_docs, positions, doc_ids)`` of all documents."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(_index, "segment long, token long, n_docs int, positions binary, doc_ids binary"))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, seen = Hasher(), TaskContext.get().partitionId() << 40
    for batch in chunks(batches, "text"):
        h, at = hasher.tokens(batch.column("text"))
        n = np.diff(at)
        ids = np.asarray(batch.column("item_id").to_numpy(zero_copy_only=False), np.int64)
        rows, seen = np.arange(seen, seen + len(ids)), seen + len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, n)), pa.array(np.repeat(ids, n)), pa.array((np.arange(len(h)) - np.repeat(at[:-1], n)).astype(np.int32)), pa.array(h.view(np.int64))], ["row", "item_id", "place", "token"])


def ramp(n: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each number, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


@dataclasses.dataclass
class Items:
    """The benchmark's items of one pass, as arrays. Terms are numbers of ``vocabulary``."""

    vocabulary: np.ndarray
    ids: np.ndarray
    begin: np.ndarray  # where each item's terms begin in ``term``
    term: np.ndarray
    # windows, by item and place: their item, place and length, and their terms and places from the rarest (-1 beyond the length)
    window_item: np.ndarray
    window_place: np.ndarray
    window_size: np.ndarray
    window_terms: np.ndarray
    window_places: np.ndarray
    # distinct terms of each item from the rarest, and the first place of each
    rare_begin: np.ndarray
    rare: np.ndarray
    rare_place: np.ndarray
    need: np.ndarray  # 0: no proximity
    slop: np.ndarray


def prepared(item_id: np.ndarray, row: np.ndarray, place: np.ndarray, token: np.ndarray, frequency: dict[int, int], n: int) -> Items:
    order = np.lexsort((place, row))
    item_id, row, token = item_id[order], row[order], token[order]
    vocabulary, term = np.unique(token, return_inverse=True)
    often = np.array([frequency.get(int(t), 0) for t in vocabulary], np.int64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    begin = np.append(first, len(row))
    windows, tables, rares = [], [], []
    for i, (a, b) in enumerate(zip(begin, begin[1:])):
        own = term[a:b]
        _, at, back = np.unique(own, return_index=True, return_inverse=True)
        rank = np.empty(len(own), np.int64)
        rank[np.lexsort((np.arange(len(own)), at[back], often[own]))] = np.arange(len(own))
        size = min(n, len(own))
        places = np.arange(len(own) - size + 1)[:, None] + np.arange(size)
        places = np.take_along_axis(places, np.argsort(rank[places], axis=1), axis=1)
        tables.append(np.pad(places, ((0, 0), (0, n - size)), constant_values=-1))
        windows.append((i, len(places), size))
        at = at[np.argsort(rank[at])]
        rares.append((own[at], at))
    counts = np.array([k for _, k, _ in windows], np.int64)
    places = np.concatenate(tables) if tables else np.empty((0, n), np.int64)
    of = np.repeat(np.arange(len(counts)), counts)
    distinct = np.array([len(t) for t, _ in rares], np.int64)
    return Items(
        vocabulary, item_id[first], begin, term,
        of, ramp(counts), np.repeat(np.array([k for _, _, k in windows], np.int64), counts), np.where(places < 0, -1, term[np.minimum(begin[of, None] + places, len(term) - 1)]) if len(term) else places, places,
        np.concatenate([[0], np.cumsum(distinct)]), np.concatenate([t for t, _ in rares]) if rares else term, np.concatenate([p for _, p in rares]) if rares else term,
        np.where(distinct >= 6, -(-7 * distinct // 10), 0), np.maximum(3, np.diff(begin) // 4),
    )


class Lists:
    """One segment's postings of the wanted terms, and where its documents begin."""

    def __init__(self, term: np.ndarray, lists: list[bytes], size: int, at: np.ndarray) -> None:
        order = np.argsort(term)
        lengths = np.array([len(lists[i]) // 4 for i in order], np.int64)
        self.count = np.zeros(size, np.int64)
        self.count[term[order]] = lengths
        self.begin = np.concatenate([[0], np.cumsum(self.count)])
        self.position = np.frombuffer(b"".join([lists[i] for i in order]), np.int32).astype(np.int64)
        self.key = (np.repeat(term[order].astype(np.int64), lengths) << 32) | self.position
        self.at = at

    def all(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every position of each term: the index of the term, and the position."""
        n = self.count[term]
        return np.repeat(np.arange(len(term)), n), self.position[np.repeat(self.begin[term], n) + ramp(n)]

    def any(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term has a position from low to high."""
        if not len(self.key):
            return np.zeros(len(term), bool)
        k = np.searchsorted(self.key, (term << 32) | np.maximum(low, 0))
        return (k < len(self.key)) & (high >= 0) & (self.key[np.minimum(k, len(self.key) - 1)] <= ((term << 32) | np.maximum(high, 0)))

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, position, "right") - 1


def _exact(items: Items, lists: Lists) -> tuple[np.ndarray, ...]:
    """(item, document, start in it, start in the item, tokens) of every maximal run."""
    there = lists.count[items.term] > 0
    lost = np.concatenate([[0], np.cumsum(~there)])
    a = items.begin[items.window_item] + items.window_place
    w = np.flatnonzero(lost[a + items.window_size] == lost[a])  # windows whose terms the segment has
    k, position = lists.all(items.window_terms[w, 0])
    w = w[k]
    start = position - items.window_places[w, 0]
    for j in range(1, items.window_terms.shape[1]):
        if not len(w):
            break
        term, place = items.window_terms[w, j], items.window_places[w, j]
        hit = (term < 0) | lists.any(np.maximum(term, 0), start + place, start + place)
        w, start = w[hit], start[hit]
    place, size = items.window_place[w], items.window_size[w]
    first = start + place
    inside = (first >= 0) & (lists.document(first) == lists.document(first + size - 1))
    w, start, place, size, first = w[inside], start[inside], place[inside], size[inside], first[inside]
    item, doc = items.window_item[w], lists.document(first)
    order = np.lexsort((place, start, item))
    item, doc, start, place, size, first = item[order], doc[order], start[order], place[order], size[order], first[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1]) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(item)) - 1 if len(head) else head
    return item[head], doc[head], first[head] - lists.at[doc[head]], place[head], place[tail] - place[head] + size[head]


def _proximity(items: Items, lists: Lists) -> tuple[np.ndarray, ...]:
    """(item, document, start in it, terms) of the best alignment of every item and document that have one."""
    there = lists.count[items.rare] > 0
    distinct = np.diff(items.rare_begin)
    have = np.diff(np.concatenate([[0], np.cumsum(there)])[items.rare_begin])
    i = np.flatnonzero((items.need > 0) & (have >= items.need))
    anchors = distinct[i] - items.need[i] + 1
    item, rank = np.repeat(i, anchors), ramp(anchors)
    at = items.rare_begin[item] + rank
    k, position = lists.all(items.rare[at])
    item, start, doc = item[k], position - items.rare_place[at][k], lists.document(position)
    _, one = np.unique(np.stack([item, start, doc]), axis=1, return_index=True) if len(item) else (None, np.empty(0, np.int64))
    item, start, doc = item[one], start[one], doc[one]
    missing, j = np.zeros(len(item), np.int64), 0
    done: list[np.ndarray] = []
    while len(item):
        at = items.rare_begin[item] + j
        low, high = start + items.rare_place[at] - items.slop[item], start + items.rare_place[at] + items.slop[item]
        missing += ~lists.any(items.rare[at], np.maximum(low, lists.at[doc]), np.minimum(high, lists.at[doc + 1] - 1))
        j += 1
        alive = missing <= distinct[item] - items.need[item]
        item, start, doc, missing = item[alive], start[alive], doc[alive], missing[alive]
        over = distinct[item] == j
        if over.any():
            done.append(np.stack([item, doc, missing - distinct[item], start])[:, over])
            item, start, doc, missing = item[~over], start[~over], doc[~over], missing[~over]
    found = np.concatenate(done, axis=1) if done else np.empty((4, 0), np.int64)
    found = found[:, np.lexsort(found[::-1])]
    best = np.ones(found.shape[1], bool)
    best[1:] = (found[:2, 1:] != found[:2, :-1]).any(axis=0)
    item, doc, terms, start = found[:, best]
    return item, doc, np.maximum(0, start - lists.at[doc]), -terms


def _matcher(shared):
    """A function from one segment's postings to its matches."""

    def match(table):
        items: Items = shared.value
        token, positions = table.column("token").combine_chunks(), table.column("positions").to_pylist()
        head = next(i for i, t in enumerate(token.is_null().to_pylist()) if t)
        ids = np.frombuffer(table.column("doc_ids")[head].as_py(), np.int64)
        at = np.frombuffer(positions.pop(head), np.int32).astype(np.int64)
        term = np.searchsorted(items.vocabulary, token.drop_null().to_numpy())
        lists = Lists(term, positions, len(items.vocabulary), at)
        item, doc, start, place, n = _exact(items, lists)
        near_item, near_doc, near_start, terms = _proximity(items, lists)
        other = ~np.isin(near_item * len(at) + near_doc, item * len(at) + doc)
        near_item, near_doc, near_start, terms = near_item[other], near_doc[other], near_start[other], terms[other]
        both = lambda a, b, kind: pa.array(np.concatenate([a, b]).astype(kind))
        kinds = pa.array(["exact"] * len(item) + ["proximity"] * len(near_item), pa.string())
        columns = [both(ids[doc], ids[near_doc], np.int64), both(items.ids[item], items.ids[near_item], np.int64), kinds, both(start, near_start, np.int32), both(place, np.zeros(len(near_item)), np.int32), both(n, terms, np.int32)]
        return pa.Table.from_arrays(columns, ["doc_id", "item_id", "kind", "doc_start", "item_start", "n_tokens"])

    match.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return match


def search(index: DataFrame, benchmark: DataFrame, n: int = 8, items_a_pass: int = ITEMS) -> DataFrame:
    """Matches ``(doc_id, item_id, kind, doc_start, item_start, n_tokens)``, stored; starts count tokens."""
    spark = index.sparkSession
    terms = stored(benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_terms, "row long, item_id long, place int, token long"))
    rounds = max(1, -(-terms.select("row").distinct().count() // items_a_pass))
    out = spark.createDataFrame([], MATCH)
    for k in range(rounds):
        own = terms.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k)
        wanted = stored(own.select("token").distinct())
        found = index.select("token", "n_docs").join(sized(wanted), "token").groupBy("token").agg(F.sum("n_docs").alias("n")).toArrow()
        t = own.toArrow()
        items = prepared(*[t.column(c).to_numpy() for c in ("item_id", "row", "place", "token")], dict(zip(found.column("token").to_pylist(), found.column("n").to_pylist())), n)
        lists = index.join(sized(wanted.withColumn("wanted", F.lit(1))), "token", "left").where("wanted is not null or token is null").select("segment", "token", "positions", "doc_ids")
        out = out.union(lists.groupBy("segment").applyInArrow(_matcher(spark.sparkContext.broadcast(items)), MATCH))
    return stored(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8) -> DataFrame:
    """All matches of the benchmark in the documents. The index is made for this search, and deleted after it."""
    index = build_index(docs)
    found = search(index, benchmark, n)
    discard(index)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 8) -> DataFrame:
    """The rows of docs, with all their columns, in whose texts nothing of the benchmark was found."""
    text = F.xxhash64(F.col("text").cast("string"))
    key = fresh(docs, "text_hash")
    found = stored(decontaminate(docs.select(text.alias("doc_id"), "text"), benchmark, n).select(F.col("doc_id").alias(key)).distinct())
    return docs.withColumn(key, text).join(sized(found), key, "left_anti").select(*docs.columns)


ORACLE = f"""
WITH d AS (SELECT doc_id, w, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM documents)),
dt AS MATERIALIZED (SELECT doc_id, pos, w[pos + 1] AS tok FROM d),
b AS (SELECT item_id, w, len(w) AS size, generate_subscripts(w, 1) - 1 AS place FROM (SELECT item_id, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM benchmark)),
bt AS MATERIALIZED (SELECT item_id, size, place, w[place + 1] AS tok FROM b),
freq AS (SELECT tok, count(DISTINCT doc_id) AS n FROM dt WHERE tok IN (SELECT tok FROM bt) GROUP BY tok),
hits AS (SELECT doc_id, item_id, size, pos - place AS diag, place, pos FROM dt JOIN bt USING (tok)),
runs AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY place) AS g FROM hits),
exact AS (SELECT doc_id, item_id, 'exact' AS kind, min(pos) AS doc_start, min(place) AS item_start, count(*) AS n_tokens
  FROM runs GROUP BY doc_id, item_id, size, diag, g HAVING count(*) >= least(8, size)),
terms AS (SELECT item_id, size, tok, min(place) AS place FROM bt GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), place) AS k, count(*) OVER (PARTITION BY item_id) AS d FROM terms LEFT JOIN freq USING (tok)),
want AS (SELECT item_id, tok, place, k, d, (7 * d + 9) // 10 AS need, greatest(3, size // 4) AS slop FROM ranked WHERE d >= 6),
near AS MATERIALIZED (SELECT doc_id, item_id, k, d, need, slop, pos - place AS start FROM dt JOIN want USING (tok)),
enough AS (SELECT doc_id, item_id FROM near GROUP BY ALL HAVING count(DISTINCT k) >= any_value(need)),
close AS (SELECT near.* FROM near JOIN enough USING (doc_id, item_id)),
aligned AS (SELECT a.doc_id, a.item_id, a.start, a.need, count(DISTINCT o.k) AS terms FROM (SELECT DISTINCT doc_id, item_id, start, need, slop FROM close WHERE k <= d - need + 1) a JOIN close o
  ON a.doc_id = o.doc_id AND a.item_id = o.item_id AND abs(o.start - a.start) <= a.slop GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY terms DESC, start) AS first FROM aligned WHERE terms >= need)
SELECT doc_id, item_id, kind, doc_start::INT AS doc_start, item_start::INT AS item_start, n_tokens::INT AS n_tokens FROM exact
UNION ALL SELECT doc_id, item_id, 'proximity', greatest(0, start)::INT, 0, terms::INT FROM best
  WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.doc_id = best.doc_id AND e.item_id = best.item_id)
"""
