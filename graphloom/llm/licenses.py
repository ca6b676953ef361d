"""License scans by diagonal voting.

All rolling hashes of ``K`` words of every document are joined with those of the license templates. A hit at word p of a document and
word t of a template votes for the diagonal p - t. Votes are added up by diagonal; diagonals of one document and template that lie
within a fifth of the template's length of each other are merged, as words left out or put in shift an alignment. Each merged
span is then verified against the text: the longest common subsequence of the words where the template should stand and the template's
own words must have at least ``COVERAGE`` of the latter.

Templates are a table ``(license, text)``, by default that of ``licensepack``; such a table is collected, as it is a reference and not a corpus.
Their hashes are broadcast while they have at most ``BROADCAST`` hashes, and so are the ids of documents with votes; beyond that
both joins shuffle.

Defined results: a null text is an empty one; rows without doc_id and texts or templates of fewer than K words have no spans;
repeated rows report each their spans; a license that stands in a text several times is reported for each; of spans that overlap the
one with the highest coverage stays, then the one with more words, then the earlier template; an empty table gives none; other columns are ignored. Starts and ends count words.
Very long texts are hashed in pieces; each span is verified by itself, in time in proportion to its own length times the template's, and
overlaps are looked up by place, so a text of many spans takes little more than in proportion to them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import stored
from graphloom.llm.licensepack import TEMPLATES
from graphloom.llm.textkit import Hasher, chunks, grams

K = 4
COVERAGE = 0.8
BROADCAST = 200_000
PIECE = 1 << 15

SPAN = "doc_id long, license string, template int, start int, end int, n_words int, coverage double"


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    h, at = Hasher().tokens(pa.array(texts, pa.string()))
    return [h[a:b] for a, b in zip(at, at[1:])]


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in chunks(batches, "text", 1 << 20):
        h, at = hasher.tokens(batch.column("text"))
        g, begin = grams(h, at, K)
        first = np.searchsorted(begin, at)
        n = np.diff(first)
        pieces = -(-n // PIECE)
        doc = np.repeat(np.arange(len(n)), pieces)
        base = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        ends = np.concatenate([[0], np.minimum(first[:-1][doc] + base + PIECE, first[1:][doc])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(doc)), batch.column("content").take(pa.array(doc)), pa.array(base.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(g.view(np.int64)))],
            ["doc_id", "content", "base", "grams"],
        )


def votes(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """``(doc_id, content, template, low, high, n_hits)``: merged diagonals of each document, known by id and hash of its text."""
    spark = docs.sparkSession
    rows, sizes = [], []
    for i, h in enumerate(word_hashes([t for _, t in templates])):
        g, begin = grams(h, np.array([0, len(h)]), K)
        rows += [(int(x), i, int(b)) for x, b in zip(g.view(np.int64), begin)]
        sizes.append((i, max(1, len(h) // 5)))
    places = spark.createDataFrame(rows, "gram long, template int, place int")
    places = F.broadcast(places) if len(rows) <= BROADCAST else places
    rolled = docs.mapInArrow(_rolled, "doc_id long, content long, base int, grams array<long>")
    words = rolled.select("doc_id", "content", "base", F.posexplode("grams").alias("i", "gram"))
    hits = words.join(places, "gram").select("doc_id", "content", "template", (F.col("base") + F.col("i") - F.col("place")).alias("diagonal"))
    by = hits.groupBy("doc_id", "content", "template", "diagonal").agg(F.count("*").alias("n_hits"))
    slop = F.element_at(F.create_map(*[F.lit(x) for s in sizes for x in s]), F.col("template"))
    line = Window.partitionBy("doc_id", "content", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > slop).cast("int"), F.lit(1))
    groups = by.withColumn("new", new).withColumn("group", F.sum("new").over(line))
    return groups.groupBy("doc_id", "content", "template", "group").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("n_hits").alias("n_hits")).drop("group")


def common_words(doc: np.ndarray, template: np.ndarray) -> tuple[int, int, int]:
    """The length of the longest common subsequence, and where in doc its first and last word stand, the closest together for that length."""
    # Of each prefix of the template: the best (length, latest possible start) over the words of doc so far, as length << 32 | start + 1.
    one, best, state = 1 << 32, (0, 0, 0), np.zeros(len(template) + 1, np.int64)
    places: dict[int, np.ndarray] = {}
    for i in np.flatnonzero(np.isin(doc, template)).tolist():
        w = int(doc[i])
        if w not in places:
            places[w] = np.flatnonzero(template == doc[i])
        at = places[w]
        longer = np.where(state[at] >= one, state[at] + one, one + i + 1)
        state[at + 1] = np.maximum(state[at + 1], longer)
        np.maximum.accumulate(state, out=state)
        n, s = int(state[-1]) >> 32, (int(state[-1]) & (one - 1)) - 1
        if n > best[0] or (n == best[0] and i - s < best[2] - best[1]):
            best = (n, s, i)
    return best[0], best[1], best[2] + 1


def apart(found: list[tuple[float, int, int, int, int]]) -> list[tuple[float, int, int, int, int]]:
    """Of (coverage, words, template, start, end) those that overlap no better one: more coverage, more words, the earlier template."""
    out, taken = [], []
    for f in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
        i = bisect.bisect_left(taken, (f[3],))
        if (i == 0 or taken[i - 1][1] <= f[3]) and (i == len(taken) or taken[i][0] >= f[4]):
            taken.insert(i, (f[3], f[4]))
            out.append(f)
    return out


def in_common(doc: np.ndarray, template: np.ndarray) -> int:
    """How many words both have, repeated ones as often as in both: no subsequence is longer."""
    words, times = np.unique(template, return_counts=True)
    own, often = np.unique(doc[np.isin(doc, words)], return_counts=True)
    return int(np.minimum(often, times[np.searchsorted(words, own)]).sum())


def scan(docs: DataFrame, templates: DataFrame | list[tuple[str, str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, license, template, start, end, n_words, coverage)`` of every verified span.

    templates: (license, text), as a list in the order that numbers them, or as a table, which is put in order of both columns.
    """
    if isinstance(templates, DataFrame):
        templates = [tuple(r) for r in templates.select("license", "text").dropna().distinct().orderBy("license", "text").collect()]
    templates = TEMPLATES if templates is None else templates
    # The hash of the text tells rows apart that share an id.
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("content", F.xxhash64("text"))
    spans = stored(votes(keyed, templates).groupBy("doc_id", "content").agg(F.array_sort(F.collect_list(F.struct("template", "low", "high"))).alias("spans")))
    few = spans.count() <= BROADCAST
    with_text = keyed.join(F.broadcast(spans) if few else spans, ["doc_id", "content"]).select("doc_id", "text", "spans")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = Hasher(), word_hashes([t for _, t in templates])
        for batch in chunks(batches, "text", 1 << 20):
            h, at = hasher.tokens(batch.column("text"))
            out = []
            for d, (doc_id, spans) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist())):
                words, found = h[at[d] : at[d + 1]], []
                for s in spans:
                    t = own[s["template"]]
                    low, high = max(0, s["low"]), min(len(words), s["high"] + len(t))
                    if in_common(words[low:high], t) < coverage * len(t):
                        continue
                    n, a, b = common_words(words[low:high], t)
                    if n >= coverage * len(t):
                        found.append((n / len(t), n, s["template"], low + a, low + b))
                out += [(doc_id, templates[i][0], i, a, b, n, share) for share, n, i, a, b in apart(found)]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            names = ["doc_id", "license", "template", "start", "end", "n_words", "coverage"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return with_text.mapInArrow(verify, SPAN)
