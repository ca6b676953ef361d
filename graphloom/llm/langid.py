"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

Features of a text are its words and the byte trigrams around each byte of a word (neighbours outside the word count as a space),
hashed into buckets; every bucket has a vector, a text is the mean of its features' vectors, and a softmax over a linear map of
that mean gives the languages' probabilities. The model is fitted on at most ``SAMPLE`` labelled documents, in each language those with
the smallest hash (half of them shared equally among the languages, so that a rare one is learnt in a corpus of any size, the rest in
proportion), of longer documents on a part of ``LONGEST`` characters, on pieces of 1 to 60 words, beside made-up text in no language (random letters,
scripts and digits) as a class of its own. A fifth of the documents is held out: on it a temperature is chosen that gives the least
log loss, and the rejection threshold for the likeliest language's probability is set at twice what 99 % of the made-up pieces stay under, or lower where
that would reject more than one in a thousand of the labelled pieces.

As the map is linear, the vectors are multiplied out once, so classifying costs one table look-up a feature; whole texts are read.

Defined results: a null text, an empty one or one without words has no language, probability 0, and is rejected; with fewer than two labelled languages nothing can be fitted, and then nothing
is rejected and language and probability are null; with more than ``SAMPLE / (2 LEAST)`` languages rare ones may not be learnt; repeated rows and rows without doc_id get their own results; ties go to the
language first in order of name; an empty table gives none; very long texts are read whole and take time in proportion to their length; other columns are ignored by ``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.textkit import Hasher, chunks

SAMPLE = 4000
LONGEST = 20_000
LEAST = 5
KEEP = 0.999
TRIGRAMS, WORDS = 1 << 17, 1 << 16
SIZE = 16
NONE = "~none"


def features(hasher: Hasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, first of all trigrams and words in order of place, and where each text's begin."""
    data, at, start, end = hasher.split(texts)
    inside = np.flatnonzero(hasher.word[data])
    plain = np.where(hasher.word[data], data, np.uint8(32)).astype(np.uint32)
    plain = np.concatenate([[np.uint32(32)], plain, [np.uint32(32)]])
    code = (plain[inside] << np.uint32(16)) | (plain[inside + 1] << np.uint32(8)) | plain[inside + 2]
    tri = (code * np.uint32(2654435761)) >> np.uint32(32 - 17)
    words = (hasher.spans(data, start, end) >> np.uint64(48)).astype(np.uint32) + np.uint32(TRIGRAMS)
    place = np.searchsorted(inside, start) + np.arange(len(start))  # each word before its own trigrams
    out = np.empty(len(tri) + len(words), np.uint32)
    is_word = np.zeros(len(out), bool)
    is_word[place] = True
    out[is_word], out[~is_word] = words, tri
    return out, np.searchsorted(inside, at) + np.searchsorted(start, at)


@dataclasses.dataclass
class Model:
    names: list[str]
    table: np.ndarray  # bucket x language: vectors times the linear map
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        out = np.zeros((len(n), len(self.names)), np.float64)
        full = np.flatnonzero(n)
        if len(full):
            out[full] = np.add.reduceat(self.table[buckets], at[full], axis=0, dtype=np.float64) / n[full, None]
        return out + self.bias

    def probabilities(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.logits(buckets, at) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def identify(self, hasher: Hasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of languages, their probabilities, and whether the text is rejected."""
        buckets, at = features(hasher, texts)
        p = self.probabilities(buckets, at)
        p = p[:, [n != NONE for n in self.names]]  # NONE is the last
        best = p.argmax(axis=1)
        empty = np.diff(at) == 0
        top = np.where(empty, 0.0, p[np.arange(len(p)), best])
        return best, top, empty | (top < self.threshold)


def nonsense(random: np.random.Generator, n: int) -> list[str]:
    """Texts in no language."""
    scripts = [(0x400, 0x4FF), (0x370, 0x3FF), (0x590, 0x5EA), (0x600, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x61, 0x7A), (0x61, 0x7A), (0x61, 0x7A), (0x30, 0x39)]
    out = []
    for _ in range(n):
        low, high = scripts[random.integers(len(scripts))]
        out.append(" ".join("".join(map(chr, random.integers(low, high + 1, random.integers(1, 11)))) for _ in range(random.integers(2, 60))))
    return out


def _pieces(random: np.random.Generator, texts: list[str], names: list[int], each: int) -> tuple[list[str], np.ndarray]:
    out, label = [], []
    for text, name in zip(texts, names):
        words = text.split()
        for _ in range(each if words else 0):
            n = int(random.integers(1, 61))
            i = int(random.integers(max(1, len(words) - n + 1)))
            out.append(" ".join(words[i : i + n]))
            label.append(name)
    return out, np.array(label, np.int64)


def train(texts: list[str], labels: list[str], seed: int = 7, epochs: int = 4, each: int = 4, rate: float = 0.5) -> Model | None:
    """Fit, calibrate, set the threshold. None if there are fewer than two languages with LEAST texts."""
    random = np.random.default_rng(seed)
    known, count = np.unique(np.array(labels, dtype=object).astype(str), return_counts=True) if labels else ([], [])
    names = [str(x) for x, n in zip(known, count) if n >= LEAST]
    if len(names) < 2:
        return None
    rows = [(t, names.index(x)) for t, x in zip(texts, labels) if x in names]
    order = random.permutation(len(rows))
    rows = [rows[i] for i in order]
    none = nonsense(random, max(50, len(rows) // len(names)))
    held = [i % 5 == 0 for i in range(len(rows))]
    names.append(NONE)
    hasher = Hasher()

    def data(keep: bool):
        own = [r for r, h in zip(rows, held) if h == keep]
        own += [(t, len(names) - 1) for t in (none[::5] if keep else [t for i, t in enumerate(none) if i % 5])]
        pieces, label = _pieces(random, [t for t, _ in own], [y for _, y in own], each)
        return *features(hasher, pa.array(pieces)), label

    buckets, at, label = data(False)
    full = np.flatnonzero(np.diff(at))
    vectors = random.normal(0, 1 / SIZE, (TRIGRAMS + WORDS, SIZE)).astype(np.float32)
    linear, bias = np.zeros((SIZE, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, done = epochs * -(-len(full) // 32), 0
    for _ in range(epochs):
        shuffled = random.permutation(full)
        for k in range(0, len(shuffled), 32):
            rows_ = shuffled[k : k + 32]
            n = at[rows_ + 1] - at[rows_]
            first = np.concatenate([[0], np.cumsum(n)])
            of = np.repeat(np.arange(len(rows_)), n)
            index = buckets[np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(at[rows_], n)]
            mean = np.add.reduceat(vectors[index], first[:-1], axis=0) / n[:, None].astype(np.float32)
            z = mean @ linear + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = e / e.sum(axis=1, keepdims=True)
            g[np.arange(len(rows_)), label[rows_]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = (g @ linear.T) / n[:, None].astype(np.float32)
            linear -= step * (mean.T @ g) / len(rows_) * 8
            bias -= step * g.mean(axis=0)
            order = np.argsort(index, kind="stable")  # a bucket's steps are added up before they are taken
            own = index[order]
            begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            vectors[own[begin]] -= step * np.add.reduceat(back[of[order]], begin, axis=0)
            done += 1
    model = Model(names, (vectors @ linear).astype(np.float32), bias.astype(np.float64))
    buckets, at, label = data(True)
    if not len(label):
        return model
    z = model.logits(buckets, at)
    losses = []
    for t in (temperatures := np.geomspace(0.1, 4, 30)):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        losses.append(-(s[np.arange(len(s)), label] - np.log(np.exp(s).sum(axis=1))).mean())
    model.temperature = float(temperatures[int(np.argmin(losses))])
    top = model.probabilities(buckets, at)[:, :-1].max(axis=1)
    own, other = top[label < len(names) - 1], top[label == len(names) - 1]
    if len(own) and len(other):
        model.threshold = float(min(0.5, np.quantile(own, 1 - KEEP), 2 * np.quantile(other, 0.99)))
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from the labelled rows ``(doc_id, text, lang)`` of docs; ``sample`` bounds what the driver gathers."""
    hashed = F.xxhash64("doc_id", "text")
    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("text", F.col("lang").cast("string").alias("lang"), hashed.alias("h"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    # Half the sample is shared equally among the languages, the rest by what each still has.
    least = {x: min(n, sample // (2 * len(counts))) for x, n in counts.items()}
    more = (sample - sum(least.values())) / max(1, sum(counts.values()) - sum(least.values()))
    quota = {x: min(n, least[x] + int(more * (n - least[x]))) for x, n in counts.items()}
    # A cut of the hash for each language leaves somewhat more rows than that; of them the first ones count.
    cuts = docs.sparkSession.createDataFrame([(x, q, int((1 << 40) * min(1.0, (q + 5 * q**0.5 + 10) / counts[x]))) for x, q in quota.items()], "lang string, quota int, cut long")
    long = F.length("text") > LONGEST
    piece = F.when(long, F.col("text").substr(F.pmod("h", F.length("text") - LONGEST + 1).cast("int") + 1, F.lit(LONGEST))).otherwise(F.col("text"))
    rows = labelled.join(F.broadcast(cuts), "lang").where(F.pmod("h", F.lit(1 << 40)) < F.col("cut")).select(piece.alias("text"), "lang", "h", "quota")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where("k <= quota").select("text", "lang", "h").collect()
    rows = sorted(rows, key=lambda r: (r.h, r.text, r.lang))
    return train([r.text for r in rows], [r.lang for r in rows])


def _broadcast(docs: DataFrame, model: Model | None):
    return docs.sparkSession.sparkContext.broadcast(model if model is not None else fit(docs))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, language, probability, keep)`` of every row; keep is false where the text is rejected."""
    shared = _broadcast(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, m = Hasher(), shared.value
        for batch in chunks(batches, "text", 1 << 20):
            n = batch.num_rows
            if m is None:
                cols = [pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.array(np.ones(n, bool))]
            else:
                best, p, no = m.identify(hasher, batch.column("text"))
                names = pa.array([x for x in m.names], pa.string())
                language = names.take(pa.array(best))
                cols = [pc.if_else(pa.array(p > 0), language, pa.scalar(None, pa.string())), pa.array(p), pa.array(~no)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "language", "probability", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, language string, probability double, keep boolean")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that aren't rejected."""
    shared = _broadcast(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, m = Hasher(), shared.value
        for batch in chunks(batches, "text", 1 << 20):
            if m is None:
                yield batch
            else:
                no = m.identify(hasher, batch.column("text"))[2]
                if not no.all():
                    yield batch.filter(pa.array(~no)) if no.any() else batch

    return docs.mapInArrow(run, docs.schema)
