"""Counts over a text, made in one pass: what the quality rules and the quality classifier look at.

Words are runs of anything but blanks, tabs and line ends; tokens are those of ``textkit``. A line counts if it has a word. A null
text is an empty one, and all its counts are zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textkit import TOKEN, Hasher, chunks, lowered

SYMBOLS = "#$%&*|<>{}[]^~=_+@"
STOP_WORDS = sorted(set(
    "the and of to in is was that for it with as on be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so what up said its about than into them can only other time new some could these two may then do first any "
    "der die das und ist von den mit zu des im auf dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei in für sich "
    "le la les et de un une du des est dans que qui pour pas sur plus par au avec ce il se ne son en mais ou nous comme elle on leur été cette aux sa ses sont "
    "el la los las y de que en un una por con no se su para es al lo como más pero sus le ya o fue este ha sí porque esta son entre cuando muy sin sobre ser".split()
))
MEASURES = ["n_chars", "n_words", "word_chars", "n_digits", "n_upper", "n_symbols", "n_lines", "n_dup_lines", "n_tokens", "n_distinct", "n_top", "n_stop"]


def _runs(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each of the n documents has, and how often its most frequent one occurs."""
    bits = np.uint64(max(1, n.bit_length()))
    key = np.sort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    size, own = np.diff(np.append(first, len(key))), (key[first] >> (np.uint64(64) - bits)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, own, size)
    return np.bincount(own, minlength=n), top


class Measurer:
    def __init__(self) -> None:
        self.hasher = Hasher()
        self.stop = np.sort(self.hasher.tokens(pa.array([" ".join(STOP_WORDS)]))[0])
        self.symbol = np.zeros(256, bool)
        self.symbol[list(SYMBOLS.encode())] = True

    def measure(self, texts: pa.Array) -> np.ndarray:
        """A row of counts for each text, in the order of MEASURES."""
        data, at = lowered(texts, lower=False)
        n = len(at) - 1

        def count(mask: np.ndarray) -> np.ndarray:
            return np.diff(np.searchsorted(np.flatnonzero(mask), at))

        space = (data == 32) | (data == 9) | (data == 10) | (data == 13)
        further = (data & 0xC0) == 0x80
        chars = np.diff(at) - count(further) - 1
        begin = ~space
        begin[1:] &= space[:-1]
        ends = np.flatnonzero(data == 10)
        begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        words = np.flatnonzero(begin)
        # A line begins after a line end, so any word in it begins in it.
        filled = np.searchsorted(words, ends) > np.searchsorted(words, begins)
        begins, ends = begins[filled], ends[filled]
        of_line = np.searchsorted(at, begins, "right") - 1
        lines = np.bincount(of_line, minlength=n)
        distinct_lines, _ = _runs(of_line, self.hasher.spans(data, begins, ends), n)
        h, first = self.hasher.tokens(texts)
        tokens = np.diff(first)
        distinct, top = _runs(np.repeat(np.arange(n), tokens), h, n)
        stop = self.stop[np.minimum(np.searchsorted(self.stop, h), len(self.stop) - 1)] == h
        return np.stack(
            [chars, np.diff(np.searchsorted(words, at)), chars - count(space) + 1, count((data >= 48) & (data <= 57)), count((data >= 65) & (data <= 90)), count(self.symbol[data]), lines, lines - distinct_lines, tokens, distinct, top, np.diff(np.searchsorted(np.flatnonzero(stop), first))], axis=1
        ).astype(np.int64)


def measured(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns named, as they are, and the counts of every row."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *also, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measurer = Measurer()
        for batch in chunks(batches, "text", 1 << 20):
            x = measurer.measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *also)], *[pa.array(np.ascontiguousarray(x[:, j])) for j in range(len(MEASURES))]], ["doc_id", *also, *MEASURES])

    schema = [f"{f.name} {f.dataType.simpleString()}" for f in kept.drop("text").schema.fields]
    return kept.mapInArrow(run, ", ".join([*schema, *[f"{c} long" for c in MEASURES]]))


_CLASS = SYMBOLS.replace("[", "\\[").replace("]", "\\]").replace("^", "\\^")
#: The same in DuckDB, as a query over documents.
SQL = f"""
SELECT doc_id, source, length(t)::BIGINT AS n_chars, len(regexp_extract_all(t, '[^ \\t\\n\\r]+'))::BIGINT AS n_words, length(regexp_replace(t, '[ \\t\\n\\r]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^0-9]', '', 'g'))::BIGINT AS n_digits, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^{_CLASS}]', '', 'g'))::BIGINT AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct,
  coalesce(list_max(map_values(histogram_of)), 0)::BIGINT AS n_top, len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], x)))::BIGINT AS n_stop
FROM (SELECT doc_id, source, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r]')) AS lines, w, list_aggregate(w, 'histogram') AS histogram_of
  FROM (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w FROM documents))
"""
