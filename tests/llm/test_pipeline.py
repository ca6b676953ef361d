"""The pipeline over the small documents against stages restated in plain Python."""

import collections
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import langid, mixing, neardup, pii
from graphloom.llm.textkit import Hasher
from graphloom.session import stored, table

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline(spark):
    import pyarrow as pa

    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.fit(docs)
    ids = sorted(rows)
    rejected = model.identify(Hasher(), pa.array([rows[i].text for i in ids]))[2]
    kept = [i for i, no in zip(ids, rejected) if not no]
    assert len(kept) >= 0.98 * len(ids)
    grams = {i: {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} for i in kept for w in [words(rows[i].text)]}
    root = {i: i for i in kept}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in kept:
        for b in kept:
            if a < b and len(grams[a] & grams[b]) >= neardup.THRESHOLD * len(grams[a] | grams[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    kept = [i for i in kept if find(i) == i]
    items = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(v[j : j + min(8, len(v))]) for v in items for j in range(max(1, len(v) - 7))}
    kept = [i for i in kept if not any(tuple(words(rows[i].text)[j : j + 8]) in windows for j in range(len(words(rows[i].text))))]
    hider = pii.train()
    texts = {i: pii.replaced(rows[i].text, [(a, b, pii.KINDS[k], p) for a, b, k, p in hider.spans(rows[i].text)]) for i in kept}
    df = spark.createDataFrame([(i, texts[i], rows[i].source) for i in kept], "doc_id long, text string, source string")
    want = collections.Counter(tuple(r) for r in mixing.mix(mixing.entries_of(df)).collect())
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


AWKWARD = [
    (1, "the cat and the dog of it in the house with a hat", "en", "a", 49),
    (1, "the cat and the dog of it in the house with a hat", "en", "a", 49),
    (1, "another text of the same number about the river and the sea", "en", "a", 59),
    (None, "der Hund und die Katze sind in dem Haus mit einem Hut", "de", None, 52),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "   \n ", "en", "a", 5),
    (5, "!!! ??? ...", "en", "b", 11),
    (6, "the man with the mail jo.doe.17@mail.example.com is in the house", "en", "b", 64),
    (7, "this is the answer to the question of the life and all of the rest", "en", "b", 66),
    (8, "the long and winding road of the king and the queen " * 20_000, "en", "c", 1_040_000),
]


def written(spark, tmp_path, rows, benchmark):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_key", "copies", "row_id", "row_content", "text_hash", "failures", "language", "h"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs.columns


def test_pipeline_on_awkward_documents(spark, tmp_path):
    random.seed(51)
    words_of = {"en": "the cat and dog of it in house with a hat another text same number about river sea man mail is this answer to question life all rest long winding road king queen sun tree bush bird".split(), "de": "der Hund und die Katze sind in dem Haus mit einem Hut das ist gut Mond Sonne Baum Wiese Fisch Taube Topf Tasse nicht auch wir".split()}
    filler = [(100 + i, " ".join(random.choices(words_of[x], k=random.randint(8, 60))), x, "a", 50) for i, x in enumerate(["en", "de"] * 80)]
    sf, columns = written(spark, tmp_path, [*AWKWARD, *filler], [(1, "this is the answer to the question of the life"), (None, "the cat"), (2, None)])
    docs, seen = table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf))
        assert docs.columns == columns
        seen[name] = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    by = lambda name: {d for d, _ in seen[name]}
    assert {2, 3, 4, 5}.isdisjoint(by("language_id")) and {1, 6, 7, 8, None} <= by("language_id")
    assert sum(n for (d, _), n in seen["near_duplicates"].items() if d == 1) == 2  # two texts share an id, one of them twice
    assert 7 in by("near_duplicates") and 7 not in by("decontamination") and {None, 1, 6, 8} <= by("decontamination")
    assert any("[EMAIL]" in t for d, t in seen["pii"] if d == 6) and sum(seen["pii"].values()) == sum(seen["decontamination"].values())
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and {r.doc_id for r in got} <= by("pii") and all(r.copies > 0 for r in got)


def test_pipeline_on_empty_tables(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    sf, _ = written(spark, tmp_path / "a", [], [(1, "x")])
    assert corpus_pipeline.run(spark, sf).count() == 0
    sf, _ = written(spark, tmp_path / "b", AWKWARD, [])
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} >= {1, 6, 7}  # 8 alone is longer than what its source may give
