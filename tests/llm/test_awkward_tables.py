"""Nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, decontaminate, htmltext, langid, ledger, licenses, mixing, neardup, pii, queries, ruleclassifier

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "one quick fox jumps over some lazy logs " * 30_000
ROWS = [
    (1, "the cat and the dog of it", "en", "a", 25),
    (1, "the cat and the dog of it", "en", "a", 25),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "der Hund und die Katze", "de", "b", 22),
    (4, LONG, "en", None, len(LONG)),
    (5, "mail to jo.doe.17@mail.example.com now", "en", "b", 38),
    (6, "!!! ???", "en", "b", 7),
    (7, "Released under the MIT License.", "en", "b", 31),
]
CLASHING = ["token", "segment", "positions", "_wanted", "node", "root", "u", "v", "key", "bands", "similarity", "w0", "_key", "_range", "running_tokens", "copies", "content", "spans", "gram", "template", "language", "probability", "failures", "keep", "h", "count", "n_words", "_source", "new", "group"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def items(spark, *texts):
    return spark.createDataFrame([*enumerate(texts), (None, "no id"), (99, None)], "item_id long, text string").withColumn("token", F.lit(1))


def test_decontamination(spark, docs, empty):
    got = decontaminate.decontaminate(docs, items(spark, "the cat and the dog of it")).collect()
    assert sorted((r.doc_id, r.item_id, r.kind, r.n_tokens) for r in got if r.doc_id == 1) == [(1, 0, "exact", 7)] * 2  # repeated rows report each
    assert decontaminate.decontaminate(empty, items(spark, "x y")).count() == 0
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    kept = decontaminate.drop_contaminated(docs, items(spark, "the cat and the dog of it"))
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 5, 6, 7]


def test_near_duplicates(spark, docs, empty):
    got = {r.doc_id: r.duplicate_of for r in neardup.near_duplicates(docs).collect()}
    assert got == {3: 2}  # null and empty texts are copies
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 7]
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0


def test_near_duplicates_without_or_with_shared_ids(spark):
    a, b, c = [" ".join(f"{x}{i}" for i in range(30)) for x in "abc"]
    rows = [(None, a), (None, a), (1, a), (1, b), (1, b), (2, b + " more"), (None, c), (None, c), (3, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_first_", F.lit(1)).withColumn("row_k", F.lit(1)).withColumn("Row_ID", F.lit(1))
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (None, c), (3, None)], key=str)
    assert [tuple(r)[:2] for r in neardup.near_duplicates(df).collect()] == [(2, 1)]


def test_mixing(docs, empty):
    got = mixing.mix(mixing.entries_of(docs), {"a": 0.5, "b": 0.5}, total=1000).collect()
    assert {r.source for r in got} <= {"a", "b"} and len([r for r in got if r.doc_id == 1]) == 2
    assert mixing.mix(mixing.entries_of(docs)).count() > 0 and mixing.mix(mixing.entries_of(empty)).count() == 0


def test_licenses(docs, empty):
    assert [(r.doc_id, r.license, r.start, r.end) for r in licenses.scan(docs).collect()] == [(7, "MIT", 0, 5)]
    assert licenses.scan(empty).count() == 0


def test_language(docs, empty):
    got = langid.identify(docs)
    assert got.count() == len(ROWS) and not got.where("not keep").count()  # too few labels to fit anything
    assert langid.keep_identified(empty).count() == 0 and langid.identify(empty).count() == 0
    model = langid.train(["the cat and the dog"] * 20 + ["der Hund und die Katze"] * 20, ["en"] * 20 + ["de"] * 20)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {2, 3, 6}.isdisjoint({r.doc_id for r in kept.collect()})
    assert {r.language for r in langid.identify(docs, model).where("doc_id in (2, 3, 6)").collect()} == {None}


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (77, 0)], "doc_id long, quality int").withColumn("n_words", F.lit(1))
    got = ruleclassifier.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(r.keep and r.probability is None for r in got)
    assert ruleclassifier.classify(empty, labels).count() == 0
    entries = ledger.apply_policy(ledger.ledger(docs))
    by = {r.doc_id: r for r in entries.collect()}
    assert len(entries.collect()) == len(ROWS) and by[2].failures == by[3].failures == 1 and not by[3].keep and by[1].keep
    assert ledger.ledger(empty).count() == 0 and {r.n_docs for r in ledger.ablations(ledger.ledger(empty)).collect()} == {0}


def test_pii(docs, empty):
    model = pii.train(examples=2500)
    got = pii.redactions(docs, model).collect()
    assert [(r.doc_id, r.text, r.n_redacted) for r in got] == [(5, "mail to [EMAIL] now", 1)]
    out = pii.redact(docs, model)
    assert out.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in out.collect()}[5] == ("mail to [EMAIL] now", 19)
    assert pii.redact(empty, model).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x"), (3, "a < b <script>while(1)"), (4, "<!-- never closed"), (4, "<p>" * 20_000)], "page_id long, html string").withColumn("text", F.lit(1))
    got = htmltext.extract(pages).collect()
    assert len(got) == 6 and all(r.text == "" for r in got)
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (2, 0, "", ""), (None, 0, "user", "x"), (3, None, "user", "x"), (4, 1, "user", "hi " * 20_000), (4, 1, "user", "also")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rank", F.lit(0)).withColumn("node", F.lit(0))
    got = {r.conv_id: r for r in chat.prefix_tree(df, queries.TOKENIZER).orderBy("conv_id", "depth").collect()}
    assert chat.prefix_tree(df, queries.TOKENIZER).count() == 3 and got[1].n_conversations == 2 and got[4].depth == 1
    assert chat.prefix_tree(df.limit(0), queries.TOKENIZER).count() == 0
