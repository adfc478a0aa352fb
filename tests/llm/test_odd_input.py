"""Every stage and operator on empty tables, nulls, repeated rows and extra columns whose names are those that the operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelforge.llm import chat, decontaminate, line_dedup, mixing, near_dup, quality, top_k, toxicity, warc
from parcelforge.llm.tables import private

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"
CLASHING = (
    "bad_id", "gone_id", "gone_doc", "gone_lines", "lines_dropped", "all_lines", "score", "copy", "hub", "rep", "label", "kept", "size", "source_size", "target", "taken", "row", "pattern", "hash", "own", "sources", "units",
    "id", "words", "spans", "items", "n_words", "component_id", "text2", "least", "copies", "times", "rest", "closer", "hash_limit", "segment", "place",
)
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (5, "x" * 5000), (None, "a row without an id that is long enough"), (None, None), (6, "same words in this line of text here"), (7, "same words in this line of text here")]


def clashing(frame):
    have = set(frame.columns)
    return frame.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING if c not in have])


@pytest.fixture
def folder(spark, make_docs, tmp_path):
    def make(rows, marks=(), items=(), extra=lambda f: f):
        at = tmp_path / str(len(list(tmp_path.iterdir())))
        for name, frame in (("documents", extra(make_docs(rows))), ("labels", spark.createDataFrame(list(marks), LABELS)), ("benchmark", spark.createDataFrame(list(items), ITEMS))):
            frame.write.parquet(str(at / f"{name}.parquet"))
        return str(at)

    return make


def test_pipeline_on_odd_rows(spark, folder):
    sf = folder(ODD, items=[(1, None), (None, "a b c"), (2, "")], extra=clashing)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*docs.columns, "_size", "_source_size", "_target", "_taken"]
    rows = got.collect()
    # copies of 4 and of 6 go; what has no words or no id stays
    assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 2, 3, 4, 5, 6, None, None], key=str)
    assert all(r[c] == f"own {c}" for r in rows for c in ("bad_id", "gone_id", "lines_dropped", "taken", "hub"))
    assert {r.doc_id: r._size for r in rows if r.doc_id} == {1: 0, 2: 0, 3: 0, 4: 7, 5: 1, 6: 8} and {r._taken for r in rows if r._size == 0} == {0}


def test_pipeline_on_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0
    kept = corpus_pipeline.run(spark, folder([(1, "plain words of a text")], marks=[(1, 1, 0), (2, None, None)])).collect()
    assert [(r.doc_id, r.text, r.size) for r in kept] == [(1, "plain words of a text", 5)]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_keeps_clashing_columns(spark, folder, name, stage):
    marks = [(i, int(i % 2), 0) for i in range(40)]
    rows = ODD + [(100 + i, f"plain text number {i} of some words here") for i in range(5)]
    sf = folder(rows, marks, [(1, "one two three four five six seven")], clashing)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = stage(spark, docs, sf)
    assert out.columns[: len(docs.columns)] == docs.columns
    for r in out.collect():
        assert r["bad_id"] == "own bad_id" and r["gone_lines"] == "own gone_lines" and r["hash"] == "own hash"


def test_operators_with_clashing_columns(spark, make_docs):
    docs = clashing(make_docs(ODD))
    none, items = spark.createDataFrame([], LABELS), spark.createDataFrame([(1, "one two three four five six seven")], ITEMS)
    assert decontaminate.contamination(docs, items).where("contaminated").count() == 2
    assert near_dup.near_duplicates(docs, k=2).count() == len(ODD)
    assert [(r.doc, r.lines) for r in line_dedup.repeated_lines(docs).collect()] == [(7, [0])]  # rows that repeat are one document
    assert quality.quality(docs, none).count() == toxicity.toxicity(docs, none).count() == mixing.mix_documents(docs).count() == len(ODD)
    pages = clashing(spark.createDataFrame([(1, "u", "a"), (1, "u", None)], "page_id long, url string, html string"))
    assert warc.archived_pages(pages).count() == 2
    turns = clashing(spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string"))
    assert chat.perspectives(turns).count() == 1
    vectors = clashing(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"))
    assert top_k.embedding_neighbours(vectors).count() == 1


def test_several_texts_of_one_id(make_docs):
    """One id with two texts is one document: it links what its texts are copies of; in the stage its smallest text stays."""
    a, b = "the first text has these words in it and some more", "another text with quite different words that go on and on"
    rows = [(1, a), (2, b), (3, a), (3, b), (4, "alone with words of its own that nobody shares")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(make_docs(rows), k=2).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}
    left = near_dup.drop_near_duplicates(make_docs([(5, a), (5, b), (5, None), (6, b + " x y z p q r s")]), k=2).collect()
    assert {(r.doc_id, r.text) for r in left} == {(5, None), (6, b + " x y z p q r s")} or {r.doc_id for r in left} == {5}


def test_private_names(make_docs):
    assert private(make_docs([]), "Doc_ID", "new", "new") == ["_Doc_ID", "new", "_new"]
