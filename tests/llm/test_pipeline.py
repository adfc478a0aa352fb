import corpus_pipeline
from parcelforge.llm import decontaminate, line_dedup, mixing, near_dup, quality
from parcelforge.llm.tables import materialize, table


def test_stages_in_order_and_columns(spark, sf):
    docs = table(spark, sf, "documents")
    seen, columns = [docs.count()], docs.columns
    labels, benchmark = table(spark, sf, "labels"), table(spark, sf, "benchmark")
    want = [
        lambda d: quality.keep_good(d, labels),
        line_dedup.drop_repeated_lines,
        lambda d: near_dup.drop_near_duplicates(d, k=5),
        lambda d: decontaminate.drop_contaminated(d, benchmark),
        mixing.mix_corpus,
    ]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, want, strict=True):
        out = materialize(stage(spark, docs, sf), "stage")
        assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, plain(docs).collect()), key=str), name
        seen.append(out.count())
        if name != "source mixing":
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = out
    assert docs.columns == [*columns, "size", "source_size", "target", "taken"]
    assert seen == sorted(seen, reverse=True) and seen[-1] == seen[-2] > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(entry.oracle_sql()) <= set(names)
