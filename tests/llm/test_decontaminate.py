import hashlib
import re

from parcelforge.llm import decontaminate as d
from tests.llm.conftest import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window):
    wins = {}
    for item, text in items:
        w = WORD.findall((text or "").lower())
        n = min(window, len(w))
        for j in range(len(w) - n + 1) if item is not None and n else ():
            wins.setdefault(tuple(w[j : j + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").lower())
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if names := wins.get(tuple(w[i : i + n])):
                    found |= names
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases(rng):
    items = [(i, " ".join(words_of(rng, 14, 60))) for i in range(12)] + [(50, "Short one"), (51, "w1"), (52, ""), (53, None), (None, "w2 w3"), (3, "again w5 w6 w7"), (2, None)]
    docs = [(i, " ".join(words_of(rng, 80, 60))) for i in range(30)]
    for i, (_, t) in enumerate(items[:10]):
        docs.append((100 + i, " ".join(words_of(rng, 7, 60)) + " " + t.upper().replace(" ", ", ") + " " + t))
    docs += [(200, None), (201, ""), (202, "  ...  "), (203, "short ONE"), (203, "short ONE"), (None, "a short one"), (204, " ".join(words_of(rng, 30000, 3000)))]
    return docs, items


def test_matches_brute_force(spark, make_docs, rng):
    docs, items = cases(rng)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (10_000, 20):
        got = d.contamination(make_docs(docs), bench, window=10, block_words=block_words).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(docs, items, 10)


def test_small_segments_and_spans(spark, make_docs, rng):
    docs, items = cases(rng)
    index = d.build_index(make_docs(docs), segment_bytes=300)
    assert index.count() > 20
    rows = d.phrase_matches(index, spark.createDataFrame(items, "item_id long, text string"), window=10).collect()
    want = {(r[0], r[2], r[3]) for r in brute(docs, items, 10)}
    assert {(r.id, sum(s.stop - s.start for s in r.spans), len(r["items"])) for r in rows} == want
    assert all(a.stop < b.start for r in rows for a, b in zip(r.spans, r.spans[1:]))


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(make_docs([]), none).count() == 0
    row = d.contamination(make_docs([(1, "a b")]), none).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)


def test_proximity(spark, make_docs):
    docs = [(1, "alpha x y beta z gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "gamma beta alpha"), (4, "alpha beta")]
    bench = spark.createDataFrame([(7, "Alpha beta GAMMA beta")], "item_id long, text string")
    index = d.build_index(make_docs(docs))
    assert {r.id for r in d.proximity_matches(index, bench, width=6).collect()} == {1, 3}
    assert {r.id for r in d.proximity_matches(index, bench, width=3).collect()} == {3}
    assert {r.id for r in d.proximity_matches(index, bench, width=40).collect()} == {1, 2, 3}


def test_stage_keeps_clean_documents(spark, make_docs, rng):
    docs, items = cases(rng)
    frame = make_docs(docs)
    kept = d.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    bad = {r[0] for r in brute(docs, items, 10) if r[5]}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)
