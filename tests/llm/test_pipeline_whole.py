"""The stages one after the other against brute force, with labels that train a network and with labels that train none."""

import pytest

import corpus_pipeline
from parcelforge.llm import quality
from tests.llm import test_decontaminate, test_line_dedup, test_near_dup
from tests.llm.conftest import words_of

LABELS = "doc_id long, quality int, toxic int"


def corpus(rng):
    """(doc_id, text, source), the benchmark's items, and the ids of junk."""
    items = [(i, " ".join(words_of(rng, 14))) for i in range(4)]
    boiler = "this line is on many of the pages here and everywhere else"
    rows = []
    for i in range(110):
        lines = [" ".join(words_of(rng, rng.randrange(8, 20))) for _ in range(rng.randrange(2, 6))]
        rows.append((i, "\n".join([*lines, boiler] if i % 3 == 0 else lines), f"src{i % 3}"))
    junk = set(range(200, 250))
    rows += [(i, " ".join(w.upper() + "!!" for w in words_of(rng, rng.randrange(20, 60))), f"src{i % 3}") for i in junk]
    rows += [(300 + i, rows[i][1].replace("\n", " ") + " more", "src1") for i in range(10)]
    rows += [(400 + i, f"{' '.join(words_of(rng, 30))} {items[i][1]} {' '.join(words_of(rng, 30))}", "src2") for i in range(4)]
    return [*rows, (500, boiler, "src0"), (501, "words of few", "src2")], items, junk


def brute(rows, items):
    """{doc_id: (words, source)} of what comes to the mixing stage."""
    gone = test_line_dedup.brute([r[:2] for r in rows], 1, 8)
    left = {}
    for d, text, source in rows:
        kept = "\n".join(x for k, x in enumerate(text.split("\n")) if (True, d, k) not in gone)
        if kept == text or kept.split():
            left[d] = (kept, source)
    labels = test_near_dup.brute([(d, t) for d, (t, _) in left.items()], 5)
    left = {d: x for d, x in left.items() if labels[d][1] == d}
    bad = {r[0] for r in test_decontaminate.brute([(d, t) for d, (t, _) in left.items()], items, 10) if r[5]}
    return {d: (len(t.split()), s) for d, (t, s) in left.items() if d not in bad}


def plain_targets(sizes):
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    total, out = 1.5 * sum(sizes.values()), {}
    while open_ := [s for s in sizes if s not in out]:
        rest = total - sum(out.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s: 2.0 * sizes[s] for s in open_ if share[s] > 2 * sizes[s]}
        out |= over or share
        if not over:
            break
    return out


@pytest.mark.parametrize("kinds", [(0, 1), (1,), ()])
def test_pipeline_matches_brute_force(spark, make_docs, rng, tmp_path, kinds):
    rows, items, junk = corpus(rng)
    marks = [(d, int(d not in junk), 0) for d, _, _ in rows if int(d not in junk) in kinds]
    for name, frame in (("documents", make_docs(rows)), ("labels", spark.createDataFrame(marks, LABELS)), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    want = brute([r for r in rows if len(kinds) < 2 or r[0] not in junk], items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.size for r in got} == {d: n for d, (n, _) in want.items()} and len(got) == len(want)
    sizes = {s: sum(n for n, x in want.values() if x == s) for s in {s for _, s in want.values()}}
    targets, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        s = want[r.doc_id][1]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= max(3, 0.02 * targets[s]) for s in sizes)


@pytest.mark.parametrize("marks", [[], [(1, 1, 0), (2, 1, 0)], [(1, 0, 0)], [(1, None, 1)]])
def test_all_are_kept_without_a_network(spark, make_docs, marks):
    docs = make_docs([(1, "plain words"), (2, None), (None, "x"), (1, "plain words")])
    kept = quality.keep_good(docs, spark.createDataFrame(marks, LABELS))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
