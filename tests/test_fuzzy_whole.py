"""The fuzzy join against all pairs."""

import random

import pytest

from parcelforge import queries
from parcelforge.functions import fuzzy
from parcelforge.plans.registry import table


def plain_best(lefts, rights, cutoff, score=fuzzy.indel):
    out = {}
    for a in lefts:
        found = [(-score(a.lower(), b.lower()), b) for b in rights if a is not None and b is not None] if a is not None else []
        found = [x for x in found if -x[0] >= cutoff]
        out[a] = (min(found)[1], -min(found)[0]) if found else (None, None)
    return out


def run(spark, lefts, rights, **more):
    left = spark.createDataFrame([(x,) for x in lefts], "name string")
    right = spark.createDataFrame([(x,) for x in rights], "place string")
    rows = fuzzy.fuzzy_best(left, right, "name", "place", **more).collect()
    assert len(rows) == len(lefts)
    return {r.name: (r.match, r.score) for r in rows}


def test_texts_that_share_no_head(spark):
    got = run(spark, ["elpha", "Đàlat", "", None], ["alpha", "Dalat", "", None], cutoff=60.0)
    assert got == {"elpha": ("alpha", 80.0), "Đàlat": ("Dalat", 60.0), "": ("", 100.0), None: (None, None)}


@pytest.mark.parametrize("cutoff", [1.0, 40.0, 60.0, 75.0, 80.0, 100.0])
def test_all_pairs(spark, cutoff):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aabcdeĐđạ x") for _ in range(rng.randrange(0, 12)))
    lefts, rights = sorted({word() for _ in range(60)}), sorted({word() for _ in range(80)})
    assert run(spark, lefts, rights, cutoff=cutoff) == plain_best(lefts, rights, cutoff)


def test_other_scores_and_blocks(spark):
    lefts, rights = ["so vao", "b a", "zz"], ["abc so vao so", "a b", "q"]
    assert run(spark, lefts, rights, score=fuzzy.partial_ratio, cutoff=90.0) == plain_best(lefts, rights, 90.0, fuzzy.best_window)
    with pytest.raises(ValueError):
        run(spark, lefts, rights, block_left="name")


def test_query_against_all_pairs(spark, sf):
    head = lambda t: t.strip().split()[0] if t.strip() else ""
    rights = {head(r.text) for r in table(spark, sf, "conversations").collect() if r.text is not None}
    lefts = {r.item_id: head(r.text) for r in table(spark, sf, "benchmark").collect()}
    want = plain_best(set(lefts.values()), rights, 60.0)
    got = {r.item_id: (r.match, r.score) for r in queries.QUERIES["fuzzy_best"](spark, sf).collect()}
    assert got == {i: want[w] for i, w in lefts.items()}
