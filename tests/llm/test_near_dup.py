import re

import numpy as np

from parcelforge.llm import near_dup
from parcelforge.llm.words import splitmix
from tests.llm.conftest import words_of


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(rng):
    """Groups of copies at all distances from their originals, chains, short texts and texts without words."""
    rows = []
    for g in range(6):
        base = words_of(rng, 60 + 10 * g)
        rows += [(1000 * g + i, edited(rng, base, rng.randrange(0, 12))) for i in range(25)]
        rows.append((1000 * g + 500, " ".join(base)))
        chain = list(base)
        for i in range(12):
            chain[rng.randrange(len(chain))] = f"c{g}{i}"
            rows.append((1000 * g + 700 + i, " ".join(chain)))
    rows += [(9000 + i, " ".join(words_of(rng, rng.randrange(1, 30), 15))) for i in range(60)]
    return rows + [(9900, None), (9901, ""), (9902, " \n\t "), (9903, "one"), (9904, "One"), (9905, "Two words"), (9906, "two  words"), (9906, "two  words")]


def test_components_match_brute_force(make_docs, rng):
    rows = corpus(rng)
    for k in (2, 5):
        got = near_dup.near_duplicates(make_docs(rows), k=k).collect()
        want = brute(rows, k)
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def test_null_ids_and_empty_table(make_docs):
    got = near_dup.near_duplicates(make_docs([(None, "a b c"), (1, "a b c"), (2, "A B  c")]), k=2).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, True), (1, 1, True), (2, 1, False)]
    assert near_dup.near_duplicates(make_docs([]), k=2).count() == 0


def test_stage_keeps_one_of_each_group(make_docs, rng):
    rows = [*corpus(rng), (None, "x"), (None, "x")]
    frame = make_docs(rows)
    kept = near_dup.drop_near_duplicates(frame, k=5)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    want = brute(rows, 5)
    assert ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in want.items() if i == c)


def test_sketches_fill_and_estimate():
    t, base = 288, splitmix(np.arange(4000, dtype=np.uint64))
    sets = [base[:1], base[:3], base[:2000], base[400:2400], base[2000:4000]]
    s = near_dup.sketches(sets, t)
    assert not (s >> np.uint64(63)).any()
    assert abs((s[2] == s[3]).mean() - 1600 / 2400) < 0.1
    assert (s[2] == s[4]).mean() < 0.05
    assert np.array_equal(s[0], near_dup.sketches([base[:1]], t)[0])


def test_components_follow_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.id: r.label for r in near_dup.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_members_apart_from_their_hub_are_linked_by_shared_edits():
    hub = set(range(100))
    sets = {1: hub - set(range(0, 20)) | {500, 501}, 2: hub - set(range(1, 21)) | {500, 502}, 3: hub - set(range(60, 85)), 4: hub - {99}}
    side = lambda ids: {"rep": np.array(ids), "n": np.array([len(sets[i]) for i in ids]), "label": np.array(ids), "edits": [np.array(sorted(sets[i] ^ hub)) for i in ids]}
    got = set(near_dup.block_links(side([1, 2, 3]), side([1, 2, 3, 4]), 80))
    want = {(a, b) for a in (1, 2, 3) for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert got == want and (1, 2) in got
